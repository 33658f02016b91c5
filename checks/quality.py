"""Checks of the quality scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import quality as q

from .tables import COLUMNS, RELATIONAL, VIEWS, is_number, load, with_views

SCORED = ("lineitem", "orders", "customer", "part", "events", "dirty_customer", "dirty_orders")
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(
        *[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema]
    )


def union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def views_of(*tables: str) -> list[str]:
    return [t for t in tables if t in VIEWS]


def column_sql(table: str) -> str:
    """Facts and scores of every column of a table, in plain SQL."""
    parts = []
    for i, (c, t) in enumerate(COLUMNS[table]):
        if is_number(t):
            fence = f"""(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {table})"""
            out = f"coalesce(sum(CASE WHEN q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) THEN 1 ELSE 0 END), 0)"
            src = f"{table}, {fence} f"
            lo, hi, mean = f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)", f"avg(CAST({c} AS DOUBLE))"
            numbers, mixed = "CAST(NULL AS BOOLEAN)", "0"
        else:
            out, src = "0", table
            lo = hi = mean = "CAST(NULL AS DOUBLE)"
            if t == "string":
                numbers = f"coalesce(bool_and(regexp_matches({c}, '{NUMBER}')), true)"
                mixed = f"coalesce(sum(CASE WHEN {c} <> lower({c}) AND {c} <> upper({c}) THEN 1 ELSE 0 END), 0)"
            else:
                numbers, mixed = "CAST(NULL AS BOOLEAN)", "0"
        parts.append(
            f"SELECT '{table}' AS table_name, {i} AS position, '{c}' AS column_name, '{t}' AS data_type, "
            f"count(*) AS row_count, count({c}) AS non_null, count(*) - count({c}) AS null_count, "
            f"count(DISTINCT {c}) AS unique_count, {numbers} AS all_numbers, CAST({mixed} AS BIGINT) AS mixed_case, "
            f"{lo} AS min_value, {hi} AS max_value, {mean} AS mean_value, CAST({out} AS BIGINT) AS outliers FROM {src}"
        )
    facts = " UNION ALL ".join(parts)
    return f"""
      SELECT *, CASE WHEN row_count = 0 THEN 0 ELSE 1e2 * non_null / row_count END AS completeness,
             CASE WHEN row_count = 0 THEN 0e0 WHEN all_numbers THEN 95e0 ELSE 100e0 END AS validity,
             CASE WHEN row_count = 0 THEN 0 ELSE 1e2 * non_null / row_count END AS consistency,
             CASE WHEN non_null = 0 THEN 0 ELSE least(1e2, 1e2 * unique_count / non_null) END AS uniqueness,
             CASE WHEN row_count = 0 THEN 0e0 WHEN non_null = 0 THEN 100e0 ELSE 1e2 - 1e2 * outliers / non_null END AS accuracy
      FROM ({facts}) facts"""


def scored_sql(*tables: str) -> str:
    return " UNION ALL ".join(column_sql(t) for t in tables)


TABLE_SQL = """
  SELECT table_name, max(row_count) AS total_rows, count(*) AS total_columns,
         avg(completeness) AS completeness, avg(validity) AS validity, avg(consistency) AS consistency,
         avg(uniqueness) AS uniqueness, avg(accuracy) AS accuracy,
         0.25e0 * avg(completeness) + 0.20e0 * avg(validity) + 0.20e0 * avg(consistency)
           + 0.15e0 * avg(uniqueness) + 0.20e0 * avg(accuracy) AS quality_score
  FROM scored GROUP BY table_name"""


def tables_sql(*tables: str) -> str:
    return f"WITH scored AS ({scored_sql(*tables)}), tabs AS ({TABLE_SQL})"


ROUNDED_DIMS = ", ".join(f"round({d}, 6) AS {d}" for d in q.DIMENSIONS)


def scored(spark, sf, *tables) -> DataFrame:
    return q.score_tables({t: load(spark, sf, t) for t in tables})


def columns(spark, sf, *tables) -> DataFrame:
    return scored(spark, sf, *tables).select(*q.COLUMN_FIELDS)


def one_dimension(name: str, out: str | None = None):
    tables = ("lineitem", "events", "dirty_customer", "dirty_orders")
    operator = getattr(q, out or name)

    def run(spark, sf):
        return rounded(union(operator(load(spark, sf, t), t) for t in tables).withColumnRenamed("score", out or name))

    sql = with_views(
        f"SELECT table_name, column_name, round({name}, 6) AS {out or name} FROM ({scored_sql(*tables)}) s",
        *views_of(*tables),
    )
    return run, sql


def column_metrics(spark, sf):
    # A mean of hundredths can end in a tie at the sixth digit: five are compared.
    return rounded(columns(spark, sf, *SCORED).withColumn("mean_value", F.round("mean_value", 5)))


def table_metrics(spark, sf):
    return rounded(q.fold_columns(scored(spark, sf, *SCORED)))


def sources(spark, sf, names=RELATIONAL, missing: bool = True):
    found = {t: (lambda t=t: load(spark, sf, t)) for t in names}
    if missing:
        found["absent_table"] = lambda: spark.read.parquet(f"{sf}/absent_table.parquet")
    return found


def dataset_metrics(spark, sf):
    tables = q.dataset_metrics(spark, sources(spark, sf))
    summary = q.dataset_summary(tables).select(
        F.lit("(all tables)").alias("table_name"), F.col("overall_quality_score").alias("quality_score"),
        F.col("total_tables").alias("total_rows"), F.col("analyzed_tables").alias("total_columns"),
    )
    return rounded(tables.withColumn("failed", F.col("error").isNotNull()).drop("error")
                   .unionByName(summary, allowMissingColumns=True))


def combined(mapping):
    def run(spark, sf):
        return rounded(q.combined_metrics(q.dataset_metrics(spark, sources(spark, sf)), mapping))

    return run


def quality_metrics_table(spark, sf):
    return rounded(q.table_metrics(load(spark, sf, "part"), "file_data"))


def column_quality_ui(spark, sf):
    return rounded(q.column_quality_ui(columns(spark, sf, "dirty_customer", "dirty_orders")))


def score_band(spark, sf):
    m = q.fold_columns(scored(spark, sf, "dirty_customer", "dirty_orders"))
    return rounded(m.select(
        "table_name", "quality_score", q.score_band(F.col("quality_score")).alias("score_band"),
        q.score_band(F.col("uniqueness")).alias("uniqueness_band")))


def score_issues(spark, sf):
    m = q.fold_columns(scored(spark, sf, "dirty_customer", "dirty_orders"))
    longer = m.select("table_name", F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(s).alias("score"))
        for d, s in (("completeness", "completeness"), ("uniqueness", "uniqueness"),
                     ("cardinality", "validity"), ("consistency", "consistency"), ("volumetry", "accuracy"))])))
    found = q.score_issues(longer)
    return rounded(found.select(
        "table_name", "dimension", "score", F.array_join("issues", " | ").alias("issues"),
        F.array_join("recommendations", " | ").alias("recommendations")))


RULES = {
    "value_positive": "value > 0",
    "known_type": "event_type IN ('click', 'view', 'purchase', 'error', 'signup')",
    "value_below_100": "value < 100",
}


def rule_compliance(spark, sf):
    from plumbline.functions.schema import normalize

    return rounded(q.rule_compliance(normalize(load(spark, sf, "dirty_events")), RULES))


def _issues_sql() -> str:
    text = lambda items: " | ".join(items).replace("'", "''")
    arms = []
    for d in q.ISSUES:
        for least, many in ((90, 0), (85, 1), (70, 2), (-1, 3)):
            arms.append(f"('{d}', {least}, '{text(q.ISSUES[d][:many])}')")
    advice = [f"('{d}', '{text(a['good'])}', '{text(a['poor'])}')" for d, a in q.ADVICE.items()]
    return f"""
      WITH scored AS ({scored_sql('dirty_customer', 'dirty_orders')}), tabs AS ({TABLE_SQL}),
      longer AS (
        SELECT table_name, 'completeness' AS dimension, completeness AS score FROM tabs
        UNION ALL SELECT table_name, 'uniqueness', uniqueness FROM tabs
        UNION ALL SELECT table_name, 'cardinality', validity FROM tabs
        UNION ALL SELECT table_name, 'consistency', consistency FROM tabs
        UNION ALL SELECT table_name, 'volumetry', accuracy FROM tabs),
      texts(dimension, least, issues) AS (VALUES {', '.join(arms)}),
      advice(dimension, good, poor) AS (VALUES {', '.join(advice)})
      SELECT table_name, l.dimension AS dimension, round(score, 6) AS score, arg_max(issues, least) AS issues,
             CASE WHEN score >= 80 THEN max(good) ELSE max(poor) END AS recommendations
      FROM longer l JOIN texts t ON t.dimension = l.dimension AND score >= least
      JOIN advice a ON a.dimension = l.dimension GROUP BY table_name, l.dimension, score"""


def _combined_sql(body: str) -> str:
    return f"{tables_sql(*RELATIONAL)} {body}"


_D = views_of(*SCORED)

CHECKS = {
    "completeness": one_dimension("completeness"),
    "validity": one_dimension("validity"),
    "consistency": one_dimension("consistency"),
    "uniqueness": one_dimension("uniqueness"),
    "accuracy_iqr": one_dimension("accuracy", "accuracy_iqr"),
    "column_metrics": (
        column_metrics,
        with_views(
            f"""SELECT table_name, position, column_name, data_type, {ROUNDED_DIMS}, null_count, unique_count,
                round(min_value, 6) AS min_value, round(max_value, 6) AS max_value, round(mean_value, 5) AS mean_value
                FROM ({scored_sql(*SCORED)}) s""",
            *_D,
        ),
    ),
    "table_metrics": (
        table_metrics,
        with_views(
            f"""{tables_sql(*SCORED)} SELECT table_name, total_rows, total_columns, {ROUNDED_DIMS},
                round(quality_score, 6) AS quality_score FROM tabs""",
            *_D,
        ),
    ),
    "dataset_metrics": (
        dataset_metrics,
        f"""{tables_sql(*RELATIONAL)}
            SELECT table_name, total_rows, total_columns, {ROUNDED_DIMS}, round(quality_score, 6) AS quality_score,
                   false AS failed FROM tabs
            UNION ALL SELECT 'absent_table', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0e0, true
            UNION ALL SELECT '(all tables)', count(*) + 1, count(*), NULL, NULL, NULL, NULL, NULL,
                             round(avg(quality_score), 6), NULL FROM tabs""",
    ),
    "combined_metrics": (
        combined("api"),
        _combined_sql(
            """SELECT round(avg(completeness), 6) AS completeness, round(avg(uniqueness), 6) AS uniqueness,
                      round(avg(consistency), 6) AS consistency, round(avg(accuracy), 6) AS cardinality,
                      round(avg(quality_score), 6) AS volumetry, count(*) AS tables FROM tabs"""
        ),
    ),
    "combined_metrics_ui": (
        combined("ui"),
        _combined_sql(
            """SELECT round(avg(completeness)) AS completeness, round(avg(uniqueness)) AS uniqueness,
                      round(avg(consistency)) AS consistency, round(avg(validity)) AS cardinality,
                      round(avg(accuracy)) AS volumetry, count(*) AS tables FROM tabs WHERE quality_score > 0"""
        ),
    ),
    "quality_metrics_table": (
        quality_metrics_table,
        f"""{tables_sql('part')} SELECT 'file_data' AS table_name, total_rows, total_columns, {ROUNDED_DIMS},
            round(quality_score, 6) AS quality_score FROM tabs""",
    ),
    "column_quality_ui": (
        column_quality_ui,
        with_views(
            f"""SELECT table_name, column_name, round((completeness + uniqueness + consistency) / 3, 6) AS column_quality
                FROM ({scored_sql('dirty_customer', 'dirty_orders')}) s""",
            "dirty_customer", "dirty_orders",
        ),
    ),
    "score_band": (
        score_band,
        with_views(
            f"""{tables_sql('dirty_customer', 'dirty_orders')} SELECT table_name, round(quality_score, 6) AS quality_score,
              CASE WHEN quality_score >= 90 THEN 'Excellent' WHEN quality_score >= 70 THEN 'Good' ELSE 'Needs Attention' END AS score_band,
              CASE WHEN uniqueness >= 90 THEN 'Excellent' WHEN uniqueness >= 70 THEN 'Good' ELSE 'Needs Attention' END AS uniqueness_band
              FROM tabs""",
            "dirty_customer", "dirty_orders",
        ),
    ),
    "score_issues": (score_issues, with_views(_issues_sql(), "dirty_customer", "dirty_orders")),
    "rule_compliance": (
        rule_compliance,
        with_views(
            " UNION ALL ".join(
                f"""SELECT '{name}' AS rule, count(*) AS rows_checked, count(*) FILTER ({p}) AS rows_passed,
                    round(1e2 * count(*) FILTER ({p}) / count(*), 6) AS pass_rate FROM dirty_events"""
                for name, p in RULES.items()
            ),
            "dirty_events",
        ),
    ),
}
