"""Checks of the detailed scores, row operators and dataset roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import detail as d
from plumbline.operators import rows as r

from .quality import rounded, scored_sql, union
from .tables import COLUMNS, RELATIONAL, load, with_views

TABLES = ("dirty_customer", "dirty_orders", "documents", "nation")


def detail_sql(*tables: str) -> str:
    """Common table expressions ``dcols`` and ``dtabs``."""
    score = []
    for t in tables:
        for c, kind in COLUMNS[t]:
            score.append(f"('{t}', '{c}', '{kind}')")
    repeats = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicate_rows"
        for t in tables
    )
    return f"""
      facts AS ({scored_sql(*tables)}),
      base AS (
        SELECT table_name, position, column_name, data_type, row_count, non_null, null_count AS missing, unique_count, mixed_case AS mixed_values,
               1e2 * null_count / row_count AS missing_pct,
               row_count - unique_count - CASE WHEN null_count > 0 THEN 1 ELSE 0 END AS repeats,
               unique_count * 1e0 / row_count AS share,
               data_type = 'string' AND non_null > 0 AND mixed_case > non_null * 1e-1 AS mixed_case
        FROM facts),
      dcols AS (
        SELECT table_name, position, column_name, data_type, row_count, missing, missing_pct, unique_count, repeats,
               round_even(1e2 * (row_count - repeats) / row_count, 1) AS unique_pct,
               1e2 * repeats / row_count AS repeat_pct,
               CASE WHEN share < 0.01e0 THEN 'Low' WHEN share > 0.95e0 THEN 'High' END AS cardinality_flag,
               CASE WHEN share < 0.01e0 THEN 60e0 WHEN share > 0.95e0 THEN 70e0 ELSE 85e0 END AS cardinality_score,
               mixed_case,
               CASE WHEN data_type = 'string' THEN CASE WHEN non_null = 0 THEN 0e0 WHEN mixed_case THEN 70e0 ELSE 90e0 END
                    WHEN data_type LIKE 'timestamp%' THEN 85e0 ELSE 90e0 END AS consistency_score
        FROM base),
      reps AS ({repeats}),
      dtabs AS (
        SELECT c.table_name AS table_name, max(row_count) AS total_rows, count(*) AS total_columns,
               1e2 * (max(row_count) * count(*) - sum(missing)) / (max(row_count) * count(*)) AS completeness,
               1e2 * (max(row_count) - max(duplicate_rows)) / max(row_count) AS uniqueness,
               avg(cardinality_score) AS cardinality, avg(consistency_score) AS consistency,
               CASE WHEN max(row_count) < 100 THEN 70e0 ELSE 95e0 END - CASE WHEN count(*) < 2 THEN 10e0 WHEN count(*) > 100 THEN 5e0 ELSE 0e0 END AS volumetry,
               CAST(sum(missing) AS BIGINT) AS total_missing, max(duplicate_rows) AS duplicate_rows
        FROM dcols c JOIN reps USING (table_name) GROUP BY c.table_name)"""


DIRTY = ("dirty_customer", "dirty_orders")
DIMS = ", ".join(f"round({x}, 6) AS {x}" for x in d.DETAIL_DIMENSIONS)


def sql(body: str, tables=TABLES, views=DIRTY) -> str:
    return with_views(f"WITH {detail_sql(*tables)} {body}", *views)


def columns(spark, sf) -> DataFrame:
    return union(d.detail_columns(load(spark, sf, t), t) for t in TABLES)


def metrics(spark, sf, tables=TABLES) -> DataFrame:
    return union(d.detail_metrics(load(spark, sf, t), t) for t in tables)


def analyses(spark, sf, tables=TABLES) -> DataFrame:
    return union(d.detailed_analysis(load(spark, sf, t), t) for t in tables)


def project(make, *names):
    return lambda spark, sf: rounded(make(spark, sf).select(*names))


def detailed(spark, sf):
    return rounded(analyses(spark, sf).select(
        "table_name", "dimension", "score", F.array_join("issues", " | ").alias("issues"),
        F.array_join("recommendations", " | ").alias("recommendations"), F.size("details").alias("detail_entries")))


def _analysis_sql(entries: bool) -> str:
    esc = lambda items: " | ".join(items).replace("'", "''")
    advice = ", ".join(f"('{k}', '{esc(v)}')" for k, v in d.DETAIL_ADVICE.items())
    pick = lambda cond, text, order: (
        f"SELECT table_name, {text} AS t, row_number() OVER (PARTITION BY table_name ORDER BY {order}) AS rn FROM dcols WHERE {cond}"
    )
    issues = {
        "completeness": pick("missing > 0", "format('Missing values in ''{}'' field ({:.1f}%)', column_name, missing_pct)", "missing DESC, position"),
        "uniqueness": pick("repeats > 0", "format('Duplicate values in ''{}'' ({:.1f}%)', column_name, repeat_pct)", "position"),
        "cardinality": pick("cardinality_flag IS NOT NULL", "format('{} cardinality in ''{}'' field ({} unique values)', cardinality_flag, column_name, unique_count)", "position"),
        "consistency": pick("mixed_case", "format('Mixed case values in ''{}'' field', column_name)", "position"),
    }
    found = " UNION ALL ".join(f"SELECT table_name, '{k}' AS dimension, t, rn FROM ({q}) x WHERE rn <= 3" for k, q in issues.items())
    found += " UNION ALL SELECT table_name, 'volumetry', format('Low data volume ({} records)', total_rows), 1 FROM dtabs WHERE total_rows < 100"
    found += " UNION ALL SELECT table_name, 'volumetry', 'Very few columns for analysis', 2 FROM dtabs WHERE total_columns < 2"
    scores = " UNION ALL ".join(
        f"SELECT table_name, '{k}' AS dimension, {k} AS score, {'2' if k == 'volumetry' else 'total_columns'} AS detail_entries FROM dtabs"
        for k in d.DETAIL_DIMENSIONS
    )
    return f"""
      , found AS ({found}), joined AS (SELECT table_name, dimension, string_agg(t, ' | ' ORDER BY rn) AS issues FROM found GROUP BY ALL),
      scores AS ({scores}), advice(dimension, recommendations) AS (VALUES {advice}),
      analyses AS (SELECT s.table_name AS table_name, s.dimension AS dimension, round(score, 6) AS score, coalesce(issues, '') AS issues,
                          recommendations, CAST(detail_entries AS INTEGER) AS detail_entries
                   FROM scores s JOIN advice USING (dimension) LEFT JOIN joined j ON j.table_name = s.table_name AND j.dimension = s.dimension)"""


def dataset_issues(spark, sf):
    merged = d.dataset_issues(analyses(spark, sf))
    return merged.select("dimension", F.array_join("issues", " | ").alias("issues"),
                         F.array_join("recommendations", " | ").alias("recommendations"))


def weighted(spark, sf):
    return d.dataset_weighted(metrics(spark, sf, RELATIONAL))


def selected(spark, sf):
    tables = {t: load(spark, sf, t) for t in ("nation", "region", "supplier")}
    return rounded(d.selected_tables_metrics(tables, ["nation", "region", "supplier"]))


SELECTED_SQL = f"""
  WITH picked AS (
    SELECT n_nationkey, n_name, n_regionkey, NULL AS r_regionkey, NULL AS r_name, NULL AS s_suppkey, NULL AS s_name, NULL AS s_nationkey, NULL AS s_acctbal, 'nation' AS _source_table FROM nation
    UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name, NULL, NULL, NULL, NULL, 'region' FROM region
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, s_suppkey, s_name, s_nationkey, s_acctbal, 'supplier' FROM supplier)"""


def _selected_sql() -> str:
    COLUMNS["picked"] = COLUMNS["nation"] + COLUMNS["region"] + COLUMNS["supplier"] + [("_source_table", "string")]
    head = SELECTED_SQL.strip()[5:]
    return f"""WITH {head}, {detail_sql('picked')}
      SELECT 'nation+region+supplier' AS table_name, total_rows, total_columns, {DIMS}, total_missing, duplicate_rows FROM dtabs"""


def union_query(spark, sf):
    tables = {"orders": load(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("amount")),
              "customer": load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("amount"))}
    return r.union_tables(tables)


def filtered(spark, sf):
    return r.filter_source_tables(union_query(spark, sf), ["orders"])


def select_tables(spark, sf):
    catalog = union(load(spark, sf, t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("record_count")) for t in RELATIONAL)
    return r.select_tables(catalog, "ER", add=("region",), remove=("supplier",))


def by_dtype(kind):
    return lambda spark, sf: r.select_by_dtype(load(spark, sf, "orders"), kind)


def limit_rows(spark, sf):
    return r.first_rows(load(spark, sf, "orders"), ["o_orderkey"], 1000)


def sample(spark, sf):
    return r.sample_rows(load(spark, sf, "events"), ["ts", "event_id"], 100)


def sample_tables(spark, sf):
    tables = {t: load(spark, sf, t) for t in ("nation", "region", "part", "orders")}
    got = r.sample_tables(tables, {"nation": ["n_nationkey"], "region": ["r_regionkey"], "part": ["p_partkey"]})
    return got.select("table_name", F.coalesce(F.get_json_object("record", "$.n_name"), F.get_json_object("record", "$.r_name"), F.get_json_object("record", "$.p_name")).alias("name"))


def sample_values(spark, sf):
    return r.sample_values(load(spark, sf, "dirty_events"), ["ts", "event_id"]).select(
        "column_name", F.array_join("samples", " | ").alias("samples"))


def last_points(spark, sf):
    return r.last_points(load(spark, sf, "events").select("event_id", "ts", "value"), ["ts", "event_id"], 20)


def distinct_rows(spark, sf):
    return r.distinct_rows(load(spark, sf, "dirty_customer"))


def json_safe(legacy):
    from plumbline.functions.values import json_safe as safe

    def run(spark, sf):
        df = load(spark, sf, "dirty_events").select(
            "event_id", F.when(F.col("event_id") % 17 == 3, float("inf")).when(F.col("event_id") % 17 == 5, float("-inf"))
            .otherwise(F.col("value")).alias("value"))
        return safe(df, legacy)

    return run


def update_row(spark, sf):
    df = load(spark, sf, "customer")
    edits = union([
        df.select("c_custkey", F.lit("c_acctbal").alias("column_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit("12.5")).otherwise("broken").alias("new_value")).where("c_nationkey = 3"),
        df.select("c_custkey", F.lit("c_mktsegment").alias("column_name"), F.lit("EDITED").alias("new_value")).where("c_nationkey = 5"),
        df.select("c_custkey", F.lit("no_such_column").alias("column_name"), F.lit("x").alias("new_value")).where("c_nationkey = 7"),
    ])
    return r.update_rows(df, edits, "c_custkey")


def table_preview(spark, sf):
    from plumbline.sources.catalog import table_preview as preview

    rows, facts = preview(load(spark, sf, "dirty_customer"), ["c_custkey"], 20)
    return rounded(facts)


def sort_by_time(spark, sf):
    return load(spark, sf, "daily_orders").orderBy("d")


_INF = "CASE WHEN event_id % 17 IN (3, 5) THEN {} ELSE {} END AS value"

CHECKS = {
    "completeness_cells": (
        lambda spark, sf: rounded(metrics(spark, sf).select("table_name", "completeness", "total_missing")),
        sql("SELECT table_name, round(completeness, 6) AS completeness, total_missing FROM dtabs"),
    ),
    "uniqueness_rows": (
        project(columns, "table_name", "column_name", "repeats", "unique_pct"),
        sql("SELECT table_name, column_name, repeats, unique_pct FROM dcols"),
    ),
    "cardinality_score": (
        project(columns, "table_name", "column_name", "unique_count", "cardinality_flag", "cardinality_score"),
        sql("SELECT table_name, column_name, unique_count, cardinality_flag, cardinality_score FROM dcols"),
    ),
    "consistency_case": (
        project(columns, "table_name", "column_name", "mixed_case", "consistency_score"),
        sql("SELECT table_name, column_name, mixed_case, consistency_score FROM dcols"),
    ),
    "volumetry_score": (
        lambda spark, sf: metrics(spark, sf).select("table_name", "total_rows", "total_columns", "volumetry"),
        sql("SELECT table_name, total_rows, total_columns, volumetry FROM dtabs"),
    ),
    "detail_metrics": (
        lambda spark, sf: rounded(metrics(spark, sf)),
        sql(f"SELECT table_name, total_rows, total_columns, {DIMS}, total_missing, duplicate_rows FROM dtabs"),
    ),
    "detailed_analysis": (detailed, sql(_analysis_sql(True) + " SELECT * FROM analyses")),
    "top_missing_columns": (
        lambda spark, sf: rounded(d.top_missing_columns(columns(spark, sf))),
        sql("SELECT table_name, column_name, missing, round(missing_pct, 6) AS missing_pct FROM dcols WHERE missing > 0 ORDER BY missing DESC, table_name, position LIMIT 5"),
    ),
    "dataset_metrics_weighted": (
        weighted,
        sql("SELECT " + ", ".join(f"round(sum({x} * total_rows) / sum(total_rows), 2) AS {x}" for x in d.DETAIL_DIMENSIONS)
            + ", CAST(sum(total_rows) AS BIGINT) AS total_rows, count(*) AS tables FROM dtabs WHERE total_rows > 0", RELATIONAL, ()),
    ),
    "dataset_issues": (
        dataset_issues,
        sql(_analysis_sql(True) + """
          , tagged AS (SELECT dimension, table_name, '[' || table_name || '] ' AS tag, issues, recommendations FROM analyses)
          SELECT dimension,
                 coalesce(string_agg(tag || replace(issues, ' | ', ' | ' || tag), ' | ' ORDER BY table_name) FILTER (issues <> ''), '') AS issues,
                 string_agg(tag || replace(recommendations, ' | ', ' | ' || tag), ' | ' ORDER BY table_name) AS recommendations
          FROM tagged GROUP BY dimension"""),
    ),
    "selected_tables_metrics": (selected, _selected_sql()),
    "overall_quality": (
        lambda spark, sf: metrics(spark, sf).select("table_name", F.round(d.overall_quality(), 2).alias("overall_quality")),
        sql("SELECT table_name, round((completeness + uniqueness + cardinality + consistency + volumetry) / 5, 2) AS overall_quality FROM dtabs"),
    ),
    "risk_level": (
        lambda spark, sf: d.with_risk(metrics(spark, sf)).select("table_name", "overall_quality", "risk_level", "risk_percentage"),
        sql("""SELECT table_name, round(q, 2) AS overall_quality, CASE WHEN q >= 80 THEN 'Low' WHEN q >= 60 THEN 'Medium' ELSE 'High' END AS risk_level,
                      round(greatest(0e0, 1e2 - q), 2) AS risk_percentage
               FROM (SELECT table_name, (completeness + uniqueness + cardinality + consistency + volumetry) / 5 AS q FROM dtabs) x"""),
    ),
    "union_tables": (
        union_query,
        """SELECT o_orderkey, o_totalprice AS amount, CAST(NULL AS BIGINT) AS c_custkey, 'orders' AS _source_table FROM orders
           UNION ALL SELECT NULL, CAST(c_nationkey AS DOUBLE), c_custkey, 'customer' FROM customer""",
    ),
    "filter_source_tables": (
        filtered, "SELECT o_orderkey, o_totalprice AS amount, CAST(NULL AS BIGINT) AS c_custkey FROM orders"
    ),
    "select_tables": (
        select_tables,
        "WITH c AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS record_count FROM {t}" for t in RELATIONAL) + """),
        s AS (SELECT * FROM c WHERE (contains(lower(table_name), 'er') OR table_name = 'region') AND table_name <> 'supplier')
        SELECT table_name, record_count, CAST((SELECT sum(record_count) FROM s) AS BIGINT) AS selected_records FROM s""",
    ),
    "select_by_dtype": (by_dtype("numeric"), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"),
    "select_by_dtype_categorical": (by_dtype("categorical"), "SELECT o_orderstatus, o_orderpriority FROM orders"),
    "select_by_dtype_datetime": (by_dtype("datetime"), "SELECT o_orderdate FROM orders"),
    "limit_rows": (limit_rows, "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000"),
    "sample_rows": (sample, "SELECT * FROM events ORDER BY ts, event_id LIMIT 100"),
    "sample_tables": (
        sample_tables,
        """SELECT 'nation' AS table_name, name FROM (SELECT n_name AS name FROM nation ORDER BY n_nationkey LIMIT 5)
           UNION ALL SELECT 'region', name FROM (SELECT r_name AS name FROM region ORDER BY r_regionkey LIMIT 5)
           UNION ALL SELECT 'part', name FROM (SELECT p_name AS name FROM part ORDER BY p_partkey LIMIT 5)""",
    ),
    "sample_values": (
        sample_values,
        with_views(
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, string_agg(CAST({c} AS VARCHAR), ' | ' ORDER BY ts, event_id) AS samples FROM (SELECT * FROM dirty_events WHERE {c} IS NOT NULL ORDER BY ts, event_id LIMIT 3) x"
                for c, _ in COLUMNS["dirty_events"]
            ),
            "dirty_events",
        ),
    ),
    "last_n_points": (last_points, "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20"),
    "distinct_rows": (distinct_rows, with_views("SELECT DISTINCT * FROM dirty_customer", "dirty_customer")),
    "json_safe": (json_safe(False), with_views(f"SELECT event_id, {_INF.format('NULL', 'value')} FROM dirty_events", "dirty_events")),
    "json_safe_legacy": (
        json_safe(True), with_views(f"SELECT event_id, {_INF.format('0e0', 'coalesce(value, 0e0)')} FROM dirty_events", "dirty_events")
    ),
    "update_row": (
        update_row,
        """SELECT c_custkey, c_name, c_nationkey,
                  CASE WHEN c_nationkey = 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 12.5e0 END ELSE c_acctbal END AS c_acctbal,
                  CASE WHEN c_nationkey = 5 THEN 'EDITED' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
    ),
    "table_preview": (
        table_preview,
        with_views(
            f"""SELECT column_name, row_count AS total_rows, non_null, null_count, unique_count, round(min_value, 6) AS min_value,
                round(max_value, 6) AS max_value, round(mean_value, 6) AS mean_value FROM ({scored_sql('dirty_customer')}) s""",
            "dirty_customer",
        ),
    ),
    "sort_by_time": (sort_by_time, with_views("SELECT * FROM daily_orders ORDER BY d", "daily_orders")),
}
