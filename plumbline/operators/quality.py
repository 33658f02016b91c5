"""Quality scores: completeness, validity, consistency, uniqueness, accuracy."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.schema import is_text, normalize, numeric_names, sql_name, sql_text
from ..functions.values import NUMBER_PATTERN
from ..plans.profile import beyond_fences, column_profile, measured
from ..plans.quantiles import union_all

DIMENSIONS = ("completeness", "validity", "consistency", "uniqueness", "accuracy")

# Weight of each dimension in the quality score of a table.
WEIGHTS = {
    "completeness": 0.25,
    "validity": 0.20,
    "consistency": 0.20,
    "uniqueness": 0.15,
    "accuracy": 0.20,
}


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def score_columns(df: DataFrame, table_name: str, approx: bool = False) -> DataFrame:
    """Facts and the five scores of every column of one table."""
    df = normalize(df)
    facts, bounds = measured(df, approx)
    text = [f.name for f in df.schema if is_text(f.dataType)]
    fenced = [name for name, b in bounds.items() if b]
    rows, present = F.col("row_count"), F.col("non_null")
    some = rows > 0
    return facts.select(
        F.lit(table_name).alias("table_name"),
        "*",
        _percent(present, rows).alias("completeness"),
        F.when(~some, 0.0)
        .when(F.col("column_name").isin(text) & F.col("all_numbers"), 95.0)
        .otherwise(100.0)
        .alias("validity"),
        _percent(present, rows).alias("consistency"),
        F.least(F.lit(100.0), _percent(F.col("unique_count"), present)).alias("uniqueness"),
        F.when(~some, 0.0)
        .when(
            F.col("column_name").isin(fenced) & (present > 0),
            100.0 - _percent(F.col("outliers"), present),
        )
        .otherwise(100.0)
        .alias("accuracy"),
    )


def score_tables(tables: Mapping[str, DataFrame], approx: bool = False, parallel: int = 8) -> DataFrame:
    """``score_columns`` of several tables, whose fences are fitted side by side."""
    with ThreadPoolExecutor(parallel) as pool:
        return union_all(list(pool.map(lambda t: score_columns(tables[t], t, approx), tables)))


COLUMN_FIELDS = (
    "table_name", "position", "column_name", "data_type", *DIMENSIONS, "null_count", "unique_count", "min_value",
    "max_value", "mean_value",
)


def column_metrics(df: DataFrame, table_name: str, approx: bool = False) -> DataFrame:
    """One row per column: type, five scores, null and distinct counts, range."""
    return score_columns(df, table_name, approx).select(*COLUMN_FIELDS)


def _per_column(df: DataFrame, table_name: str, fact, score) -> DataFrame:
    """One aggregation over the table, then one row per column.

    ``fact`` and ``score`` give SQL text: plans for many columns build faster so.
    """
    facts = ["count(1) AS n"]
    rows = []
    for i, f in enumerate(df.schema):
        facts += [f"count({sql_name(f.name)}) AS p{i}", f"{fact(f)} AS x{i}"]
        rows.append(f"named_struct('column_name', {sql_text(f.name)}, 'score', {score(f, f'p{i}', f'x{i}')})")
    counted = df.agg(*[F.expr(x) for x in facts])
    return counted.selectExpr(f"{sql_text(table_name)} AS table_name", f"inline(array({', '.join(rows)}))")


def completeness(df: DataFrame, table_name: str) -> DataFrame:
    """Share of values that are present, per column; one scan, nothing shuffled."""
    share = lambda f, p, x: f"coalesce(try_divide({p} * 100D, n), 0D)"
    return _per_column(normalize(df), table_name, lambda f: "0", share)


consistency = completeness


def validity(df: DataFrame, table_name: str) -> DataFrame:
    """95 for text columns that hold only numbers, 100 for all others."""
    fact = lambda f: f"bool_and({sql_name(f.name)} RLIKE r'{NUMBER_PATTERN}')" if is_text(f.dataType) else "false"
    numbers = lambda f, x: f"coalesce({x}, true)" if is_text(f.dataType) else "false"
    score = lambda f, p, x: f"CASE WHEN n = 0 THEN 0D WHEN {numbers(f, x)} THEN 95D ELSE 100D END"
    return _per_column(df, table_name, fact, score)


def uniqueness(df: DataFrame, table_name: str, approx: bool = False) -> DataFrame:
    """Distinct values per present value, per column."""
    score = F.least(F.lit(100.0), _percent(F.col("unique_count"), F.col("non_null")))
    return column_profile(normalize(df), approx=approx).select(
        F.lit(table_name).alias("table_name"), "column_name", score.alias("score")
    )


def accuracy_iqr(df: DataFrame, table_name: str, factor: float = 1.5, approx: bool = False) -> DataFrame:
    """Share of present values inside the Tukey fences; 100 for other types."""
    df = normalize(df)
    numeric = numeric_names(df)
    if approx:
        facts, fences = measured(df, approx, factor, columns=numeric)
        found = facts.collect()  # one row a column
        rows = found[0].row_count if found else df.count()
        beyond = {r.column_name: (r.non_null, r.outliers) for r in found if fences.get(r.column_name)}
    else:
        rows, beyond = beyond_fences(df, numeric, factor)

    def score(name: str) -> float:
        if not rows:
            return 0.0
        present, outliers = beyond.get(name, (0, 0))
        return 100.0 - (outliers * 100.0 / present if present else 0.0)

    scored = [(table_name, name, score(name)) for name in df.columns]
    return df.sparkSession.createDataFrame(scored, "table_name string, column_name string, score double")


def quality_score() -> Column:
    return sum((F.col(d) * w for d, w in WEIGHTS.items()), F.lit(0.0))


def table_metrics(df: DataFrame, table_name: str, approx: bool = False) -> DataFrame:
    """One row: each dimension averaged over columns, and the weighted score."""
    return fold_columns(score_columns(df, table_name, approx))


def fold_columns(scored: DataFrame) -> DataFrame:
    """Scored columns folded to one row per table."""
    return (
        scored.groupBy("table_name")
        .agg(
            F.max("row_count").alias("total_rows"),
            F.count(F.lit(1)).alias("total_columns"),
            *[F.avg(d).alias(d) for d in DIMENSIONS],
        )
        .withColumn("quality_score", quality_score())
    )


_TABLE_FIELDS = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("total_columns", T.LongType()),
        *[T.StructField(d, T.DoubleType()) for d in DIMENSIONS],
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)


def each_table(
    tables: Mapping[str, DataFrame | Callable[[], DataFrame]],
    work: Callable[[DataFrame, str], T.Row],
    failed: Callable[[str, Exception], tuple],
    parallel: int = 8,
) -> list:
    """Run ``work`` per table, several tables at a time; a failure stays its own.

    ``work`` returns one small row, so the driver holds one row per table.
    """

    def one(name: str):
        try:
            source = tables[name]
            return tuple(work(source() if callable(source) else source, name))
        except Exception as problem:  # noqa: BLE001 - any failure becomes a row
            return failed(name, problem)

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(one, tables))


def dataset_metrics(
    spark: SparkSession,
    tables: Mapping[str, DataFrame | Callable[[], DataFrame]],
    approx: bool = False,
    parallel: int = 8,
) -> DataFrame:
    """One row per table; a table that cannot be read gets score 0 and its error."""
    rows = each_table(
        tables,
        lambda df, name: (*table_metrics(df, name, approx).first(), None),
        lambda name, problem: (name, None, None, *[None] * len(DIMENSIONS), 0.0, type(problem).__name__),
        parallel,
    )
    return spark.createDataFrame(rows, _TABLE_FIELDS)


def dataset_summary(tables: DataFrame) -> DataFrame:
    """Mean score of the tables that succeeded, with counts of all and analyzed."""
    good = F.col("error").isNull()
    return tables.agg(
        F.coalesce(F.avg(F.when(good, F.col("quality_score"))), F.lit(0.0)).alias("overall_quality_score"),
        F.count(F.lit(1)).alias("total_tables"),
        F.count_if(good).alias("analyzed_tables"),
    )


def combined_metrics(tables: DataFrame, mapping: str = "api") -> DataFrame:
    """Dimension means over tables under the names that dashboards use.

    ``api``: cardinality is accuracy and volumetry the overall score, all tables
    without error.  ``ui``: cardinality is validity and volumetry is accuracy,
    tables with a score above zero, rounded.
    """
    good = tables.where(F.col("error").isNull())
    names = {"completeness": "completeness", "uniqueness": "uniqueness", "consistency": "consistency"}
    if mapping == "api":
        names |= {"cardinality": "accuracy", "volumetry": "quality_score"}
        wrap = lambda c: F.coalesce(c, F.lit(0.0))
    else:
        good = good.where(F.col("quality_score") > 0)
        names |= {"cardinality": "validity", "volumetry": "accuracy"}
        wrap = lambda c: F.coalesce(F.round(c), F.lit(0.0))
    return good.agg(
        *[wrap(F.avg(source)).alias(name) for name, source in names.items()],
        F.count(F.lit(1)).alias("tables"),
    )


def column_quality_ui(columns: DataFrame) -> DataFrame:
    """Plain mean of completeness, uniqueness and consistency per column."""
    score = (F.col("completeness") + F.col("uniqueness") + F.col("consistency")) / 3
    return columns.select("table_name", "column_name", score.alias("column_quality"))


def score_band(score: Column) -> Column:
    return (
        F.when(score >= 90, "Excellent").when(score >= 70, "Good").otherwise("Needs Attention")
    )


# Issue texts per dimension, most important first.
ISSUES = {
    "completeness": [
        "Missing values detected in critical fields",
        "Incomplete records affecting data reliability",
        "Data collection gaps identified",
    ],
    "uniqueness": [
        "Duplicate records found in dataset",
        "Primary key violations detected",
        "Data redundancy affecting storage efficiency",
    ],
    "cardinality": [
        "Invalid data formats detected",
        "Data type mismatches found",
        "Constraint violations in database fields",
    ],
    "consistency": [
        "Inconsistent data formats across tables",
        "Naming convention violations found",
        "Cross-reference integrity issues detected",
    ],
    "volumetry": [
        "Data accuracy below acceptable thresholds",
        "Quality degradation trends observed",
        "Measurement precision issues identified",
    ],
}

# Advice per dimension for a good and for a poor score.
ADVICE = {
    "completeness": {
        "good": [
            "Data completeness is excellent",
            "Maintain current data collection standards",
            "Consider this as a best practice example",
        ],
        "poor": [
            "Review data collection processes",
            "Implement data validation at source",
            "Set up automated data quality checks",
            "Train data entry personnel on completeness requirements",
        ],
    },
    "uniqueness": {
        "good": [
            "Uniqueness levels are acceptable",
            "Continue monitoring for duplicate prevention",
            "Data integrity is well maintained",
        ],
        "poor": [
            "Remove duplicate entries",
            "Implement unique constraints in database",
            "Review data merge processes",
            "Set up duplicate detection algorithms",
        ],
    },
    "cardinality": {
        "good": [
            "Data validity is good",
            "Current validation rules are effective",
            "Data types and formats are consistent",
        ],
        "poor": [
            "Validate data inputs",
            "Review data type constraints",
            "Implement field validation rules",
            "Check for outliers and invalid values",
        ],
    },
    "consistency": {
        "good": [
            "Data consistency is maintained",
            "Formatting standards are being followed",
            "Cross-table relationships are valid",
        ],
        "poor": [
            "Standardize data formats",
            "Implement consistent naming conventions",
            "Review data transformation processes",
            "Establish data governance policies",
        ],
    },
    "volumetry": {
        "good": [
            "Data accuracy is high",
            "Current quality controls are effective",
            "Data meets accuracy standards",
        ],
        "poor": [
            "Improve data accuracy",
            "Implement accuracy measurement tools",
            "Review data sources for reliability",
            "Set up data quality monitoring dashboards",
        ],
    },
}


def score_issues(scores: DataFrame) -> DataFrame:
    """Adds ``issues`` and ``recommendations`` to rows of (dimension, score)."""
    texts = lambda items: F.array(*[F.lit(t) for t in items])
    table = lambda pick: F.create_map(
        *[x for d in ISSUES for x in (F.lit(d), texts(pick(d)))]
    )
    score = F.col("score")
    many = F.when(score >= 90, 0).when(score >= 85, 1).when(score >= 70, 2).otherwise(3)
    look = lambda pick: F.coalesce(
        F.try_element_at(table(pick), F.col("dimension")), texts(pick("completeness"))
    )
    return scores.select(
        "*",
        F.slice(look(lambda d: ISSUES[d]), F.lit(1), many).alias("issues"),
        F.when(score >= 80, look(lambda d: ADVICE[d]["good"]))
        .otherwise(look(lambda d: ADVICE[d]["poor"]))
        .alias("recommendations"),
    )


def rule_compliance(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Pass rate of user rules given as SQL predicates; null counts as a failure."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.expr(p)).alias(f"r{i}") for i, p in enumerate(rules.values())],
    )
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("rule"),
                        F.col("n").alias("rows_checked"),
                        F.col(f"r{i}").alias("rows_passed"),
                        F.try_divide(F.col(f"r{i}") * 100.0, F.col("n")).alias("pass_rate"),
                    )
                    for i, name in enumerate(rules)
                ]
            )
        )
    )
