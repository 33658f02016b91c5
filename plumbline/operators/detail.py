"""Detailed scoring: cells, rows, cardinality, letter case and volume."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.schema import is_datetime, is_text, normalize
from ..plans.profile import column_profile, row_repeats
from .rows import union_tables

DETAIL_DIMENSIONS = ("completeness", "uniqueness", "cardinality", "consistency", "volumetry")

# Advice given with every dimension, and for a table without rows.
DETAIL_ADVICE = {
    "completeness": [
        "Implement data validation at source",
        "Add required field constraints",
        "Monitor data completeness over time",
    ],
    "uniqueness": [
        "Add unique constraints to key fields",
        "Implement deduplication process",
        "Monitor for duplicate entries",
    ],
    "cardinality": [
        "Standardize categorical values",
        "Review high-cardinality fields",
        "Consider data normalization",
    ],
    "consistency": [
        "Standardize data formats",
        "Implement format validation",
        "Create data quality rules",
    ],
    "volumetry": [
        "Monitor data volume trends",
        "Set up data volume alerts",
        "Plan for data growth",
    ],
}
NO_DATA_ISSUE = "No data available for analysis"
NO_ROWS_ISSUE = "No data records found"


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def percent_text(value: Column) -> Column:
    return F.format_string("%.1f", F.bround(value, 1))


def detail_columns(df: DataFrame, table_name: str, approx: bool = False) -> DataFrame:
    """Per column: missing cells, unique share, cardinality and case scores."""
    df = normalize(df)
    text = [f.name for f in df.schema if is_text(f.dataType)]
    dates = [f.name for f in df.schema if is_datetime(f.dataType)]
    name, rows = F.col("column_name"), F.col("row_count")
    unique, present = F.col("unique_count"), F.col("non_null")
    repeats = rows - unique - (F.col("null_count") > 0).cast("int")
    share = F.try_divide(unique, rows)
    case_broken = F.col("mixed_case") > present * 0.1
    return column_profile(df, approx=approx).select(
        F.lit(table_name).alias("table_name"), "position", "column_name", "data_type", "row_count",
        F.col("null_count").alias("missing"),
        _ratio(F.col("null_count"), rows).alias("missing_pct"),
        unique.alias("unique_count"),
        repeats.alias("repeats"),
        F.bround(_ratio(rows - repeats, rows), 1).alias("unique_pct"),
        _ratio(repeats, rows).alias("repeat_pct"),
        F.when(share < 0.01, "Low").when(share > 0.95, "High").alias("cardinality_flag"),
        F.when(share < 0.01, 60.0).when(share > 0.95, 70.0).when(share.isNotNull(), 85.0).alias("cardinality_score"),
        (name.isin(text) & (present > 0) & case_broken).alias("mixed_case"),
        F.when(name.isin(text), F.when(present == 0, 0.0).when(case_broken, 70.0).otherwise(90.0))
        .when(name.isin(dates), 85.0)
        .otherwise(90.0)
        .alias("consistency_score"),
    )


def volumetry_score(rows: Column, columns: Column) -> Column:
    base = F.when(rows < 100, 70.0).otherwise(95.0)
    cut = F.when(columns < 2, 10.0).when(columns > 100, 5.0).otherwise(0.0)
    return F.when(rows == 0, 0.0).otherwise(base - cut)


def _table_facts(df: DataFrame, table_name: str, approx: bool) -> DataFrame:
    """One row: column facts folded to scores and ordered issue texts."""
    cols = detail_columns(df, table_name, approx)
    name = F.col("column_name")
    quoted_name = F.concat(F.lit("'"), name, F.lit("'"))
    listed = lambda when, order, text: F.transform(
        F.array_sort(F.collect_list(F.when(when, F.struct(order.alias("o"), F.col("position"), text.alias("t"))))),
        lambda x: x["t"],
    )
    position = F.col("position")
    folded = cols.groupBy("table_name").agg(
        F.max("row_count").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.sum("missing").alias("total_missing"),
        F.avg("cardinality_score").alias("cardinality"),
        F.avg("consistency_score").alias("consistency"),
        listed(
            F.col("missing") > 0, -F.col("missing"),
            F.concat(F.lit("Missing values in "), quoted_name, F.lit(" field ("), percent_text(F.col("missing_pct")), F.lit("%)")),
        ).alias("completeness_issues"),
        listed(
            F.col("repeats") > 0, position,
            F.concat(F.lit("Duplicate values in "), quoted_name, F.lit(" ("), percent_text(F.col("repeat_pct")), F.lit("%)")),
        ).alias("uniqueness_issues"),
        listed(
            F.col("cardinality_flag").isNotNull(), position,
            F.concat(
                F.col("cardinality_flag"), F.lit(" cardinality in "), quoted_name, F.lit(" field ("),
                F.col("unique_count").cast("string"), F.lit(" unique values)"),
            ),
        ).alias("cardinality_issues"),
        listed(
            F.col("mixed_case"), position,
            F.concat(F.lit("Mixed case values in "), quoted_name, F.lit(" field")),
        ).alias("consistency_issues"),
        F.map_from_entries(F.collect_list(F.struct("column_name", "missing"))).alias("missing_by_column"),
        F.map_from_entries(F.collect_list(F.struct("column_name", "unique_pct"))).alias("uniqueness_by_column"),
        F.map_from_entries(F.collect_list(F.struct("column_name", "unique_count"))).alias("column_cardinalities"),
        F.map_from_entries(F.collect_list(F.struct("column_name", "data_type"))).alias("data_types"),
    )
    repeats = row_repeats(normalize(df)).select(F.lit(table_name).alias("table_name"), "duplicate_rows")
    both = folded.join(F.broadcast(repeats), "table_name")
    rows, cells = F.col("total_rows"), F.col("total_rows") * F.col("total_columns")
    some = rows > 0
    return both.select(
        "*",
        _ratio(cells - F.col("total_missing"), cells).alias("completeness"),
        _ratio(rows - F.col("duplicate_rows"), rows).alias("uniqueness"),
        volumetry_score(rows, F.col("total_columns")).alias("volumetry"),
    ).withColumns(
        {
            "cardinality": F.when(some, F.coalesce("cardinality", F.lit(80.0))).otherwise(0.0),
            "consistency": F.when(some, F.coalesce("consistency", F.lit(85.0))).otherwise(0.0),
        }
    )


def detail_metrics(df: DataFrame, table_name: str, approx: bool = False) -> DataFrame:
    """One row per table: the five detailed scores and the counts behind them."""
    return _table_facts(df, table_name, approx).select(
        "table_name", "total_rows", "total_columns", *DETAIL_DIMENSIONS, "total_missing", "duplicate_rows"
    )


def detailed_analysis(df: DataFrame, table_name: str, approx: bool = False) -> DataFrame:
    """One row per dimension: score, the first issues, and recommendations."""
    facts = _table_facts(df, table_name, approx)
    rows, columns = F.col("total_rows"), F.col("total_columns")
    volume = F.array_compact(
        F.array(
            F.when(rows < 100, F.concat(F.lit("Low data volume ("), rows.cast("string"), F.lit(" records)"))),
            F.when(columns < 2, F.lit("Very few columns for analysis")).when(
                columns > 100, F.concat(F.lit("Large number of columns ("), columns.cast("string"), F.lit(")"))
            ),
        )
    )
    details = {
        "completeness": "missing_by_column", "uniqueness": "uniqueness_by_column",
        "cardinality": "column_cardinalities", "consistency": "data_types",
    }
    text_map = lambda c: F.transform_values(F.col(c), lambda _, v: v.cast("string"))
    parts = []
    for d in DETAIL_DIMENSIONS:
        found = volume if d == "volumetry" else F.slice(F.col(f"{d}_issues"), 1, 3)
        nothing = F.array(F.lit(NO_ROWS_ISSUE if d == "volumetry" else NO_DATA_ISSUE))
        by_column = text_map(details[d]) if d in details else F.create_map(
            F.lit("total_rows"), rows.cast("string"), F.lit("total_columns"), columns.cast("string")
        )
        parts.append(
            F.struct(
                F.lit(d).alias("dimension"),
                F.col(d).alias("score"),
                F.when(rows == 0, nothing).otherwise(found).alias("issues"),
                F.array(*[F.lit(t) for t in DETAIL_ADVICE[d]]).alias("recommendations"),
                by_column.alias("details"),
            )
        )
    return facts.select("table_name", F.inline(F.array(*parts)))


def top_missing_columns(columns: DataFrame, n: int = 5) -> DataFrame:
    """Columns with most missing cells; ties keep schema order."""
    return (
        columns.where("missing > 0")
        .orderBy(F.desc("missing"), "table_name", "position")
        .limit(n)
        .select("table_name", "column_name", "missing", "missing_pct")
    )


def dataset_weighted(metrics: DataFrame) -> DataFrame:
    """Means of the five scores over tables, weighted by rows; empty ones left out."""
    rows = F.col("total_rows")
    return metrics.where(rows > 0).agg(
        *[F.round(F.sum(F.col(d) * rows) / F.sum(rows), 2).alias(d) for d in DETAIL_DIMENSIONS],
        F.sum(rows).alias("total_rows"),
        F.count(F.lit(1)).alias("tables"),
    )


def dataset_issues(analyses: DataFrame) -> DataFrame:
    """Issues and recommendations of all tables, tagged and joined per dimension."""
    tag = F.concat(F.lit("["), F.col("table_name"), F.lit("] "))
    merged = lambda c: F.flatten(
        F.transform(F.array_sort(F.collect_list(F.struct("table_name", c))), lambda x: x[c])
    )
    tagged = analyses.select(
        "table_name", "dimension",
        F.transform("issues", lambda t: F.concat(tag, t)).alias("issues"),
        F.transform("recommendations", lambda t: F.concat(tag, t)).alias("recommendations"),
    )
    return tagged.groupBy("dimension").agg(
        merged("issues").alias("issues"), merged("recommendations").alias("recommendations")
    )


def selected_tables_metrics(tables: Mapping[str, DataFrame], selected: list[str]) -> DataFrame:
    """Score the union of the selected tables, tag column included."""
    unknown = [t for t in selected if t not in tables]
    if unknown:
        raise ValueError(f"unknown tables: {', '.join(unknown)}")
    return detail_metrics(union_tables({t: tables[t] for t in selected}), "+".join(selected))


def overall_quality() -> Column:
    return sum((F.col(d) for d in DETAIL_DIMENSIONS), F.lit(0.0)) / len(DETAIL_DIMENSIONS)


def risk_level(quality: Column) -> Column:
    return (
        F.when(quality >= 80, "Low")
        .when(quality >= 60, "Medium")
        .when(quality.isNotNull(), "High")
        .otherwise("Unknown")
    )


def risk_percentage(quality: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 100.0 - quality), 2)


def with_risk(metrics: DataFrame) -> DataFrame:
    quality = overall_quality()
    return metrics.select(
        "*",
        F.round(quality, 2).alias("overall_quality"),
        risk_level(quality).alias("risk_level"),
        F.coalesce(risk_percentage(quality), F.lit(0.0)).alias("risk_percentage"),
    )
