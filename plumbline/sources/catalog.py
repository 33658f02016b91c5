"""Facts about tables in a source: counts, statistics, previews, column lists."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.schema import normalize
from ..operators.quality import each_table
from ..operators.rows import first_rows, sample_values
from ..plans.profile import column_profile

Source = DataFrame | Callable[[], DataFrame]


def table_row_counts(spark: SparkSession, tables: Mapping[str, Source], parallel: int = 8) -> DataFrame:
    """Rows per table; a table that cannot be counted has a null count and its error."""
    rows = each_table(
        tables,
        lambda df, name: (name, df.count(), None),
        lambda name, problem: (name, None, type(problem).__name__),
        parallel,
    )
    return spark.createDataFrame(rows, "table_name string, record_count long, error string")


def total_rows(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("total_records"), F.count(F.lit(1)).alias("tables")
    )


def table_statistics(
    df: DataFrame, table_name: str, order_by: list[str], analyzed: bool | None = None
) -> tuple[DataFrame, DataFrame]:
    """Per column: type, present values of the whole table, three samples; and five rows."""
    df = normalize(df)
    counted = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"p{i}") for i, c in enumerate(df.columns)]
    ).select(
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                        F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"p{i}").alias("non_null"),
                    )
                    for i, f in enumerate(df.schema)
                ]
            )
        ),
    )
    samples = sample_values(df, order_by).select("position", "samples")
    facts = counted.join(F.broadcast(samples), "position").select(
        F.lit(table_name).alias("table_name"), F.col("n").alias("total_rows"),
        F.lit(len(df.columns)).alias("total_columns"), "position", "column_name", "data_type", "non_null", "samples",
        *([] if analyzed is None else [F.lit(analyzed).alias("is_analyzed")]),
    )
    return facts, first_rows(df, order_by, 5)


def table_preview(df: DataFrame, order_by: list[str], n: int = 20) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows, and per column its counts and range."""
    df = normalize(df)
    facts = column_profile(df).select(
        "column_name", F.col("row_count").alias("total_rows"), "non_null", "null_count", "unique_count",
        "min_value", "max_value", "mean_value",
    )
    return first_rows(df, order_by, n), facts


def column_catalog(
    spark: SparkSession, tables: Mapping[str, tuple[Source, list[str]]], parallel: int = 8
) -> DataFrame:
    """Table, column, type, null and distinct counts, samples cut to 100 characters.

    A table that fails has one row that says so.  A catalog row is small and
    there is one per column, so they are gathered to keep failures apart.
    """
    schema = (
        "table_name string, column_name string, data_type string, null_count long, "
        "unique_count long, sample_values string"
    )

    def rows(pair, name):
        df = normalize(pair)
        order = tables[name][1]
        facts = column_profile(df).select("position", "column_name", "data_type", "null_count", "unique_count")
        text = F.substring(F.concat(F.lit("["), F.array_join("samples", ", "), F.lit("]")), 1, 100)
        both = facts.join(F.broadcast(sample_values(df, order).select("position", text.alias("sample_values"))), "position")
        return [
            (name, r.column_name, r.data_type, r.null_count, r.unique_count, r.sample_values)
            for r in both.orderBy("position").collect()
        ]

    failed = lambda name, problem: [(name, "ERROR", type(problem).__name__, None, None, None)]
    gathered = each_table({t: s for t, (s, _) in tables.items()}, rows, failed, parallel)
    return spark.createDataFrame([r for group in gathered for r in group], schema)
