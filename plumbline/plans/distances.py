"""Distances between the distributions of two tables' columns, from counts of their values in order.

Both tables are folded to one count per column and value, so a value that fills a third of a table is one row a task.
The merged counts are range-partitioned on (column, value) and written; each range adds up its own counts, and what came
before it and the first value behind it are one row per range and column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.schema import quoted
from .materialize import discard, fresh_path


def _folded(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    cells = [F.struct(F.lit(i).alias("c"), (quoted(c).cast("double") + F.lit(0.0)).alias("v")) for i, c in enumerate(columns)]
    rows = df.select(F.inline(F.array(*cells))).where("v IS NOT NULL AND NOT isnan(v)")
    counted = rows.groupBy("c", "v").agg(F.count(F.lit(1)).alias(side))
    return counted.withColumn("b" if side == "a" else "a", F.lit(0).cast("bigint"))


def distribution_distances(before: DataFrame, after: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Kolmogorov-Smirnov and Wasserstein distance of each numeric column's values in two tables.

    The first is the largest difference of the two distribution functions, the second the area between them, in the
    column's unit. Nulls and NaN are no values; without a value on one side both are null. Infinite values count for
    the first and give an infinite or no second.
    """
    if not columns:
        return {}
    spark = before.sparkSession
    merged = _folded(before, columns, "a").unionByName(_folded(after, columns, "b")).groupBy("c", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    path = fresh_path(spark, "distributions")
    merged.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    sums = stored.groupBy("c", "part").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.min("v").alias("first"))
    order = Window.partitionBy("c").orderBy("part")
    earlier, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("c")
    # A column is in few ranges and a range in few columns: as many rows as ranges and columns together.
    around = sums.select(
        F.col("c").alias("_c"), F.col("part").alias("_part"), F.lead("first").over(order).alias("behind"),
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_before") for s in ("sa", "sb")],
        *[F.sum(s).over(every).alias(f"{s}_all") for s in ("sa", "sb")],
    )
    rows = stored.join(F.broadcast(around), (F.col("c") == F.col("_c")) & (F.col("part") == F.col("_part")))
    inside = Window.partitionBy("c", "part").orderBy("v")
    share = lambda s, n: (F.sum(s).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"{n}_before")) / F.nullif(F.col(f"{n}_all"), F.lit(0))
    gap = rows.select("c", "v", F.abs(share("a", "sa") - share("b", "sb")).alias("gap"), F.coalesce(F.lead("v").over(inside), F.col("behind")).alias("next"))
    area = F.when(F.col("gap") == 0, 0.0).otherwise(F.col("gap") * (F.col("next") - F.col("v")))
    found = gap.groupBy("c").agg(F.max("gap").alias("ks"), F.sum(area).alias("area"), F.max(F.col("gap").isNotNull()).alias("both"), F.count("*").alias("n"))
    out = dict.fromkeys(columns, (None, None))
    for r in found.collect():
        if r.both:
            out[columns[r.c]] = (r.ks, 0.0 if r.n == 1 else r.area)
    discard(spark, path)
    return out
