"""Row order on a distributed table.

A window without partitions, or over one hot key, would run in one task.  Here
every row first gets its position within its key.  Groups of a checked size get
it from a plain window; larger ones are range-partitioned on key and order, so
that a hot key spreads over many tasks, and positions are the row numbers inside
a range plus the count of rows before it.

Positions cut each key into buckets of equal size.  Look-back and look-ahead run
inside a bucket after the rows at its edge are copied into the buckets beside it;
fills carry the last value of the earlier buckets over.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.schema import quoted
from .materialize import materialize

POSITION = "_pos"
BUCKET = "_bucket"
WINDOW_ROWS = 2_000_000
BUCKET_ROWS = 1_000_000


@dataclass(frozen=True)
class OrderedRows:
    """Rows with ``_pos``, their place within ``keys``, counted from zero."""

    df: DataFrame
    keys: tuple[str, ...]
    largest: int
    bucket_rows: int

    @property
    def one_bucket(self) -> bool:
        return self.largest <= self.bucket_rows

    def window(self, backward: bool = False) -> WindowSpec:
        order = F.col(POSITION).desc() if backward else F.col(POSITION)
        keys = [quoted(k) for k in self.keys] or [F.lit(0)]
        if not self.one_bucket:
            keys.append(F.col(BUCKET))
        return Window.partitionBy(*keys).orderBy(order)

    def with_df(self, df: DataFrame) -> "OrderedRows":
        return replace(self, df=df)

    def rows(self) -> DataFrame:
        return self.df.drop(POSITION)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    if not keys:
        return df.count()
    counts = df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _range_positions(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    key_columns = [quoted(k) for k in keys]
    order = [quoted(c) for c in order_by]
    ranged = df.repartitionByRange(*key_columns, *order).withColumn("_chunk", F.spark_partition_id())
    # Written once: the chunk numbers must not change if a task runs again.
    chunks = materialize(ranged, "ordered")
    counts = chunks.groupBy(*key_columns, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*(key_columns or [F.lit(0)])).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # A key is continued in a chunk only at the chunk's edge, so there is at
    # most one such row per chunk, however many keys there are.
    offsets = (
        counts.withColumn("_before", F.sum("_n").over(earlier))
        .where("_before IS NOT NULL")
        .select(
            F.col("_chunk").alias("_c"), "_before", *[quoted(k).alias(f"_o{i}") for i, k in enumerate(keys)]
        )
    )
    same = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & quoted(k).eqNullSafe(F.col(f"_o{i}"))
    inside = Window.partitionBy(*key_columns, "_chunk").orderBy(*order)
    position = F.row_number().over(inside) - 1 + F.coalesce("_before", F.lit(0))
    return chunks.join(F.broadcast(offsets), same, "left").select(
        *[quoted(c) for c in df.columns], position.cast("long").alias(POSITION)
    )


def ordered(
    df: DataFrame,
    order_by: list[str],
    keys: list[str] | None = None,
    window_rows: int = WINDOW_ROWS,
    bucket_rows: int = BUCKET_ROWS,
) -> OrderedRows:
    """Number the rows of every key.  ``order_by`` must order them totally."""
    keys = list(keys or [])
    largest = largest_group(df, keys)
    if largest <= window_rows:
        window = Window.partitionBy(*([quoted(k) for k in keys] or [F.lit(0)])).orderBy(
            *[quoted(c) for c in order_by]
        )
        placed = df.withColumn(POSITION, (F.row_number().over(window) - 1).cast("long"))
    else:
        placed = _range_positions(df, keys, order_by)
    return OrderedRows(placed, tuple(keys), largest, bucket_rows)


def slide(
    rows: OrderedRows,
    columns: dict[str, Callable[[WindowSpec], Column]],
    back: int = 0,
    ahead: int = 0,
) -> OrderedRows:
    """Add windowed columns that look at most ``back`` and ``ahead`` rows away."""
    if rows.one_bucket:
        return rows.with_df(rows.df.withColumns({n: f(rows.window()) for n, f in columns.items()}))
    size = rows.bucket_rows
    bucket_of = lambda position: F.floor(position / size).cast("long")
    own = bucket_of(F.col(POSITION))
    # A row goes to every bucket that looks at it; windows longer than a bucket reach several.
    homes = F.sequence(F.greatest(F.lit(0), bucket_of(F.col(POSITION) - ahead)), bucket_of(F.col(POSITION) + back))
    spread = rows.df.withColumn(BUCKET, F.explode(homes))
    added = spread.withColumns({n: f(rows.window()) for n, f in columns.items()})
    return rows.with_df(added.where(F.col(BUCKET) == own).drop(BUCKET))


def carry(rows: OrderedRows, columns: dict[str, Column], backward: bool = False) -> OrderedRows:
    """Per output name, the nearest non-null value at or before (after) each row."""
    upto = rows.window(backward).rowsBetween(Window.unboundedPreceding, 0)
    near = {n: F.last(c, ignorenulls=True) for n, c in columns.items()}
    if rows.one_bucket:
        return rows.with_df(rows.df.withColumns({n: f.over(upto) for n, f in near.items()}))
    names = rows.df.columns
    own = F.floor(F.col(POSITION) / rows.bucket_rows).cast("long")
    inside = rows.df.withColumns({f"_x{i}": c for i, c in enumerate(columns.values())}).withColumn(BUCKET, own)
    keys = [quoted(k) for k in rows.keys]
    pick = F.min_by if backward else F.max_by
    ends = inside.groupBy(*keys, BUCKET).agg(
        *[
            pick(F.struct(f"_x{i}"), F.when(F.col(f"_x{i}").isNotNull(), F.col(POSITION))).alias(f"_e{i}")
            for i in range(len(columns))
        ]
    )
    order = F.col(BUCKET).desc() if backward else F.col(BUCKET)
    others = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # Only keys that fill more than one bucket keep a row: rows / bucket_rows.
    carried = (
        ends.select(
            F.col(BUCKET).alias("_cb"),
            *[k.alias(f"_ck{i}") for i, k in enumerate(keys)],
            F.count(F.lit(1)).over(others).alias("_more"),
            *[F.last(F.col(f"_e{i}._x{i}"), ignorenulls=True).over(others).alias(f"_c{i}") for i in range(len(columns))],
        )
        .where("_more > 0")
    )
    same = F.col(BUCKET) == F.col("_cb")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"_ck{i}"))
    joined = inside.join(carried, same, "left")
    added = joined.withColumns(
        {
            n: F.coalesce(F.last(f"_x{i}", ignorenulls=True).over(upto), F.col(f"_c{i}"))
            for i, n in enumerate(columns)
        }
    )
    keep = [quoted(c) for c in names if c not in columns] + [quoted(n) for n in columns]
    return rows.with_df(added.select(*keep))
