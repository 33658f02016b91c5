"""Row and column operators: select, filter, union, sample, edit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.schema import is_floating, is_integral, is_numeric, quoted, type_class
from ..functions.values import json_safe, parse_number
from ..plans.quantiles import union_all

SOURCE_TAG = "_source_table"


def select_by_dtype(df: DataFrame, kind: str) -> DataFrame:
    """Columns of one class: numeric, categorical or datetime."""
    return df.select(*[quoted(f.name) for f in df.schema if type_class(f.dataType) == kind])


def filter_source_tables(df: DataFrame, tables: list[str]) -> DataFrame:
    return df.where(F.col(SOURCE_TAG).isin(*tables)).drop(SOURCE_TAG)


def select_tables(
    catalog: DataFrame, search: str = "", add: tuple[str, ...] = (), remove: tuple[str, ...] = ()
) -> DataFrame:
    """Table names that contain ``search`` in any case, plus and minus named ones.

    ``catalog`` has ``table_name`` and ``record_count``; the total of the
    selection is on every row.
    """
    name = F.col("table_name")
    hit = F.contains(F.lower(name), F.lit(search.lower())) | name.isin(*add)
    chosen = catalog.where(hit & ~name.isin(*remove))
    total = chosen.agg(F.lit(1).alias("j"), F.sum("record_count").alias("selected_records"))
    return (
        chosen.select("table_name", "record_count", F.lit(1).alias("j"))
        .join(F.broadcast(total), "j")
        .drop("j")
    )


def _common_type(types: list[T.DataType]) -> T.DataType:
    first = types[0]
    if all(t == first for t in types):
        return first
    if all(is_integral(t) for t in types):
        return T.LongType()
    if all(is_numeric(t) for t in types):
        return T.DoubleType()
    return T.StringType()


def union_tables(tables: Mapping[str, DataFrame], tag: str | None = SOURCE_TAG) -> DataFrame:
    """All rows of all tables; missing columns are null, clashing types widened."""
    seen: dict[str, list[T.DataType]] = {}
    for df in tables.values():
        for f in df.schema:
            seen.setdefault(f.name, []).append(f.dataType)
    target = {name: _common_type(types) for name, types in seen.items()}
    parts = []
    for table, df in tables.items():
        have = set(df.columns)
        columns = [
            (quoted(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in target.items()
        ]
        if tag:
            columns.append(F.lit(table).alias(tag))
        parts.append(df.select(*columns))
    return union_all(parts)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def first_rows(df: DataFrame, order_by: list[str], n: int = 100) -> DataFrame:
    """The first ``n`` rows in a stated order; a top-n per task, not a sort."""
    return df.orderBy(*[quoted(c) for c in order_by]).limit(n)


def last_points(df: DataFrame, order_by: list[str], n: int = 20) -> DataFrame:
    return df.orderBy(*[quoted(c).desc() for c in order_by]).limit(n)


def sample_rows(df: DataFrame, order_by: list[str], n: int = 100) -> DataFrame:
    """First rows with numbers that JSON can hold; ``n`` between 1 and 1000."""
    if not 1 <= n <= 1000:
        raise ValueError("n must be between 1 and 1000")
    return json_safe(first_rows(df, order_by, n))


def sample_tables(
    tables: Mapping[str, DataFrame], order_by: Mapping[str, list[str]], max_tables: int = 3, n: int = 5
) -> DataFrame:
    """A few rows of the first few tables, as JSON text per row."""
    return union_all(
        [
            first_rows(tables[t], order_by[t], n).select(
                F.lit(t).alias("table_name"), F.to_json(F.struct("*")).alias("record")
            )
            for t in list(tables)[:max_tables]
        ]
    )


def sample_values(df: DataFrame, order_by: list[str], n: int = 3) -> DataFrame:
    """Per column, its first ``n`` non-null values as text, in a stated order."""
    order = [quoted(c) for c in order_by]
    parts = []
    for i, f in enumerate(df.schema):
        keep = F.col("v").isNotNull()
        if is_floating(f.dataType):
            keep = keep & ~F.isnan("v")
        top = (
            df.select(quoted(f.name).alias("v"), F.struct(*order).alias("o"))
            .where(keep)
            .orderBy("o")
            .limit(n)
        )
        values = F.transform(
            F.array_sort(F.collect_list(F.struct("o", F.col("v").cast("string").alias("t")))), lambda x: x["t"]
        )
        parts.append(
            top.agg(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), values.alias("samples"))
        )
    return union_all(parts)


def _edit(value: Column, dt: T.DataType) -> Column:
    """An edit arrives as text: numbers that do not parse become null."""
    if is_integral(dt):
        return F.round(parse_number(value)).try_cast(dt)
    if is_numeric(dt):
        return parse_number(value).try_cast(dt)
    return value.try_cast(dt)


def update_rows(df: DataFrame, edits: DataFrame, key: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Apply edits ``(key, column_name, new_value text)`` to the rows they name.

    The last edit of a cell wins (by text order of the value when an ``at``
    column is absent), unknown columns are ignored, and a key that no row has is
    an error.
    """
    order = F.col("at") if "at" in edits.columns else F.col("new_value")
    names = [f.name for f in df.schema if f.name != key]
    wide = edits.groupBy(quoted(key)).agg(
        *[
            F.max_by(
                F.struct("new_value"), F.when(F.col("column_name") == n, order)
            ).alias(f"_e{i}")
            for i, n in enumerate(names)
        ]
    )
    missing = wide.join(df.select(quoted(key)), key, "left_anti").limit(1).count()
    if missing:
        raise KeyError(f"an edit names a {key} that no row has")
    few = edits.limit(broadcast_rows + 1).count() <= broadcast_rows
    joined = df.join(F.broadcast(wide) if few else wide, key, "left")
    return joined.select(
        *[
            quoted(f.name)
            if f.name == key
            else F.when(
                F.col(f"_e{names.index(f.name)}").isNotNull(),
                _edit(F.col(f"_e{names.index(f.name)}.new_value"), f.dataType),
            )
            .otherwise(quoted(f.name))
            .alias(f.name)
            for f in df.schema
        ]
    )
