"""Frequencies of the values of all columns from one pass over a table, and everything that follows from them.

Columns are unpivoted to ``(column, value)`` and folded to one count per value before anything is shuffled, so that a
value that fills a third of the table is one row per task. Columns of numbers and times share one branch with keys of
fixed width, texts another with short keys; the branches read disjoint columns, so every column is read once, however
many there are. Counts, ranges, distinct values, quartiles and outliers all come from the written frequencies; the
table itself, which may be a costly plan, is not run again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.schema import is_boolean, is_datetime, is_floating, is_integral, is_nested, is_numeric, is_text, sql_name
from ..functions.values import DIGEST_ABOVE_BYTES, NUMBER_PATTERN
from .materialize import discard, fresh_path
from .quantiles import braces, number, select_over

#: Bytes of numeric frequencies, at 24 a value, up to which a column's ranks are read in one task.
WINDOW_BYTES = 64 << 20
_VALUE_BYTES = 24
_COUNTS = "c int, l bigint, d double, x string, n bigint, num boolean, mix boolean"


def _decimal(dt: T.DataType) -> bool:
    return isinstance(dt, T.DecimalType) and dt.precision <= 18


def _fixed(field: T.StructField) -> tuple[str, str] | None:
    """The column as a whole number or as a double, whichever holds it exactly; None if it needs text."""
    name, dt = sql_name(field.name), field.dataType
    if is_nested(dt):
        return f"if({name} IS NULL, NULL, 1)", "NULL"
    if is_floating(dt):
        return "NULL", name
    if is_integral(dt) or is_boolean(dt):
        return name, "NULL"
    if _decimal(dt):
        return f"{name} * CAST(1{'0' * dt.scale} AS decimal({dt.scale + 1}, 0))", "NULL"
    if isinstance(dt, T.TimestampType):
        return f"unix_micros({name})", "NULL"
    if is_datetime(dt):
        if isinstance(dt, T.DateType):
            return f"unix_date({name})", "NULL"
        minutes = f"(unix_date(CAST({name} AS date)) * 24L + hour({name})) * 60 + minute({name})"  # in no zone
        return f"({minutes}) * 60000000 + CAST(extract(SECOND FROM {name}) * 1000000 AS bigint)", "NULL"
    return None


def _text(field: T.StructField) -> str:
    name, dt = sql_name(field.name), field.dataType
    return name if is_text(dt) else f"hex({name})" if isinstance(dt, T.BinaryType) else f"CAST({name} AS string)"


def _branches(df: DataFrame, columns: list[int]) -> list[str]:
    fields = df.schema.fields
    fixed = [(i, pair) for i in columns if (pair := _fixed(fields[i])) is not None]
    texts = [(i, _text(fields[i])) for i in columns if _fixed(fields[i]) is None]
    parts = []
    if fixed:
        cells = ", ".join(f"{i}, CAST({a} AS bigint), CAST({b} AS double)" for i, (a, b) in fixed)
        rows = f"(SELECT stack({len(fixed)}, {cells}) AS (c, l, d) FROM <t>)"
        parts.append(
            "SELECT c, l, d, CAST(NULL AS string) AS x, count(1) AS n, CAST(NULL AS boolean) AS num, CAST(NULL AS boolean) AS mix "
            f"FROM {rows} GROUP BY c, l, d"
        )
    if texts:
        cells = ", ".join(f"{i}, {a}" for i, a in texts)
        long = f"octet_length(v) > {DIGEST_ABOVE_BYTES}"
        digest = f"if({long}, concat_ws(':', sha2(v, 256), CAST(length(v) AS string)), v)"
        facts = {"num": f"v RLIKE r'{NUMBER_PATTERN}'", "mix": "v <> lower(v) AND v <> upper(v)"}
        # Short texts are their own key and are tested once each, after they are folded.
        early = ", ".join(f"max(if({long}, {test}, NULL)) AS {name}" for name, test in facts.items())
        late = ", ".join(f"coalesce({name}, {test.replace('v ', 'x ').replace('(v)', '(x)')}) AS {name}" for name, test in facts.items())
        rows = f"(SELECT stack({len(texts)}, {cells}) AS (c, v) FROM <t>)"
        folded = f"(SELECT c, {digest} AS x, count(1) AS n, {early} FROM {rows} GROUP BY 1, 2)"
        parts.append(f"SELECT c, CAST(NULL AS bigint) AS l, CAST(NULL AS double) AS d, x, n, {late} FROM {folded}")
    return [braces(p).replace("<t>", "{t}") for p in parts]


@dataclass
class Frequencies:
    """``counts`` holds c (place of the column in the schema), the value as l, d or x, n, and the tests of texts."""

    df: DataFrame
    columns: list[int]
    counts: DataFrame
    path: str | None = None

    def _fields(self) -> list[tuple[int, T.StructField]]:
        return [(i, self.df.schema.fields[i]) for i in self.columns]

    def _literal(self, of) -> str:
        """An array by place in the schema, with null for columns that are left out."""
        own = set(self.columns)
        return f"element_at(array({', '.join(of(f) if i in own else 'NULL' for i, f in enumerate(self.df.schema))}), c + 1)"

    def _value(self) -> str:
        """The value as a double; null for columns that are not numbers."""
        scale = lambda f: "1D" if is_integral(f.dataType) or is_floating(f.dataType) else (
            f"1{'0' * f.dataType.scale}D" if _decimal(f.dataType) else "CAST(NULL AS double)"
        )
        wide = [i for i, f in self._fields() if isinstance(f.dataType, T.DecimalType) and not _decimal(f.dataType)]
        text = f"if(c IN ({', '.join(map(str, wide))}), try_cast(x AS double), NULL)" if wide else "CAST(NULL AS double)"
        return f"coalesce(coalesce(d, CAST(l AS double)) / {self._literal(scale)}, {text})"

    def numeric(self) -> list[int]:
        return [i for i, f in self._fields() if is_numeric(f.dataType)]

    def quantiles(self, probs: tuple[float, ...], window_bytes: int = WINDOW_BYTES) -> dict[str, list[float | None]]:
        """Exact quantiles with linear interpolation of every numeric column; null for columns without values.

        Frequencies of a column that is small as bytes go are ranked by a window; else they are range-partitioned by
        column and value, and only the ranges that hold a wanted rank are ranked.
        """
        names = {i: f.name for i, f in self._fields() if is_numeric(f.dataType)}
        if not names:
            return {}
        values = self.counts.where(F.col("c").isin(list(names))).selectExpr("c", f"{self._value()} AS v", "n").where("v IS NOT NULL")
        totals = {r.c: r for r in values.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).collect()}
        wanted = {c: sorted({k for p in probs for k in (math.floor((r.n - 1) * p), math.ceil((r.n - 1) * p))}) for c, r in totals.items()}
        found = {}
        small = [c for c, r in totals.items() if r.m * _VALUE_BYTES <= window_bytes]
        if small:
            found |= self._ranked(values.where(F.col("c").isin(small)), {c: wanted[c] for c in small}, {})
        large = [c for c in totals if c not in small]
        if large:
            order = F.col("c"), F.col("v")
            ranged = values.where(F.col("c").isin(large)).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
            path = fresh_path(self.df.sparkSession, "ranked")
            ranged.write.parquet(path)
            stored = self.df.sparkSession.read.parquet(path)
            # A column is in few ranges and a range in few columns: as many rows as ranges and columns together.
            sums = sorted(map(tuple, stored.groupBy("c", "part").agg(F.sum("n")).collect()))
            before, upto = {}, dict.fromkeys(large, 0)
            for c, part, n in sums:
                if any(upto[c] <= k < upto[c] + n for k in wanted[c]):
                    before[c, part] = upto[c]
                upto[c] += n
            here = " OR ".join(f"(c = {c} AND part = {part})" for c, part in before)
            found |= self._ranked(stored.where(here), {c: wanted[c] for c in large}, before)
            discard(self.df.sparkSession, path)
        out = {}
        for c, name in names.items():
            out[name] = [None] * len(probs)
            for j, p in enumerate(probs if c in totals else ()):
                place = (totals[c].n - 1) * p
                a, b = found[c, math.floor(place)], found[c, math.ceil(place)]
                out[name][j] = a if a == b else a + (b - a) * (place - math.floor(place))
        return out

    def _ranked(self, values: DataFrame, wanted: dict[int, list[int]], before: dict[tuple[int, int], int]) -> dict:
        keys = ["c", "part"] if before else ["c"]
        running = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        start = "0L"
        if before:
            start = "CASE " + " ".join(f"WHEN c = {c} AND part = {part} THEN {n}L" for (c, part), n in before.items()) + " END"
        upto = values.withColumn("upto", F.sum("n").over(running) + F.expr(start))
        ranks = [(c, k) for c, ks in wanted.items() for k in ks]
        asked = F.broadcast(self.df.sparkSession.createDataFrame(ranks, "rc int, k bigint"))  # a few rows a column
        met = upto.join(asked, (F.col("c") == F.col("rc")) & F.expr("k < upto AND k >= upto - n"))
        return {(r.c, r.k): r.v for r in met.select("c", "k", "v").collect()}

    def facts(self, bounds: dict[str, tuple[float, float] | None] | None = None) -> DataFrame:
        """Facts per column in schema order, one aggregation over the frequencies; see ``PROFILE_FIELDS``."""
        bounds = bounds or {}
        fence = lambda k: self._literal(lambda f: number(bounds[f.name][k]) if bounds.get(f.name) else "CAST(NULL AS double)")
        finite = lambda sql: f"nullif(nullif({sql}, double('inf')), double('-inf'))"
        present = "coalesce(l IS NOT NULL OR d IS NOT NULL OR x IS NOT NULL, false)"
        rows = self.counts.selectExpr("c", "n", "num", "mix", f"{present} AS here", f"{self._value()} AS v", f"{fence(0)} AS low", f"{fence(1)} AS high")
        summed = rows.groupBy("c").agg(
            F.expr("sum(n)").alias("row_count"), F.expr("coalesce(sum(if(here, n, 0)), 0L)").alias("non_null"),
            F.expr("coalesce(sum(if(here, 0, n)), 0L)").alias("null_count"), F.expr("count_if(here)").alias("u"),
            F.expr("min(if(here, num, NULL))").alias("num"), F.expr("coalesce(sum(if(here AND mix, n, 0)), 0L)").alias("mix"),
            F.expr("min(v)").alias("min"), F.expr("max(v)").alias("max"), F.expr("sum(v * n) / sum(if(v IS NULL, NULL, n))").alias("mean"),
            F.expr("coalesce(sum(if(v < low OR v > high, n, 0)), 0L)").alias("out"),
        )
        every = self.df.sparkSession.createDataFrame(
            [(i, f.name, f.dataType.simpleString(), is_text(f.dataType), is_nested(f.dataType)) for i, f in self._fields()],
            "position int, column_name string, data_type string, is_text boolean, is_nested boolean",
        )
        # One row a column on both sides; a table without rows has no frequencies.
        joined = every.join(F.broadcast(summed), F.col("c") == F.col("position"), "left")
        plain = lambda sql, name: F.expr(f"if(is_nested, NULL, {sql})").alias(name)
        return joined.select(
            "position", "column_name", "data_type", F.expr("coalesce(row_count, 0L)").alias("row_count"),
            F.expr("coalesce(non_null, 0L)").alias("non_null"), F.expr("coalesce(null_count, 0L)").alias("null_count"),
            plain("coalesce(u, 0L)", "unique_count"), F.expr("if(is_text, coalesce(num, true), NULL)").alias("all_numbers"),
            plain("coalesce(mix, 0L)", "mixed_case"), plain(finite("min"), "min_value"), plain(finite("max"), "max_value"),
            plain(finite("mean"), "mean_value"), plain("coalesce(out, 0L)", "outliers"),
        )

    def close(self) -> None:
        """Delete the written frequencies; plans over them cannot be run any more."""
        if self.path:
            discard(self.df.sparkSession, self.path)


def frequencies(df: DataFrame, columns: list[str] | None = None, keep: bool = False) -> Frequencies:
    """Frequencies of the named columns (all of them); ``df`` must be normalized.

    ``keep`` writes them to the shared folder, for uses that read them more than once; ``close`` deletes them.
    """
    chosen = [i for i, f in enumerate(df.schema) if columns is None or f.name in columns]
    spark = df.sparkSession
    if not chosen:
        return Frequencies(df, chosen, spark.createDataFrame([], _COUNTS))
    counts = select_over(df, _branches(df, chosen))
    if not keep:
        return Frequencies(df, chosen, counts)
    path = fresh_path(spark, "frequencies")
    counts.write.parquet(path)
    return Frequencies(df, chosen, spark.read.schema(_COUNTS).parquet(path), path)
