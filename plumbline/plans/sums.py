"""Sums of products for least squares and principal components.

Tasks reduce their rows to one small square matrix with numpy; Spark adds the
matrices up entry by entry.  Only the final matrix reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.schema import quoted
from .ordered import BUCKET, POSITION, OrderedRows

_CELLS = "cells array<double>"
#: Columns on a side of a block of column pairs.
PAIR_BLOCK = 64


def _total(partial: DataFrame, size: int) -> np.ndarray:
    cells = partial.select(F.posexplode("cells").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    out = np.zeros(size)
    for row in cells.collect():
        if row.x is None or np.isnan(row.x):
            raise ArithmeticError("a sum of products is not a number")
        out[row.i] = row.x
    return out


def vector_products(df: DataFrame, column: str, shift: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, sums and cross products of an array column, less ``shift``, over complete vectors.

    Vectors that are null or hold a null or NaN are left out; the count says how many entered. Lengths must be equal.
    """
    sizes = df.where(F.col(column).isNotNull()).agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {column} have lengths from {sizes[0]} to {sizes[1]}")
    width = sizes[1] or 0

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total, cross = 0.0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()).astype(float)
                x = x - (shift if shift is not None else 0.0)
                count += len(x)
                total += x.sum(axis=0)
                cross += x.T @ x
        yield pd.DataFrame({"cells": [np.concatenate([[count], total, cross.ravel()])]})

    vectors = df.select(F.col(column).cast("array<double>").alias("v"))
    vectors = vectors.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    cells = _total(vectors.mapInPandas(reduce, _CELLS), 1 + width + width * width)
    return cells[0], cells[1 : 1 + width], cells[1 + width :].reshape(width, width)


def _lag_sums(rows: OrderedRows, column: str, reach: int, reduce: Callable[[np.ndarray, np.ndarray], dict[int, np.ndarray]]) -> DataFrame:
    """What ``reduce`` makes of every bucket, as rows (kind, cells).

    It gets the values of a bucket with up to ``reach`` rows before it and one behind it, null as NaN, and which of
    them are the bucket's own. Rows of neighbours are copied, so every step of a series is some bucket's own once.
    """
    if reach > rows.bucket_rows:
        raise ValueError("buckets must hold more rows than there are lags")
    size = rows.bucket_rows
    own = F.floor(F.col(POSITION) / size).cast("long")
    place = F.col(POSITION) % size
    homes = F.array_compact(
        F.array(own, F.when(place >= size - reach, own + 1), F.when((place == 0) & (own > 0), own - 1))
    )
    spread = rows.df.select(F.col(POSITION), F.col(column).cast("double").alias("y"), F.explode(homes).alias(BUCKET))

    def task(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(POSITION)
        mine = (part[POSITION] // size == part[BUCKET]).to_numpy()
        found = reduce(part["y"].to_numpy(dtype=float), mine) if mine.any() else {}
        return pd.DataFrame({"kind": pd.Series(list(found), dtype="int32"), "cells": pd.Series(list(found.values()), dtype=object)})

    return spread.groupBy(BUCKET).applyInPandas(task, f"kind int, {_CELLS}")


def _totals(partial: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Cells of each kind added up; kinds without a row are zeros."""
    cells = partial.select("kind", F.posexplode("cells").alias("i", "x")).groupBy("kind", "i").agg(F.sum("x").alias("x"))
    out = {kind: np.zeros(size) for kind, size in sizes.items()}
    for row in cells.collect():
        if row.x is None or np.isnan(row.x):
            raise ArithmeticError("a sum of products is not a number")
        out[row.kind][row.i] = row.x
    return out


def _against_lags(leading: np.ndarray, values: np.ndarray, lags: int) -> np.ndarray:
    """Sums of ``leading(t) * values(t - j)`` for j from 0 to ``lags``."""
    return np.array([leading[j:] @ values[: len(values) - j] for j in range(min(lags + 1, len(values)))] + [0.0] * (lags + 1 - len(values)))


def lag_products(rows: OrderedRows, column: str, lags: int, center: float, scale: float = 1.0, steps: bool = True) -> np.ndarray:
    """Cross products of ``[1, y(t-1), x(t-1) .. x(t-lags), x(t)]``, y less ``center`` and divided by ``scale``.

    x is the step y(t) - y(t-1), or y itself without the column y(t-1) if ``steps`` is false. Rows that touch a null
    value are left out; the first cell counts those that enter. A bucket sums x(t) with each of its lags only: products
    of two lags are those of the same distance one row earlier, but for the rows at the ends of a run of complete rows.
    Ends are few where nulls are few, and a bucket without one sends a handful of cells a lag, no matrix.
    """
    need = lags + 1 if steps else lags

    def reduce(y: np.ndarray, mine: np.ndarray) -> dict[int, np.ndarray]:
        y = (y - center) / scale
        x = np.r_[np.nan, np.diff(y)] if steps else y
        missing = np.r_[0, np.isnan(x).cumsum()]
        full = np.zeros(len(x), dtype=bool)
        full[lags:] = missing[lags + 1 :] == missing[: len(x) - lags] if len(x) > lags else False
        here = full & mine
        if not here.any():
            return {}
        before = np.r_[0.0, y[:-1]]
        level = np.where(here, before, 0.0) if steps else np.zeros(len(x))
        known = np.nan_to_num(x)
        sums = [np.array([here.sum(), level.sum(), level @ level])]
        sums += [_against_lags(lead, known, lags) for lead in (np.where(here, x, 0.0), level, here.astype(float))]
        found = {0: np.concatenate(sums)}
        first = np.flatnonzero(here & ~np.r_[False, full[:-1]])
        last = np.flatnonzero(here & ~np.r_[full[1:], False])
        if lags and len(first) + len(last):
            ends = np.zeros((lags, lags))
            for at, sign in ((first - 1, 1.0), (last, -1.0)):
                for some in np.array_split(at, 1 + len(at) * lags // 1_000_000):
                    around = known[some[:, None] - np.arange(lags)]
                    ends += sign * (around.T @ around)
            found[1] = ends.ravel()
        return found

    found = _totals(_lag_sums(rows, column, need + 1, reduce), {0: 3 + 3 * (lags + 1), 1: lags * lags})
    count, level, square = found[0][:3]
    own, with_level, totals = found[0][3:].reshape(3, lags + 1)
    ends = found[1].reshape(lags, lags)
    products = np.zeros((lags + 1, lags + 1))
    products[0] = products[:, 0] = own
    for i in range(lags):
        products[i + 1, 1:] = products[i, :-1] + ends[i]
    products = np.triu(products) + np.triu(products, 1).T
    cross = np.zeros((lags + 3, lags + 3))
    cross[0, :2], cross[1, :2] = (count, level), (level, square)
    order = [*range(1, lags + 1), 0]  # lags first, the row itself last
    cross[2:, 2:] = products[np.ix_(order, order)]
    cross[0, 2:] = cross[2:, 0] = totals[order]
    cross[1, 2:] = cross[2:, 1] = with_level[order]
    return cross if steps else np.delete(np.delete(cross, 1, 0), 1, 1)


def lag_covariances(rows: OrderedRows, column: str, lags: int, center: float) -> np.ndarray:
    """Sums of ``y(t) y(t-k)`` for k from 0 to ``lags``, y less ``center``; products with a null are left out."""

    def reduce(y: np.ndarray, mine: np.ndarray) -> dict[int, np.ndarray]:
        y = np.nan_to_num(y - center)
        return {0: _against_lags(np.where(mine, y, 0.0), y, lags)}

    return _totals(_lag_sums(rows, column, lags, reduce), {0: lags + 1})[0]


def nested_fits(cross: np.ndarray) -> np.ndarray:
    """Residual sums of the last variable on the first k of the others, k from 0, by elimination one variable at a time.

    A variable that those before it explain to twelve digits adds nothing.
    """
    spread = np.sqrt(np.diag(cross))
    spread[spread == 0] = 1.0
    left = cross / np.outer(spread, spread)
    out = [left[-1, -1]]
    for i in range(len(left) - 1):
        if left[i, i] > 1e-12:
            left = left - np.outer(left[:, i], left[i]) / left[i, i]
        out.append(max(left[-1, -1], 0.0))
    return np.array(out) * spread[-1] ** 2


def pair_products(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per pair (i, j) over the rows where both have a value: count, sum of i, sum of squares of i, sum of i times j.

    Values are taken less their column's mean. Tasks sum all pairs with numpy and send them as blocks; blocks are added
    up in two rounds, so that no task holds the partial sums of all tasks. The plan has one expression a column, none a pair.
    """
    p = len(columns)
    values = df.select(F.array(*[F.coalesce(quoted(c).cast("double"), F.lit(float("nan"))) for c in columns]).alias("v"))
    number = lambda c: quoted(c).cast("double")
    means = np.nan_to_num(np.array(df.agg(*[F.avg(F.when(~F.isnan(number(c)), number(c))) for c in columns]).first(), dtype=float))
    blocks = [(a, b) for a in range(0, p, PAIR_BLOCK) for b in range(0, p, PAIR_BLOCK)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - means
                has = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x)
                new = np.stack([has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x])
                total = new if total is None else total + new
        if total is not None:
            cells = [total[:, a : a + PAIR_BLOCK, b : b + PAIR_BLOCK].ravel() for a, b in blocks]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(cells, pa.list_(pa.float64()))], ["block", "cells"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": part["block"].iloc[:1].to_numpy(), "cells": [np.sum(np.stack(part["cells"].to_numpy()), axis=0)]})

    schema = f"block int, {_CELLS}"
    partial = values.mapInArrow(products, schema)
    teams = max(1, math.isqrt(df.sparkSession.sparkContext.defaultParallelism * 4))
    partial = partial.withColumn("team", F.spark_partition_id() % teams).groupBy("block", "team").applyInPandas(add, schema)
    out = np.zeros((4, p, p))
    for row in partial.groupBy("block").applyInPandas(add, schema).collect():
        a, b = blocks[row.block]
        out[:, a : a + PAIR_BLOCK, b : b + PAIR_BLOCK] = np.reshape(row.cells, (4, min(PAIR_BLOCK, p - a), min(PAIR_BLOCK, p - b)))
    return tuple(out)


def pair_correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Correlation of every pair of columns over the rows where both have a value; NaN where one of them does not vary."""
    n, s, q, c = pair_products(df, columns)
    with np.errstate(invalid="ignore", divide="ignore"):
        cover = c - s * s.T / n
        own = q - s * s / n
        # What is left of a column that does not vary is rounding of its squares.
        own = np.where(own > 1e-12 * q, own, 0.0)
        return np.where((own > 0) & (own.T > 0), cover / np.sqrt(own * own.T), np.nan).clip(-1.0, 1.0)
