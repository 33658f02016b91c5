"""One row of facts per column, from the frequencies of its values or from sketches.

The number of scans does not depend on the number of columns: frequencies take one pass over the table for all of them
(see ``frequencies``), sketches one aggregation.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.schema import is_nested, is_numeric, is_text, numeric_names, sql_name
from ..functions.values import NUMBER_PATTERN, row_keys
from .frequencies import frequencies
from .quantiles import ACCURACY, exact_quantiles, number, sketch_quantiles

#: Probabilities of the quantile grid that approximate quartiles and outliers are read from: finer in the tails.
GRID = tuple(sorted({k / 200 for k in range(201)} | {x for k in range(25) for x in (k / 1000, 1 - k / 1000)}))

PROFILE_FIELDS = (
    "position", "column_name", "data_type", "row_count", "non_null", "null_count",
    "unique_count", "all_numbers", "mixed_case", "min_value", "max_value",
    "mean_value", "outliers",
)
_PROFILE = (
    "position int, column_name string, data_type string, row_count bigint, non_null bigint, null_count bigint, unique_count bigint, "
    "all_numbers boolean, mixed_case bigint, min_value double, max_value double, mean_value double, outliers bigint"
)


def iqr_bounds(
    df: DataFrame,
    columns: list[str] | None = None,
    factor: float = 1.5,
    approx: bool = False,
    keep_flat: bool = False,
) -> dict[str, tuple[float, float] | None]:
    """Tukey fences per numeric column.

    Null for a column without values, and, unless ``keep_flat``, for one whose
    quartiles coincide.
    """
    names = numeric_names(df) if columns is None else columns
    if approx:
        quartiles = sketch_quantiles(df, names, (0.25, 0.75))
    else:
        quartiles = exact_quantiles(df, names, (0.25, 0.75))
    return {name: _fences(q1, q3, factor, keep_flat) for name, (q1, q3) in quartiles.items()}


def outside(value: Column, bounds: tuple[float, float] | None) -> Column:
    if bounds is None:
        return F.lit(False)
    return (value < F.lit(bounds[0])) | (value > F.lit(bounds[1]))


def _finite(x: float | None) -> float | None:
    return x if x is not None and math.isfinite(x) else None


def _sketches(df: DataFrame, columns: list[str] | None) -> tuple[list[tuple], dict[str, list[float]]]:
    """Facts by sketches and the quantile grid of every numeric column, from one scan of the table."""
    fields = [(i, f) for i, f in enumerate(df.schema) if columns is None or f.name in columns]
    grid = F.array(*map(F.lit, GRID))
    quantiles = []
    facts = ["count(1) AS n"]
    for i, f in fields:
        c, dt = sql_name(f.name), f.dataType
        facts.append(f"count({c}) AS p{i}")
        if not is_nested(dt):
            facts.append(f"approx_count_distinct({c}) AS u{i}")
        if is_text(dt):
            facts += [f"bool_and({c} RLIKE r'{NUMBER_PATTERN}') AS t{i}", f"count_if({c} <> lower({c}) AND {c} <> upper({c})) AS m{i}"]
        if is_numeric(dt):
            v = f"CAST({c} AS double)"
            facts += [f"min({v}) AS a{i}", f"max({v}) AS b{i}", f"avg({v}) AS c{i}"]
            quantiles.append(F.percentile_approx(F.expr(v), grid, ACCURACY).alias(f"q{i}"))
    row = df.agg(*[F.expr(x) for x in facts], *quantiles).first()
    told, grids = [], {}
    for i, f in fields:
        dt, present = f.dataType, row[f"p{i}"]
        head = (i, f.name, dt.simpleString(), row.n, present, row.n - present)
        if is_numeric(dt) and row[f"q{i}"]:
            grids[f.name] = row[f"q{i}"]
        if is_nested(dt):
            told.append((*head, *[None] * 7))
            continue
        text = (True if row[f"t{i}"] is None else row[f"t{i}"], row[f"m{i}"]) if is_text(dt) else (None, 0)
        ends = [_finite(row[f"{k}{i}"]) for k in "abc"] if is_numeric(dt) else [None] * 3
        told.append((*head, row[f"u{i}"], *text, *ends, 0))
    return told, grids


def _fences(q1: float | None, q3: float | None, factor: float, keep_flat: bool) -> tuple[float, float] | None:
    spread = None if q1 is None else q3 - q1
    fenced = spread is not None and (spread > 0 or keep_flat)
    return (q1 - factor * spread, q3 + factor * spread) if fenced else None


def _beyond(grid: list[float], bounds: tuple[float, float] | None, present: int) -> int:
    """Rows outside the fences as the grid of quantiles tells, to half a step of the grid on either side."""
    if bounds is None:
        return 0
    low, high = bisect.bisect_left(grid, bounds[0]), bisect.bisect_right(grid, bounds[1])
    below = (GRID[low - 1] + GRID[min(low, len(GRID) - 1)]) / 2 if low else 0.0
    above = 1 - (GRID[high - 1] + GRID[high]) / 2 if 0 < high < len(GRID) else float(high == 0)
    return round(present * (below + above))


def measured(
    df: DataFrame, approx: bool = False, factor: float = 1.5, keep_flat: bool = False, columns: list[str] | None = None
) -> tuple[DataFrame, dict[str, tuple[float, float] | None]]:
    """Facts per column with outliers beyond Tukey fences, and the fences; ``df`` must be normalized.

    Exact: the table is run once and folded to frequencies, which are written, read three times and deleted. Approximate:
    one aggregation; distinct counts and quartiles are sketches, outliers come from a grid of quantiles. Either way one
    row per column reaches the driver.
    """
    spark = df.sparkSession
    if approx:
        told, grids = _sketches(df, columns)
        fences = {f.name: None for f in df.schema if is_numeric(f.dataType) and (columns is None or f.name in columns)}
        fences |= {name: _fences(g[GRID.index(0.25)], g[GRID.index(0.75)], factor, keep_flat) for name, g in grids.items()}
        rows = [(*r[:-1], _beyond(grids[r[1]], fences[r[1]], r[4]) if r[1] in grids else r[-1]) for r in told]
        return spark.createDataFrame(rows, _PROFILE), fences
    counted = frequencies(df, columns, keep=True)
    try:
        quartiles = counted.quantiles((0.25, 0.75))
        fences = {name: _fences(q1, q3, factor, keep_flat) for name, (q1, q3) in quartiles.items()}
        rows = [tuple(r) for r in counted.facts(fences).collect()]
    finally:
        counted.close()
    return spark.createDataFrame(rows, _PROFILE), fences


def beyond_fences(df: DataFrame, columns: list[str], factor: float = 1.5) -> tuple[int, dict[str, tuple[int, int]]]:
    """Rows, and per column with Tukey fences its present values and those beyond; ``df`` must be normalized.

    Quartiles are order statistics from sketched brackets and outliers one aggregation, so only values inside a bracket
    are shuffled, however many distinct ones a column has.
    """
    quartiles = exact_quantiles(df, columns, (0.25, 0.75))
    fences = {name: pair for name, q in quartiles.items() if (pair := _fences(*q, factor, False))}
    facts = ["count(1) AS n"]
    for i, (name, (low, high)) in enumerate(fences.items()):
        value = f"CAST({sql_name(name)} AS double)"
        facts += [f"count({sql_name(name)}) AS p{i}", f"count_if({value} < {number(low)} OR {value} > {number(high)}) AS x{i}"]
    row = df.agg(*map(F.expr, facts)).first()
    return row.n, {name: (row[f"p{i}"], row[f"x{i}"]) for i, name in enumerate(fences)}


def column_profile(
    df: DataFrame,
    bounds: dict[str, tuple[float, float] | None] | None = None,
    approx: bool = False,
    columns: list[str] | None = None,
) -> DataFrame:
    """Facts per column in schema order; ``df`` must be normalized. ``bounds`` are fences for the count of outliers."""
    if not approx:
        return frequencies(df, columns).facts(bounds)
    told, grids = _sketches(df, columns)
    bounds = bounds or {}
    rows = [(*r[:-1], _beyond(grids[r[1]], bounds.get(r[1]), r[4]) if r[1] in grids else r[-1]) for r in told]
    return df.sparkSession.createDataFrame(rows, _PROFILE)


def row_repeats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows, distinct rows, and rows that repeat an earlier one."""
    keys = row_keys(df, columns)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )
