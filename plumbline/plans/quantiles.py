"""Exact quantiles without holding a column in one task.

The built-in exact ``percentile`` keeps every distinct value of a column in one
aggregation buffer.  Here a mergeable sketch (``percentile_approx``) first
brackets each wanted rank between two values; the exact order statistics are
then read from the few values inside the bracket, after counting what lies
below it.  Nothing is sampled: a bracket that misses its rank is widened, and
one that still holds too many distinct values is narrowed by another pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.schema import sql_name

ACCURACY = 10_000
BRACKET_VALUES = 2_000_000
_GRID = 256
# Each round shrinks a bracket by more than ten: enough for any table.
_ROUNDS = 12


@dataclass
class _Target:
    """One wanted quantile: the ranks it lies between and the current bracket."""

    column: str
    prob: float
    first: int
    second: int
    weight: float
    lo: float | None
    hi: float | None
    size: float
    value: float | None = None


def number(x: float) -> str:
    """A double literal in SQL."""
    return f"{x!r}D" if math.isfinite(x) else f"double('{x}')"


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union as a balanced tree, which keeps plans of many branches shallow."""
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [p[0].union(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return parts[0]


def select_over(df: DataFrame, parts: list[str]) -> DataFrame:
    """``UNION ALL`` of queries that read ``{t}``: one analysis for all branches."""
    return df.sparkSession.sql(" UNION ALL ".join(parts), t=df)


def braces(sql: str) -> str:
    """Names and literals may hold braces, which the SQL formatter would read."""
    return sql.replace("{", "{{").replace("}", "}}")


def _doubles(column: str, where: str = "true") -> str:
    return (
        f"(SELECT v FROM (SELECT CAST({braces(sql_name(column))} AS double) AS v FROM {{t}}) "
        f"WHERE v IS NOT NULL AND NOT isnan(v) AND {where})"
    )


def _array(values) -> str:
    return f"array({', '.join(number(x) for x in values)})"


def _inside(t: _Target) -> str:
    low = "true" if t.lo is None else f"v >= {number(t.lo)}"
    high = "true" if t.hi is None else f"v <= {number(t.hi)}"
    return f"({low} AND {high})"


def sketch_quantiles(
    df: DataFrame, columns: list[str], probs: tuple[float, ...], accuracy: int = ACCURACY
) -> dict[str, list[float | None]]:
    """Approximate quantiles: one scan per column, rank error 1 / accuracy."""
    if not columns:
        return {}
    rows = select_over(
        df,
        [
            f"SELECT {c} AS c, percentile_approx(v, {_array(probs)}, {accuracy}) AS q FROM {_doubles(name)}"
            for c, name in enumerate(columns)
        ],
    ).collect()
    found = {columns[r.c]: r.q for r in rows}
    return {c: list(found[c]) if found[c] else [None] * len(probs) for c in columns}


def _first_brackets(df: DataFrame, columns: list[str], probs, accuracy: int) -> list[_Target]:
    slack = 4.0 / accuracy
    edges = _array(e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack)))
    rows = select_over(
        df,
        [
            f"SELECT {c} AS c, count(v) AS n, percentile_approx(v, {edges}, {accuracy}) AS edges FROM {_doubles(name)}"
            for c, name in enumerate(columns)
        ],
    ).collect()
    targets = []
    for row in rows:
        for i, p in enumerate(probs):
            if row.n == 0:
                continue
            place = (row.n - 1) * p
            lo, hi = row.edges[2 * i], row.edges[2 * i + 1]
            targets.append(
                _Target(
                    columns[row.c], p, math.floor(place), math.ceil(place), place - math.floor(place), lo, hi,
                    1.0 if lo == hi else row.n * 4 * slack,
                )
            )
    return targets


def _narrow(df: DataFrame, targets: list[_Target], accuracy: int, limit: int) -> None:
    """One pass that shrinks every bracket with too many distinct values."""
    grid = _array(i / _GRID for i in range(_GRID + 1))
    slack = 1 + math.ceil(_GRID * 2.0 / accuracy)
    parts = []
    for i, t in enumerate(targets):
        below = "false" if t.lo is None else f"v < {number(t.lo)}"
        here = f"if({_inside(t)}, v, NULL)"
        parts.append(
            f"SELECT {i} AS i, count_if({below}) AS below, count({here}) AS m, approx_count_distinct({here}) AS distinct, "
            f"percentile_approx({here}, {grid}, {accuracy}) AS grid FROM {_doubles(t.column)}"
        )
    for row in select_over(df, parts).collect():
        t = targets[row.i]
        if row.distinct <= limit or row.m == 0:
            t.size = 0.0
            continue
        if row.below > t.first or row.below + row.m <= t.second:
            # The sketch missed the rank: open that side and narrow again.
            t.lo = None if row.below > t.first else t.lo
            t.hi = None if row.below + row.m <= t.second else t.hi
            continue
        left = max(0, math.floor((t.first - row.below) / row.m * _GRID) - slack)
        right = min(_GRID, math.ceil((t.second - row.below) / row.m * _GRID) + slack)
        lo = row.grid[left] if left > 0 else t.lo
        hi = row.grid[right] if right < _GRID else t.hi
        t.size = 0.0 if (lo, hi) == (t.lo, t.hi) else row.m * (right - left + 1) / _GRID
        t.lo, t.hi = lo, hi


def _segments(targets: list[_Target]) -> list[tuple[float | None, float | None]]:
    """Brackets of one column in ascending order, overlapping ones merged."""
    low, high = -math.inf, math.inf
    spans = sorted(
        (low if t.lo is None else t.lo, high if t.hi is None else t.hi) for t in targets
    )
    merged = [list(spans[0])]
    for lo, hi in spans[1:]:
        if lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return [(None if lo == low else lo, None if hi == high else hi) for lo, hi in merged]


def _keyed(column: str, segments, c: int) -> str:
    """Values inside a bracket keep their value, those between fold into null."""
    seg, key = "CASE", "CASE"
    for i, (lo, hi) in enumerate(segments):
        upto = "true" if hi is None else f"v <= {number(hi)}"
        seg += f" WHEN {upto} THEN {i}"
        key += f" WHEN {upto} THEN " + ("v" if lo is None else f"if(v >= {number(lo)}, v, NULL)")
    last = segments[-1][1]
    rows = _doubles(column, "true" if last is None else f"v <= {number(last)}")
    return f"SELECT {c} AS c, {seg} END AS seg, {key} END AS key FROM {rows}"


def _read_ranks(df: DataFrame, targets: list[_Target]) -> list[_Target]:
    """Exact order statistics from the values in the brackets; returns misses.

    One scan per column.  Values outside the brackets fold into one null key per
    gap before the shuffle, so what moves is one count per value in a bracket.
    """
    by_column: dict[str, list[int]] = {}
    for i, t in enumerate(targets):
        by_column.setdefault(t.column, []).append(i)
    columns = list(by_column)
    keyed = select_over(
        df,
        [
            _keyed(name, _segments([targets[i] for i in by_column[name]]), c)
            for c, name in enumerate(columns)
        ],
    )
    running = (
        Window.partitionBy("c")
        .orderBy("seg", F.col("key").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    counted = (
        keyed.groupBy("c", "seg", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(running))
    )
    most = max(len(ids) for ids in by_column.values())

    def pick(slot: int, field: str) -> Column:
        ranks = ", ".join(
            str(getattr(targets[ids[slot]], field)) if slot < len(ids) else "NULL"
            for ids in by_column.values()
        )
        reached = f"upto > element_at(array({ranks}), c + 1)"
        return F.expr(f"min_by(struct(key), if({reached}, upto, NULL))").alias(f"{field}{slot}")

    picks = [pick(slot, field) for slot in range(most) for field in ("first", "second")]
    rows = {row.c: row for row in counted.groupBy("c").agg(F.max("upto").alias("upto"), *picks).collect()}
    missed = []
    for c, name in enumerate(columns):
        for slot, i in enumerate(by_column[name]):
            t, row = targets[i], rows.get(c)
            if row is None or row.upto <= t.second:
                t.hi = None
                missed.append(t)
                continue
            a, b = row[f"first{slot}"].key, row[f"second{slot}"].key
            if a is None:
                t.lo = None
                missed.append(t)
            elif b is None:
                t.hi = None
                missed.append(t)
            else:
                t.value = a if a == b else a + (b - a) * t.weight
    return missed


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: tuple[float, ...] = (0.25, 0.5, 0.75),
    accuracy: int = ACCURACY,
    bracket_values: int = BRACKET_VALUES,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation, nulls and NaN left out.

    Returns one list per column, null where a column has no value.  Only the
    brackets and the answers, a few numbers per column, reach the driver.
    """
    if not columns:
        return {}
    targets = _first_brackets(df, columns, probs, accuracy)
    todo = targets
    while todo:
        wide = [t for t in todo if t.size > bracket_values]
        for _ in range(_ROUNDS):
            if not wide:
                break
            _narrow(df, wide, accuracy, bracket_values)
            wide = [t for t in wide if t.size > bracket_values]
        todo = _read_ranks(df, todo)
        for t in todo:
            t.size = math.inf
    found = {(t.column, t.prob): t.value for t in targets}
    return {name: [found.get((name, p)) for p in probs] for name in columns}
