"""Anomalies of many series at once: one model per key, fitted and scored without a loop over keys.

Filling, scaling, components, differencing, VAR(1) and residual scores are all linear in a row and the two before it.
So each key needs only the sums of products of ``[1, z(t), z(t-1), z(t-2)]``, one aggregated row however long its
series is. Workers take those rows in batches and solve the systems of all keys of a batch together; what comes back
is one vector of weights per component, and a row's score is a dot product behind a single join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.schema import normalize, quoted
from ..plans.materialize import materialize
from ..plans.ordered import POSITION, ordered, slide
from . import series as s

MIN_ROWS = 10
_TINY = 1e-300


def _symmetric(cells: np.ndarray, size: int) -> np.ndarray:
    """Matrices of a batch from their upper triangles."""
    out = np.zeros((len(cells), size, size))
    i, j = np.triu_indices(size)
    out[:, i, j] = cells
    out[:, j, i] = cells
    return out


def _fit(normal: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Least squares of a batch; singular systems get the shortest solution."""
    return np.linalg.pinv(normal, hermitian=True) @ target


def _through(matrix: np.ndarray, left: np.ndarray) -> np.ndarray:
    return left @ matrix @ np.swapaxes(left, -1, -2)


def _unit_root(all_rows: np.ndarray, later: np.ndarray, q: int) -> np.ndarray:
    """Whether each component of each key is stationary: Dickey-Fuller with constant and no lag or one, by AIC.

    ``all_rows`` are products of ``[1, y(t), y(t-1)]``, ``later`` of ``[1, y(t), y(t-1), y(t-2)]``.
    """
    out = np.zeros((len(later), q), dtype=bool)
    for c in range(q):
        now, before, first = 1 + c, 1 + q + c, 1 + 2 * q + c
        rows = np.zeros((4, later.shape[1]))  # 1, y(t-1), step before, step
        rows[0, 0] = rows[1, before] = rows[2, before] = rows[3, now] = 1.0
        rows[2, first] = rows[3, before] = -1.0
        whole = _through(later, rows)
        short = _through(all_rows, rows[:, : all_rows.shape[1]])
        n = np.maximum(whole[:, 0, 0], 1.0)
        scores = []
        for lag in (0, 1):
            x = [0, 1, 2][: 2 + lag]
            beta = _fit(whole[:, x][:, :, x], whole[:, x, 3][..., None])[..., 0]
            ssr = np.maximum(whole[:, 3, 3] - (beta * whole[:, x, 3]).sum(-1), _TINY)
            scores.append(n * np.log(ssr / n) + 2 * (lag + 2))
        taus = []
        for lag, sums in ((0, short), (1, whole)):
            x = [0, 1, 2][: 2 + lag]
            inverse = np.linalg.pinv(sums[:, x][:, :, x], hermitian=True)
            beta = (inverse @ sums[:, x, 3][..., None])[..., 0]
            ssr = np.maximum(sums[:, 3, 3] - (beta * sums[:, x, 3]).sum(-1), _TINY)
            error = np.sqrt(np.maximum(ssr / np.maximum(sums[:, 0, 0] - len(x), 1.0) * inverse[:, 1, 1], 0.0))
            taus.append(np.where(error > 0, beta[:, 1] / np.where(error > 0, error, 1.0), -np.inf))
        out[:, c] = np.where(scores[1] < scores[0], taus[1], taus[0]) <= s.UNIT_ROOT_5_PERCENT
    return out


def _solve(spread: np.ndarray, all_rows: np.ndarray, later: np.ndarray, k: int, q: int, difference: bool):
    """Weights over ``[1, z(t), z(t-1), z(t-2)]`` of every component's standardised residual, for a batch of keys."""
    b = len(spread)
    _, vectors = np.linalg.eigh(spread)
    load = np.swapaxes(vectors[:, :, ::-1][:, :, :q], 1, 2)  # key, component, column
    wide = np.zeros((b, 1 + 3 * q, 1 + 3 * k))
    wide[:, 0, 0] = 1.0
    for lag in range(3):
        wide[:, 1 + lag * q : 1 + (lag + 1) * q, 1 + lag * k : 1 + (lag + 1) * k] = load
    later_y = _through(later, wide)
    all_y = _through(all_rows, wide[:, : 1 + 2 * q, : 1 + 2 * k])
    moving = ~_unit_root(all_y, later_y, q) if difference else np.zeros((b, q), dtype=bool)
    any_moving = moving.any(1)
    grown = np.zeros_like(later_y)
    grown[:, : 1 + 2 * q, : 1 + 2 * q] = all_y
    sums = np.where(any_moving[:, None, None], later_y, grown)
    # Rows of 1, y'(t), y'(t-1), where y' is the step of a moving component.
    take = np.zeros((b, 1 + 2 * q, 1 + 3 * q))
    take[:, 0, 0] = 1.0
    for c in range(q):
        for lag in (0, 1):
            take[:, 1 + lag * q + c, 1 + lag * q + c] = 1.0
            take[:, 1 + lag * q + c, 1 + (lag + 1) * q + c] = -1.0 * moving[:, c]
    m = _through(sums, take)
    x = [0, *range(1 + q, 1 + 2 * q)]
    beta = _fit(m[:, x][:, :, x], m[:, x, 1 : 1 + q])  # key, term, equation
    residual = np.zeros((b, q, 1 + 2 * q))
    residual[:, range(q), range(1, 1 + q)] = 1.0
    residual[:, :, x] -= np.swapaxes(beta, 1, 2)
    n = sums[:, 0, 0]
    mean = (residual @ m[:, :, :1])[..., 0] / np.maximum(n, 1.0)[:, None]
    square = np.einsum("bqi,bij,bqj->bq", residual, m, residual)
    deviation = np.sqrt(np.maximum(square - n[:, None] * mean**2, 0.0) / np.maximum(n - 1, 1.0)[:, None])
    deviation[deviation == 0] = s.MIN_SPREAD
    residual[:, :, 0] -= mean
    weights = (residual / deviation[..., None]) @ take @ wide
    return weights, np.swapaxes(beta, 1, 2), moving, n >= q + 2


def _solver(keys: int, k: int, q: int, difference: bool, min_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = [np.array(batch.column(keys + 2 + i).to_pylist(), dtype=float) for i in range(3)]
            spread, all_rows, later = (_symmetric(np.nan_to_num(c), size) for c, size in zip(cells, (k, 1 + 2 * k, 1 + 3 * k)))
            weights, beta, moving, enough = _solve(spread, all_rows, later, k, q, difference)
            rows, some = (batch.column(keys + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            status = np.where(rows < min_rows, "too few rows", np.where(some == 0, "no valid column", np.where(enough, "ok", "no fit")))
            lists = [pa.array(list(x.reshape(len(x), -1)), pa.list_(pa.float64())) for x in (weights, beta)]
            columns = [*[batch.column(i) for i in range(keys)], batch.column(keys), pa.array(status.tolist()), *lists]
            columns.append(pa.array(moving.tolist(), pa.list_(pa.bool_())))
            names = [*[batch.schema.names[i] for i in range(keys)], "rows", "status", "weights", "coefficients", "differenced"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _key(i: int) -> str:
    return f"_key{i}"


def _joined(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & quoted(c).eqNullSafe(F.col(_key(i)))
    return rows.join(side, same, how).drop(*[_key(i) for i in range(len(keys))])


def prepare_keys(df: DataFrame, order_by: list[str], keys: list[str], columns: list[str], **sizes) -> DataFrame:
    """Rows with ``_z{i}``, ``_z{i}_1``, ``_z{i}_2``: filled and scaled values of a row and the two before it, per key.

    A column with half of a key's values missing or without spread is zero for that key. Written once.
    """
    rows = ordered(df, order_by, keys, **sizes)
    work = {f"_w{i}": c for i, c in enumerate(columns)}
    copies = rows.with_df(rows.df.withColumns({w: s.value(c) for w, c in work.items()}))
    filled = s.impute_rows(copies, list(work))
    stored = filled.with_df(materialize(filled.df, "keyed"))
    facts = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        valid = (F.count(F.lit(1)) - F.count(quoted(c))) / F.count(F.lit(1)) < 0.5
        spread = F.coalesce(F.stddev_samp(s.value(c)) > s.MIN_SPREAD, F.lit(False))
        facts += [(valid & spread).alias(f"_ok{i}"), F.avg(f"_w{i}").alias(f"_m{i}"), F.stddev_pop(f"_w{i}").alias(f"_s{i}")]
    stats = stored.df.groupBy(*[quoted(c).alias(_key(i)) for i, c in enumerate(keys)]).agg(*facts)
    joined = _joined(stored.df, stats, keys)
    scaled = {
        f"_z{i}": F.when(F.col(f"_ok{i}"), (F.col(f"_w{i}") - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0))
        for i in range(len(columns))
    }
    z = joined.withColumns({name: F.coalesce(c, F.lit(0.0)) for name, c in scaled.items()})
    some = sum((F.col(f"_ok{i}").cast("int") for i in range(len(columns))), F.lit(0))
    z = z.withColumn("_some", some).drop(*work, *[f"_{x}{i}" for x in ("ok", "m", "s") for i in range(len(columns))])
    back = {f"_z{i}_{lag}": (lambda w, i=i, lag=lag: F.lag(f"_z{i}", lag).over(w)) for lag in (1, 2) for i in range(len(columns))}
    return materialize(slide(stored.with_df(z), back, back=2).df, "keyed")


def _terms(k: int, lags: int) -> list[Column]:
    return [F.lit(1.0), *[F.col(f"_z{i}" + (f"_{lag}" if lag else "")) for lag in range(lags) for i in range(k)]]


def fit_keys(prepared: DataFrame, keys: list[str], k: int, max_components: int = s.MAX_COMPONENTS, difference: bool = True) -> DataFrame:
    """One row per key: rows, status, weights, coefficients (equation by equation, constant first), differenced."""
    products = lambda terms, where: F.array(
        *[F.sum(F.when(where, terms[i] * terms[j])) for i in range(len(terms)) for j in range(i, len(terms))]
    )
    q = max(1, min(max_components, k, MIN_ROWS - 1))
    place = F.col(POSITION)
    spread = products(_terms(k, 1)[1:], F.lit(True))
    sums = prepared.groupBy(*[quoted(c) for c in keys]).agg(
        F.count(F.lit(1)).alias("_rows"), F.max("_some").alias("_some"), spread.alias("_spread"),
        products(_terms(k, 2), place >= 1).alias("_all"), products(_terms(k, 3), place >= 2).alias("_later"),
    )
    fields = [f"{_key(i)} {prepared.schema[c].dataType.simpleString()}" for i, c in enumerate(keys)]
    schema = ", ".join([*fields, "rows bigint, status string, weights array<double>, coefficients array<double>, differenced array<boolean>"])
    renamed = sums.select(*[quoted(c).alias(_key(i)) for i, c in enumerate(keys)], "_rows", "_some", "_spread", "_all", "_later")
    found = renamed.mapInArrow(_solver(len(keys), k, q, difference, MIN_ROWS), schema)
    return found


def detect_by_key(
    df: DataFrame,
    order_by: list[str],
    keys: list[str],
    columns: list[str] | None = None,
    threshold: float = 2.0,
    max_components: int = s.MAX_COMPONENTS,
    difference: bool = True,
    **sizes,
) -> DataFrame:
    """``df`` with ``score``, ``anomaly`` and ``status``, every key its own series.

    A row without enough rows before it has no score, nor has any row of a key with fewer than ``MIN_ROWS`` rows,
    without a usable column, or too short for its model. Null keys are one series.
    """
    df = normalize(df)
    names = columns if columns is not None else [c for c in s.series_columns(df) if c not in keys]
    if not names:
        return df.select("*", F.lit(None).cast("double").alias("score"), F.lit(False).alias("anomaly"), F.lit("no numeric column").alias("status"))
    k = len(names)
    prepared = prepare_keys(df, order_by, keys, names, **sizes)
    models = materialize(fit_keys(prepared, keys, k, max_components, difference), "models")
    scored = _joined(prepared, models.withColumnRenamed("status", "_status"), keys)
    q, m = max(1, min(max_components, k, MIN_ROWS - 1)), 1 + 3 * k
    terms = [F.coalesce(x, F.lit(0.0)) for x in _terms(k, 3)]
    dot = lambda c: F.abs(sum((F.get("weights", F.lit(c * m + i)) * x for i, x in enumerate(terms)), F.lit(0.0)))
    parts = [dot(c) for c in range(q)]
    whole = F.greatest(*parts) if q > 1 else parts[0]
    needed = 1 + F.exists("differenced", lambda d: d).cast("int")
    score = F.when((F.col("_status") == "ok") & (F.col(POSITION) >= needed), whole)
    rows = scored.withColumn("score", score)
    return rows.select(
        *[quoted(c) for c in df.columns], "score", F.coalesce(F.col("score") > threshold, F.lit(False)).alias("anomaly"),
        F.col("_status").alias("status"),
    )


def coefficients_by_key(df: DataFrame, order_by: list[str], keys: list[str], column: str, **sizes) -> DataFrame:
    """Per key: rows, constant and slope of the first-order model of one scaled column; null where there is no model."""
    prepared = prepare_keys(normalize(df), order_by, keys, [column], **sizes)
    models = fit_keys(prepared, keys, 1, 1, difference=False)
    told = lambda i: F.when(F.col("status") == "ok", F.get("coefficients", F.lit(i)))
    return models.select(
        *[F.col(_key(i)).alias(c) for i, c in enumerate(keys)], "rows", told(0).alias("constant"), told(1).alias("slope"), "status"
    )
