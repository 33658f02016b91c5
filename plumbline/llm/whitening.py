"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers, so sums are exact and centring loses nothing: ``(n * x - sum) / n`` has an exact
numerator. Tasks add up their own centred products with numpy, Spark adds the tasks' matrices, and the driver sees one
square matrix of the vectors' width. There the scatter is factored as ``P L L' P'`` with the largest remaining diagonal
as pivot, and pairs of columns of L are rotated until all are orthogonal. ``L J`` then has the scatter's eigenvalues as
squared column norms and its eigenvectors as normalised columns: no product ``L' L`` is formed, and small eigenvalues
keep their relative accuracy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.materialize import materialize

#: Grid of an entry, the offset that makes it a count, and components returned at most.
GRID, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Columns below this share of the largest diagonal are no components; rotations end below this cosine.
RANK_TOLERANCE, ORTHOGONAL, SWEEPS = 1e-13, 1e-15, 60
#: Tasks' matrices are first added up in this many groups, so that no group holds those of all tasks.
GROUPS = 64


@dataclass(frozen=True)
class Whitener:
    """Sums and count of the fit list, unit components by falling eigenvalue, and the whole variance."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray  # one a row
    trace: float


def pivoted_cholesky(scatter: np.ndarray, tolerance: float = RANK_TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Lower-trapezoid factor and order of rows: ``scatter[order][:, order]`` is ``factor @ factor.T``.

    The factor has as many columns as pivots stay above ``tolerance`` times the largest diagonal.
    """
    rest, d = np.array(scatter, dtype=float), len(scatter)
    order, factor = np.arange(d), np.zeros((d, d))
    least = tolerance * max(rest.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        pivot = k + int(np.argmax(rest.diagonal()[k:]))
        if not rest[pivot, pivot] > least:
            return factor[:, :k], order
        for m in (rest, factor, order):
            m[[k, pivot]] = m[[pivot, k]]
        rest[:, [k, pivot]] = rest[:, [pivot, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray, limit: float = ORTHOGONAL, sweeps: int = SWEEPS) -> np.ndarray:
    """The columns of ``factor`` rotated in pairs until all are orthogonal.

    A sweep meets every pair once in rounds of disjoint pairs, which are rotated together.
    """
    columns = np.array(factor, dtype=float)
    r = columns.shape[1]
    seats = list(range(r)) + ([-1] if r % 2 else [])
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(a, b) for a, b in zip(seats[:half], seats[: half - 1 : -1]) if a >= 0 and b >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = (np.array(side) for side in zip(*pairs))
            x, y = columns[:, p], columns[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(c) > limit * np.sqrt(a * b)
            if not off.any():
                continue
            turned = True
            zeta = (b - a) / (2 * np.where(off, c, 1.0))
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = np.where(off, 1 / np.hypot(1.0, t), 1.0)
            sin = np.where(off, cos * t, 0.0)
            columns[:, p], columns[:, q] = cos * x - sin * y, sin * x + cos * y
        if not turned:
            break
    return columns


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above the rank tolerance, falling, and their unit eigenvectors, one a row, the largest entry positive."""
    factor, order = pivoted_cholesky(scatter)
    columns = one_sided_jacobi(factor)
    norms = np.sqrt((columns * columns).sum(0))
    first = np.argsort(-norms, kind="stable")
    vectors = np.zeros((len(norms), len(scatter)))
    vectors[:, order] = (columns[:, first] / norms[first]).T
    largest = np.abs(vectors).argmax(1) if len(vectors) else np.empty(0, int)
    vectors *= np.sign(vectors[np.arange(len(vectors)), largest])[:, None]
    return norms[first] ** 2, vectors


def on_grid(vectors: DataFrame, grid: int = GRID, offset: int = OFFSET) -> DataFrame:
    """``vec_id`` and ``x``, the whole numbers ``floor(grid * c) + offset`` of the entries c of ``embedding``.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out, and so are those of another
    length than the commonest (the longest of equally common ones).
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (lengths.d if lengths else 0))
    # Numbers beyond a long stay at its ends.
    whole = lambda c: F.floor(F.least(F.greatest(c * grid, F.lit(-4e18)), F.lit(4e18))) + F.lit(offset).cast("long")
    return rows.select("vec_id", F.transform("v", whole).alias("x"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    lists = batch.column(0)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def _sums(fit: DataFrame) -> tuple[int, int, list[int]]:
    """Vectors of the fit list, their width, and the exact sum of each entry."""
    entries = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i")
    cells = entries.agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    return (cells[0].n if cells else 0), len(cells), [int(r.s) for r in sorted(cells, key=lambda r: r.i)]


def _products(fit: DataFrame, width: int, transform, cells: int) -> np.ndarray:
    """Sum over the fit list of ``z' z`` with ``z = transform(x)`` of ``cells`` columns: tasks, then groups, then all."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((cells, cells))
        for batch in batches:
            if batch.num_rows:
                z = transform(_matrix(batch, width))
                total += z.T @ z
        rows = [pa.array(np.arange(cells), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(rows, names=["i", "row"])

    partial = fit.select("x").mapInArrow(own, "i int, row array<double>").withColumn("g", F.spark_partition_id() % GROUPS)

    def added(table: pa.Table) -> pa.Table:
        rows = np.array(table.column("row").to_pylist())
        return pa.table({"i": table.column("i")[:1], "row": pa.array([rows.sum(0)], pa.list_(pa.float64()))})

    grouped = partial.groupBy("g", "i").applyInArrow(added, "i int, row array<double>")
    out = np.zeros((cells, cells))
    for r in grouped.groupBy("i").applyInArrow(added, "i int, row array<double>").collect():
        out[r.i] = r.row
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - sums / n`` with an exact numerator wherever it fits a long."""
    if n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 62:
        return (n * x - sums.astype(np.int64)) / n
    base, rest = (np.array(v) for v in zip(*(divmod(int(s), n) for s in sums)))
    return (x - base.astype(np.int64)).astype(float) - rest.astype(float) / n


def fit(distinct: DataFrame) -> Whitener | None:
    """Components of a fit list, a table of distinct ``x``; None without rows.

    Products are of centred vectors, the divisor is n. Directions without variance are no components.
    """
    n, width, sums = _sums(distinct)
    if not n:
        return None
    exact = np.array(sums, dtype=object)
    scatter = _products(distinct, width, lambda x: _centred(x, n, exact), width)
    values, vectors = principal((scatter + scatter.T) / (2 * n))
    return Whitener(n, exact, values, vectors, float(scatter.trace() / n))


def identity_error(distinct: DataFrame, model: Whitener, components: int = COMPONENTS) -> float:
    """Largest entry of the whitened fit list's covariance less the identity; 0 without components."""
    vectors, scale = model.components[:components], np.sqrt(model.eigenvalues[:components])
    k, width = len(vectors), model.components.shape[1]
    if not k:
        return 0.0
    n, sums = model.n, model.sums
    project = lambda x: _centred(x, n, sums) @ vectors.T / scale
    # A first pass with a column of ones tells the means, which are zero but for rounding; the second takes them off.
    mean = _products(distinct, width, lambda x: np.c_[np.ones(len(x)), project(x)], k + 1)[0, 1:] / n
    covariance = _products(distinct, width, lambda x: project(x) - mean, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(grid: DataFrame, model: Whitener, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component from 1, deviation, whitened, explained.

    ``deviation`` is the exact sum over entries of ``(n * x - sum) ** 2``, decimal(38, 0), null beyond 38 digits.
    """
    key = grid.schema["vec_id"].dataType.simpleString()
    vectors, values = model.components[:components], model.eigenvalues[:components]
    k, width, n, sums = len(vectors), model.components.shape[1], model.n, model.sums
    scale, shares = np.sqrt(values), values / model.trace if model.trace > 0 else values

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = max(int(s) // n + 1 for s in sums) if len(sums) else 0
        for batch in batches:
            m = batch.num_rows
            if not m or not k:
                continue
            x = _matrix(batch.select(["x"]), width)
            largest = n * max(int(np.abs(x).max()), kept)
            small = largest < 1 << 62
            gaps = n * x - sums.astype(np.int64) if small else n * x.astype(object) - sums
            if not small or width * int(np.abs(gaps).max()) ** 2 >= 1 << 62:
                gaps = gaps.astype(object)
            deviation = (gaps * gaps).sum(1)
            z = _centred(x, n, sums) @ vectors.T / scale
            arrays = [
                batch.column(batch.schema.get_field_index("vec_id")).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array([str(int(d)) for d in deviation for _ in range(k)]),
                pa.array(z.ravel()),
                pa.array(np.tile(shares, m)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "deviation", "whitened", "explained"])

    schema = f"vec_id {key}, component int, deviation string, whitened double, explained double"
    out = grid.select("vec_id", "x").mapInArrow(rows, schema)
    return out.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened ``vectors`` (vec_id, embedding; other columns are not read): vec_id, component, n, deviation, whitened,
    explained, identity_error.

    The fit list holds each distinct vector once, so groups of copies do not pull the components; copies are folded
    before the shuffle. Vectors left out are those that ``on_grid`` leaves out. An empty table, a single distinct vector
    or one without variance has no components and gives no rows. Null and repeated ids get their own rows.
    """
    grid = on_grid(vectors)
    distinct = materialize(grid.select("x").distinct(), "fit-list")
    model = fit(distinct)
    if model is None:
        key = grid.schema["vec_id"].dataType.simpleString()
        schema = f"vec_id {key}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, model, components)
    return whiten(grid, model, components).select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened; a deviation that no long can hold is null."""
    rows = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))
