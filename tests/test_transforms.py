"""Fitted powers and distances of distributions against numpy, with columns that hold little or nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import features


def _table(spark, values, name="x"):
    rows = [(None if v is None else float(v),) for v in values]
    return spark.createDataFrame(rows, f"{name} double").repartition(3)


def _likelihood(x, lam):
    z = np.log(x) - np.log(x).mean()
    return -len(x) / 2 * np.log(np.var(np.expm1(z * lam) / lam if abs(lam) > 1e-12 else z))


@pytest.mark.parametrize("shape", [0.5, -3.0, 0.0, 7.0])
def test_power_equals_a_dense_search(spark, shape):
    g = np.random.default_rng(1)
    base = g.normal(20.0, 1.0, size=3000)
    x = np.exp(base / 8) if shape == 0 else base ** (1 / shape)
    grid = np.arange(-20, 20, 0.05)
    for step in (1e-3, 1e-5):
        best = grid[np.argmax([_likelihood(x, p) for p in grid])]
        grid = np.arange(best - 60 * step, best + 60 * step, step)
    best = grid[np.argmax([_likelihood(x, p) for p in grid])]
    assert features.box_cox_lambda(_table(spark, [*x, None, -1.0, 0.0, np.nan]), "x") == pytest.approx(best, abs=1e-4)


def test_power_without_positive_values_and_of_one_value(spark):
    out, lam = features.box_cox(_table(spark, [-1.0, 0.0, None]), "x")
    assert lam is None and {r.x for r in out.collect()} == {None}
    assert features.box_cox_lambda(_table(spark, []), "x") is None
    out, lam = features.box_cox(_table(spark, [3.0, 3.0, None]), "x")
    assert lam == 1.0 and sorted(r.x for r in out.where("x is not null").collect()) == pytest.approx([2.0, 2.0])


def _distances(a, b):
    points = np.union1d(a, b)
    fa = np.searchsorted(np.sort(a), points, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), points, side="right") / len(b)
    gap = np.abs(fa - fb)
    return gap.max(), (gap[:-1] * np.diff(points)).sum()


def test_distances_equal_numpy_over_ranges(spark):
    g = np.random.default_rng(2)
    a, b = g.normal(size=4000), np.r_[g.normal(0.3, 2.0, size=2500), np.full(2500, 0.25)]  # half of one side is one value
    before = _table(spark, [*a, None, np.nan]).withColumn("y", F.lit(None).cast("double")).withColumn("w", F.round("x"))
    after = _table(spark, b).withColumn("y", F.col("x")).withColumn("w", F.round("x"))
    rows = {r.column_name: r for r in features.imputation_check(before, after, ["x", "y", "w"]).collect()}
    for name, (p, q) in {"x": (a, b), "w": (a.round(), b.round())}.items():
        ks, area = _distances(p, q)
        assert rows[name].ks_distance == pytest.approx(ks, abs=1e-12)
        assert rows[name].wasserstein_distance == pytest.approx(area, rel=1e-9)
    assert rows["y"].ks_distance is None and rows["y"].wasserstein_distance is None


def test_distances_of_equal_tables_and_single_values(spark):
    from plumbline.plans.distances import distribution_distances

    one = _table(spark, [2.0, 2.0])
    assert distribution_distances(one, one, ["x"]) == {"x": (0.0, 0.0)}
    assert distribution_distances(one, _table(spark, [5.0]), ["x"]) == {"x": (1.0, 3.0)}
    assert distribution_distances(one, _table(spark, []), ["x"]) == {"x": (None, None)}
    assert distribution_distances(_table(spark, [0.0]), _table(spark, [-0.0]), ["x"]) == {"x": (0.0, 0.0)}
    assert distribution_distances(one, one, []) == {}
