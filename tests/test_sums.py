"""Sums of products keep all complete rows, whatever rows with nulls stand beside them in a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import features, recommend, series
from plumbline.operators.series import fit_components
from plumbline.plans.ordered import ordered
from plumbline.plans.sums import lag_products, nested_fits, pair_correlations, vector_products


@pytest.mark.parametrize("width", [3, 16, 17, 40])
def test_one_null_a_partition_leaves_the_other_rows(spark, width):
    x = np.random.default_rng(width).normal(size=(80, width))
    rows = [[None if i % 20 == 0 and j == 1 else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    kept = x[np.arange(80) % 20 != 0]
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>").repartition(4)
    n, total, cross = vector_products(df, "v")
    assert n == len(kept)
    np.testing.assert_allclose(total, kept.sum(axis=0), atol=1e-9)
    np.testing.assert_allclose(cross, kept.T @ kept, atol=1e-9)
    names = [f"c{j}" for j in range(width)]
    wide = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    ratios = fit_components(wide, names, {c: (-10.0, 10.0) for c in names}, 2).ratios
    shares = np.linalg.eigvalsh(np.cov(kept.T, bias=True))[::-1]
    np.testing.assert_allclose(ratios, (shares / shares.sum())[:2], rtol=1e-6)


def test_unequal_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        vector_products(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"), "v")


def test_null_in_a_series_costs_only_its_own_steps(spark):
    y = np.random.default_rng(1).normal(size=400).cumsum()
    df = spark.range(400).select("id", F.get(F.lit(y.tolist()), F.col("id").cast("int")).alias("y"))
    df = df.withColumn("y", F.when(F.col("id") != 200, F.col("y")))
    cross = lag_products(ordered(df, ["id"], bucket_rows=100), "y", 1, 0.0)
    y[200] = np.nan
    t = np.arange(2, 400)
    x = np.column_stack([np.ones(len(t)), y[t - 1], y[t - 1] - y[t - 2], y[t] - y[t - 1]])
    x = x[~np.isnan(x).any(axis=1)]
    np.testing.assert_allclose(cross, x.T @ x, rtol=1e-9)


def _series(spark, y):
    rows = [(i, None if np.isnan(v) else float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "id int, y double").repartition(4)


def _design(y, lags, steps=True):
    """Rows of the regression at full length, complete ones only."""
    x = np.r_[np.nan, np.diff(y)] if steps else y
    t = np.arange(lags, len(y))
    level = [np.r_[np.nan, y[:-1]][t]] if steps else []
    out = np.column_stack([np.ones(len(t)), *level, *[x[t - k] for k in range(1, lags + 1)], x[t]])
    return out[~np.isnan(out).any(axis=1)]


def _ssr(x, p):
    beta = np.linalg.lstsq(x[:, :p], x[:, -1], rcond=None)[0]
    return float(((x[:, -1] - x[:, :p] @ beta) ** 2).sum())


@pytest.mark.parametrize("steps", [True, False])
@pytest.mark.parametrize("lags, bucket", [(0, 50), (1, 50), (7, 50), (300, 400)])
def test_lag_products_equal_the_whole_design(spark, lags, bucket, steps):
    y = np.random.default_rng(lags).normal(size=1500).cumsum()
    if lags < 300:
        y[[0, 49, 50, 51, 333, 700, 709, 1499]] = np.nan  # ends, edges of buckets, and runs shorter than the lags
    x = _design(y, lags, steps)
    rows = ordered(_series(spark, y), ["id"], bucket_rows=bucket)
    cross = lag_products(rows, "y", lags, 0.0, steps=steps)
    np.testing.assert_allclose(cross, x.T @ x, rtol=1e-8, atol=1e-7)
    fits = nested_fits(cross)
    for p in {1, 1 + lags // 2, x.shape[1] - 1}:
        assert fits[p] == pytest.approx(_ssr(x, p), rel=1e-7)


def test_unit_root_with_300_lags_and_a_level_far_from_zero(spark):
    y = 1e9 + np.random.default_rng(5).normal(size=2000).cumsum()
    found = series.adf_stationarity(_series(spark, y), ["id"], ["y"], lags=300, bucket_rows=500).first()
    z = y - y.mean()
    x = _design(z, 300)
    n = len(x)
    fits = [n * np.log(_ssr(x, p) / n) + 2 * p for p in range(2, 303)]
    best = int(np.argmin(fits))
    x = _design(z, best)
    a, b = x[:, :-1], x[:, -1]
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    error = np.sqrt(((b - a @ beta) ** 2).sum() / (len(b) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1])
    assert found.lag == best and found.rows_used == len(b)
    assert found.tau == pytest.approx(beta[1] / error, rel=1e-6)


@pytest.mark.parametrize("values", [[], [1.0], [1.0, 2.0], [np.nan, np.nan, np.nan], [3.0, 3.0, 3.0, 3.0, 3.0, 3.0]])
def test_short_and_constant_series_have_no_verdict(spark, values):
    df = _series(spark, np.array(values, dtype=float))
    row = series.adf_stationarity(df, ["id"], ["y"]).first()
    assert row.stationary is (len(values) == 6)  # a series that never moves
    assert features.cointegration(df.withColumn("z", F.col("y") * 2), ["id"], "y", "z").count() == 1
    assert features.acf(df, ["id"], "y", 3).count() == 4
    features.lag_selection(df, ["id"], "y", 2).collect()


def test_autocorrelations_and_orders_equal_numpy(spark):
    g = np.random.default_rng(8)
    y = np.zeros(1200)
    for t in range(2, len(y)):
        y[t] = 0.6 * y[t - 1] - 0.3 * y[t - 2] + g.normal()
    y = y + 1e6
    z = y - y.mean()
    r = np.array([z[k:] @ z[: len(z) - k] for k in range(301)]) / (z @ z)
    got = features.acf(_series(spark, y), ["id"], "y", 300, bucket_rows=350).orderBy("lag").toPandas()["acf"]
    np.testing.assert_allclose(got, r, atol=1e-9)
    partial = features.pacf(_series(spark, y), ["id"], "y", 12).orderBy("lag").toPandas()["pacf"]
    for k in (1, 2, 5, 12):  # last weight of the equations of order k
        matrix = r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        assert partial[k] == pytest.approx(np.linalg.solve(matrix, r[1 : k + 1])[-1], abs=1e-9)
    orders = features.lag_selection(_series(spark, y), ["id"], "y", 8, bucket_rows=100).orderBy("lag_order").toPandas()
    x = _design(z / z.std(), 8, steps=False)
    n = len(x)
    want = [n * np.log(_ssr(x, p) / n) + 2 * p for p in range(1, 10)]
    np.testing.assert_allclose(orders["aic"], want, rtol=1e-9)
    assert orders["best_bic"].idxmax() == 2 and orders["best_aic"].idxmax() == int(np.argmin(want))


def test_correlations_of_400_columns(spark):
    g = np.random.default_rng(3)
    base = g.normal(size=(300, 20))
    x = base @ g.normal(size=(20, 400)) + g.normal(size=(300, 400)) + 1e6
    x[g.random(x.shape) < 0.1] = np.nan
    x[:, 7] = 5.0
    names = [f"c{j}" for j in range(400)]
    cells = [(None if i % 3 else float("nan")) for i in range(300)]
    rows = [[cells[i] if np.isnan(v) else float(v) for v in r] for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(6)
    got = pair_correlations(df, names)
    for i, j in [(0, 1), (3, 399), (64, 63), (128, 127), (200, 350)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got[i, j] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
        assert got[i, j] == pytest.approx(got[j, i], abs=1e-12)
    assert np.isnan(got[7]).all() and np.isnan(got[:, 7]).all()
    some = names[:7]
    r = got[:7, :7].copy()
    np.fill_diagonal(r, 1.0)
    vif = {v.column_name: v.vif for v in features.multicollinearity(df, some).collect()}
    np.testing.assert_allclose([vif[c] for c in some], np.diag(np.linalg.pinv(r)), rtol=1e-9)
    assert recommend.correlations(df, names[:8]).where("r is null").count() == 7
    assert pair_correlations(df.limit(0), some).shape == (7, 7)
