"""Exact quantiles and ordered rows against brute force, large-table paths forced."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import clean, features, series
from plumbline.plans.ordered import POSITION, ordered
from plumbline.plans.profile import row_repeats
from plumbline.plans.quantiles import exact_quantiles

SMALL = {"window_rows": 10, "bucket_rows": 16}


@pytest.mark.parametrize("accuracy,values", [(10_000, 2_000_000), (100, 20), (50, 5)])
def test_quantiles_equal_numpy(spark, accuracy, values):
    rng = np.random.default_rng(1)
    columns = {
        "normal": rng.normal(size=3000),
        # A third of all rows is one value.
        "hot": np.where(rng.random(3000) < 0.34, 5.0, rng.exponential(10, 3000)),
        "few": rng.integers(0, 4, 3000).astype(float),
        "same": np.full(3000, 7.0),
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(5)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = exact_quantiles(df, list(columns), probs, accuracy, values)
    for name, x in columns.items():
        assert got[name] == pytest.approx(list(np.quantile(x, probs)), abs=1e-9)


def test_quantiles_of_tiny_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (float("nan"), None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], (0.25, 0.5)) == {"a": [1.25, 1.5], "b": [None, None]}


def _events(spark, n=400):
    rng = np.random.default_rng(2)
    key = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 6, n))
    value = [None if r < 0.4 else float(v) for r, v in zip(rng.random(n), rng.normal(size=n))]
    # Long runs without a value, also across bucket edges.
    value[100:160] = [None] * 60
    rows = [(int(k), int(i), v) for k, i, v in zip(key, rng.permutation(n), value)]
    return spark.createDataFrame(rows, "k int, t int, x double").repartition(7)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_positions_of_large_groups(spark, keys):
    df = _events(spark)
    got = ordered(df, ["t"], keys, **SMALL).df.toPandas().sort_values("t")
    want = got.groupby(keys).cumcount() if keys else pd.Series(range(len(got)), index=got.index)
    assert (got[POSITION] == want).all()


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("method", ["forward", "backward", "interpolate"])
def test_fills_do_not_depend_on_the_path(spark, keys, method):
    df = _events(spark)
    small = clean.fill_in_order(df, method, ["t"], ["x"], keys, **SMALL).toPandas().sort_values("t")
    plain = clean.fill_in_order(df, method, ["t"], ["x"], keys).toPandas().sort_values("t")
    pd.testing.assert_frame_equal(small.reset_index(drop=True), plain.reset_index(drop=True))
    whole = df.toPandas().sort_values("t")
    fill = {
        "forward": lambda s: s.ffill(), "backward": lambda s: s.bfill(),
        "interpolate": lambda s: s.interpolate(method="linear"),
    }[method]
    want = whole.groupby("k")["x"].transform(fill) if keys else fill(whole["x"])
    np.testing.assert_allclose(plain["x"].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_windows_reach_over_bucket_edges(spark, keys):
    df = _events(spark).fillna(0.0)
    got = features.rolling_stats(df, ["t"], "x", 9, keys, **SMALL).toPandas().sort_values("t")
    series_ = got.groupby("k")["x"] if keys else got["x"]
    want = series_.rolling(9, min_periods=1).mean()
    want = want.reset_index(level=0, drop=True).sort_index() if keys else want
    np.testing.assert_allclose(got.sort_index()["x_rolling_mean"], want.sort_index())
    weighted = features.ewma(df, ["t"], "x", 0.9, keys, **SMALL).toPandas()
    assert weighted["x_ewma"].notna().all()


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("alpha", [0.001, 0.5, 0.9999, 1.0])
def test_weighted_means_equal_the_recurrence(spark, keys, alpha):
    df = _events(spark)
    sizes = [SMALL, {}]
    got = [features.ewma(df, ["t"], "x", alpha, keys, **size).toPandas().sort_values("t").reset_index(drop=True) for size in sizes]
    means = lambda x: x.dropna().ewm(alpha=alpha, adjust=True).mean().reindex(x.index).ffill()
    whole = df.toPandas().sort_values("t").reset_index(drop=True)
    want = whole.groupby("k")["x"].transform(means) if keys else means(whole["x"])
    for found in got:
        np.testing.assert_allclose(found["x_ewma"].to_numpy(dtype=float), want.to_numpy(), rtol=1e-9, atol=1e-12)


def test_weighted_means_refuse_weights_out_of_range(spark):
    for alpha in (0.0, -1.0, 1.5):
        with pytest.raises(ValueError):
            features.ewma(_events(spark), ["t"], "x", alpha)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_windows_longer_than_a_bucket(spark, keys):
    df = _events(spark).fillna(0.0)
    small, plain = (
        features.rolling_stats(df, ["t"], "x", 50, keys, **size).toPandas().sort_values("t").reset_index(drop=True) for size in (SMALL, {})
    )
    pd.testing.assert_frame_equal(small, plain)
    small, plain = (features.seasonal_decompose(df, ["t"], "x", 75, **size).orderBy("t").toPandas() for size in (SMALL, {}))
    pd.testing.assert_frame_equal(small, plain)


def test_moving_average_looks_both_ways(spark):
    df = spark.range(100).select(F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("x"))
    small = features.seasonal_decompose(df, ["t"], "x", 7, **SMALL).orderBy("t").toPandas()
    plain = features.seasonal_decompose(df, ["t"], "x", 7).orderBy("t").toPandas()
    pd.testing.assert_frame_equal(small, plain)
    assert small["trend"].notna().sum() == 94 and small["residual"].abs().max() < 1e-9


def test_copies_are_counted_once(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x" * 100), (2, "x" * 100), (2, "y" * 100)], "a int, b string")
    assert tuple(row_repeats(df).first()) == (5, 3, 2)


def test_gaps_by_key(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-04"), ("b", "2024-01-01"), ("b", "2024-01-02")], "k string, d string")
    df = df.withColumn("d", F.col("d").cast("timestamp_ntz"))
    got = [(r.k, r.d.day) for r in features.gaps(df, "d", "1 DAY", ["k"]).orderBy("d").collect()]
    assert got == [("a", 2), ("a", 3)]


@pytest.mark.parametrize("sizes", [{}, {"window_rows": 10, "bucket_rows": 64}])
def test_series_models_equal_numpy(spark, sizes):
    rng = np.random.default_rng(3)
    n = 300
    x = np.zeros((n, 2))
    for t in range(1, n):
        x[t] = np.array([[0.5, 0.2], [-0.1, 0.6]]) @ x[t - 1] + rng.normal(size=2)
    df = spark.createDataFrame(pd.DataFrame({"t": range(n), "a": x[:, 0], "b": x[:, 1], "walk": np.cumsum(rng.normal(size=n))}))
    coefficients = series.var1_coefficients(df, ["t"], ["a", "b"], **sizes).toPandas()
    want = np.linalg.lstsq(np.column_stack([np.ones(n - 1), x[:-1]]), x[1:], rcond=None)[0].T
    np.testing.assert_allclose(coefficients["value"].to_numpy().reshape(2, 3), want, atol=1e-9)
    tests = series.adf_stationarity(df, ["t"], ["a", "walk"], **sizes).toPandas().set_index("column_name")
    for name, y in (("a", x[:, 0]), ("walk", df.toPandas().sort_values("t")["walk"].to_numpy())):
        tau, lag = _adf(y)
        assert tests.loc[name, "lag"] == lag
        assert tests.loc[name, "tau"] == pytest.approx(tau, abs=1e-6)
    assert tests.loc["a", "stationary"] and not tests.loc["walk", "stationary"]


def _adf(y):
    d, top = np.diff(y), series.max_lag(len(y))

    def fit(lag, start):
        t = np.arange(start, len(d))
        x = np.column_stack([np.ones(len(t)), y[t], *[d[t - k] for k in range(1, lag + 1)]])
        beta, *_ = np.linalg.lstsq(x, d[t], rcond=None)
        ssr = ((d[t] - x @ beta) ** 2).sum()
        error = np.sqrt(ssr / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        return len(t) * np.log(ssr / len(t)) + 2 * x.shape[1], beta[1] / error

    lag = int(np.argmin([fit(k, top)[0] for k in range(top + 1)]))
    return fit(lag, lag)[1], lag


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 20)) @ rng.normal(size=(20, 20))
    z = (x - x.mean(0)) / x.std(0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T, bias=True)))[::-1]
    wide = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(20)]))
    few, _ = series.pca_project(wide, ["c0", "c1", "c2"])
    many, fitted = series.pca_project(wide, wide.columns)
    vectors = wide.select(F.array(*wide.columns).alias("v"))
    arrays, by_array = series.pca_vectors(vectors, "v")
    np.testing.assert_allclose(fitted.ratios, values[:5] / values.sum(), atol=1e-9)
    np.testing.assert_allclose(by_array.ratios, fitted.ratios, atol=1e-9)
    np.testing.assert_allclose(
        np.sort(arrays.toPandas()["PC_1"]), np.sort(many.toPandas()["PC_1"]), atol=1e-6
    )
    assert few.select(F.abs(F.avg("PC_1")) < 1e-9).first()[0]


def test_partial_autocorrelation_of_first_order_series(spark):
    assert features._partial([1.0, 0.5, 0.25, 0.125]) == pytest.approx([1.0, 0.5, 0.0, 0.0])
