"""Detection with one model per key, against the single-series path and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import anomaly, keyed, series

SMALL = {"window_rows": 10, "bucket_rows": 16}


def _rows(n=60):
    rng = np.random.default_rng(11)
    out = []
    for key in (1, 2, None, 4, 5):
        length = 6 if key == 4 else n
        steps = rng.normal(size=(length, 3))
        walk = steps.cumsum(0) if key == 2 else steps
        if key == 1:
            walk[1:] += 0.6 * walk[:-1]
        walk[length // 2, 0] += 25
        for t in range(length):
            a, b, c = (float(v) for v in walk[t] * [1, 10, 1e-3] + [0, 5e8, 0])
            out.append((key, t, None if t % 7 == 3 else a, b, 1.0 if key == 5 else c))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(_rows(), "k int, t int, a double, b double, c double").repartition(6)


@pytest.mark.parametrize("sizes", [{}, SMALL])
@pytest.mark.parametrize("columns", [["a"], ["a", "b", "c"]])
def test_each_key_as_a_series_of_its_own(spark, df, columns, sizes):
    got = anomaly.detect_anomalies(df, ["t"], keys=["k"], columns=columns, **sizes).toPandas()
    assert len(got) == len(_rows())
    for key in (1, 2, None, 5):
        own = df.where(F.col("k").eqNullSafe(F.lit(key)))
        alone = anomaly.detect_anomalies(own, ["t"], columns=columns, lags=1).toPandas().sort_values("t")
        mine = got[got.k.isna() if key is None else got.k == key].sort_values("t")
        np.testing.assert_allclose(mine.score.to_numpy(), alone.score.to_numpy(), rtol=1e-6, atol=1e-6)
        assert (mine.anomaly.to_numpy() == alone.anomaly.to_numpy()).all() and mine.anomaly.any()
    assert got[got.k == 4].score.isna().all()


def test_statuses(spark, df):
    flat = df.withColumn("a", F.when(F.col("k") == 5, 3.0).otherwise(F.col("a")))
    got = keyed.detect_by_key(flat, ["t"], ["k"], ["a"]).select("k", "status").distinct().collect()
    assert {(r.k, r.status) for r in got} == {(1, "ok"), (2, "ok"), (None, "ok"), (4, "too few rows"), (5, "no valid column")}
    assert keyed.detect_by_key(df.select("k", "t", F.lit("x").alias("s")), ["t"], ["k"], []).first().status == "no numeric column"
    assert keyed.detect_by_key(df.where("false"), ["t"], ["k"], ["a"]).collect() == []


def test_no_loop_over_keys(spark):
    many = spark.range(3000).select((F.col("id") % 150).alias("k"), F.col("id").alias("t"), F.rand(3).alias("x"))
    models = keyed.fit_keys(keyed.prepare_keys(many, ["t"], ["k"], ["x"]), ["k"], 1)
    assert models._jdf.queryExecution().toString().count("MapInArrow") > 0 and models.count() == 150


def test_slopes_far_from_zero(spark):
    rng = np.random.default_rng(5)
    y = np.zeros(400)
    for t in range(1, 400):
        y[t] = 0.58 * y[t - 1] + rng.normal()
    df = spark.createDataFrame([(t, float(v + 1e9)) for t, v in enumerate(y)], "t int, y double")
    got = {r.term: r.value for r in series.var1_coefficients(df, ["t"], ["y"]).collect()}
    shifted = y + 1e9
    x, z = shifted[:-1] - shifted[:-1].mean(), shifted[1:] - shifted[1:].mean()
    assert got["y"] == pytest.approx(x @ z / (x @ x), abs=1e-6)
    assert got["const"] + got["y"] * shifted[:-1].mean() == pytest.approx(shifted[1:].mean(), rel=1e-12)
