"""Column profiles from one pass: types of every kind, large-column ranks, plans that do not grow with the columns."""

import datetime
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.schema import normalize
from plumbline.operators import quality
from plumbline.plans.frequencies import frequencies
from plumbline.plans.profile import column_profile, measured

TIME = datetime.datetime(2024, 3, 10, 2, 30)  # a wall-clock time that some zones skip


@pytest.fixture(scope="module")
def mixed(spark):
    schema = (
        "i int, f double, d decimal(9,2), wide decimal(30,5), t timestamp_ntz, day date, ok boolean, s string, long string, "
        "raw binary, arr array<int>, none double, `odd.name {x}` int"
    )
    rows = [
        (1, 1.5, Decimal("1.25"), Decimal("7.5"), TIME, TIME.date(), True, "a1", "x" * 100, b"\x01", [1], None, 1),
        (2, float("nan"), Decimal("1.25"), None, TIME, None, False, "12", "Xy" * 50, b"\x02", None, None, 2),
        (None, float("inf"), None, Decimal("8.5"), TIME + datetime.timedelta(hours=1), None, None, "Ab", None, b"\x01", [], None, 3),
        (2, -1.5, Decimal("3.00"), Decimal("8.5"), None, TIME.date(), True, None, "x" * 100, None, [2], None, 50),
    ]
    return spark.createDataFrame(rows, schema)


def test_facts_of_every_kind_of_column(mixed):
    rows = {r.column_name: r for r in column_profile(normalize(mixed)).collect()}
    assert [r.position for r in rows.values()] == list(range(13))
    assert {n: r.unique_count for n, r in rows.items()} == {
        "i": 2, "f": 3, "d": 2, "wide": 2, "t": 2, "day": 1, "ok": 2, "s": 3, "long": 2, "raw": 2, "arr": None, "none": 0, "odd.name {x}": 4
    }
    assert all(r.row_count == 4 and r.non_null + r.null_count == 4 for r in rows.values())
    assert (rows["d"].min_value, rows["d"].max_value) == (1.25, 3.0) and rows["d"].mean_value == pytest.approx(5.5 / 3)
    assert (rows["wide"].min_value, rows["wide"].max_value) == (7.5, 8.5)
    assert (rows["f"].min_value, rows["f"].max_value) == (-1.5, None)
    assert rows["t"].min_value is None and rows["arr"].non_null == 3 and rows["arr"].mixed_case is None
    assert (rows["s"].all_numbers, rows["s"].mixed_case, rows["long"].mixed_case) == (False, 1, 1)
    assert rows["i"].all_numbers is None


@pytest.mark.parametrize("window_bytes", [0, 1 << 26])
def test_quantiles_of_frequencies_equal_numpy(spark, window_bytes):
    rng = np.random.default_rng(3)
    columns = {
        "normal": rng.normal(size=3000), "hot": np.where(rng.random(3000) < 0.34, 5.0, rng.exponential(10, 3000)),
        "few": rng.integers(0, 4, 3000).astype(float), "same": np.full(3000, 7.0),
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).withColumn("empty", F.lit(None).cast("int")).repartition(5)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    counted = frequencies(df, keep=True)
    got = counted.quantiles(probs, window_bytes)
    counted.close()
    for name, x in columns.items():
        assert got[name] == pytest.approx(list(np.quantile(x, probs)), abs=1e-9)
    assert got["empty"] == [None] * 6


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


def test_scans_do_not_grow_with_columns(spark, tmp_path):
    wide = [F.col("id").alias(f"n{i}") if i % 3 else F.col("id").cast("string").alias(f"s{i}") for i in range(300)]
    spark.range(50).select(*wide[:6]).write.parquet(f"{tmp_path}/few")
    spark.range(50).select(*wide).write.parquet(f"{tmp_path}/many")
    few, many = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("few", "many"))
    assert _scans(frequencies(few).facts()) == _scans(frequencies(many).facts()) == 2
    profile = column_profile(many).collect()
    assert len(profile) == 300 and {r.unique_count for r in profile} == {50}
    facts, fences = measured(many, approx=True)
    assert facts.count() == 300 and len(fences) == 200


def test_approximate_profile_reads_the_table_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"x": np.r_[rng.normal(size=2900), np.full(100, 50.0)], "g": rng.integers(0, 9, 3000)}))
    seen = spark.sparkContext.accumulator(0)
    counted = df.mapInPandas(lambda parts: (seen.add(len(p)) or p for p in parts), df.schema)
    rough = quality.table_metrics(counted, "t", approx=True).first()
    assert seen.value == 3000
    exact = quality.table_metrics(df, "t").first()
    assert rough.accuracy == pytest.approx(exact.accuracy, abs=0.3) and rough.uniqueness == pytest.approx(exact.uniqueness, abs=5)
    assert (rough.completeness, rough.validity) == (exact.completeness, exact.validity)


def test_written_frequencies_are_deleted(spark, mixed, tmp_path):
    import glob

    from plumbline.plans.materialize import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/*"))
    quality.table_metrics(mixed, "t").collect()
    assert set(glob.glob(f"{folder}/*")) == before


def test_profile_of_empty_tables(spark):
    none = spark.createDataFrame([], "a int, s string, v array<int>")
    rows = column_profile(none).collect()
    assert [(r.row_count, r.non_null, r.unique_count) for r in rows] == [(0, 0, 0), (0, 0, 0), (0, 0, None)]
    assert [r.all_numbers for r in rows] == [None, True, None]
    assert quality.table_metrics(none, "t").first().quality_score == 0.0
    assert {r.score for r in quality.accuracy_iqr(none, "t").collect()} == {0.0}
    facts, fences = measured(none, approx=True)
    assert [r.row_count for r in facts.collect()] == [0, 0, 0] and fences == {"a": None}


def test_accuracy_counts_outliers_without_folding_distinct_values(spark, monkeypatch):
    rng = np.random.default_rng(17)
    values = [float(x) for x in rng.standard_t(2, 400)] + [float("nan"), None, 1e300, -0.0]
    rows = [(v, i * 7 if i % 9 else None, Decimal(int(rng.exponential(5) * 100)) / 100, "t", 5) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "a double, `b.c` bigint, d decimal(12,2), s string, flat int")

    def refuse(*_, **__):
        raise AssertionError("distinct values are folded")

    monkeypatch.setattr("plumbline.plans.profile.frequencies", refuse)
    found = {r.column_name: r.score for r in quality.accuracy_iqr(df, "t").collect()}
    for k, name in enumerate(("a", "b.c", "d")):
        own = np.array([float(r[k]) for r in rows if r[k] is not None and r[k] == r[k]])
        q1, q3 = np.quantile(own, (0.25, 0.75))
        out = ((own < q1 - 1.5 * (q3 - q1)) | (own > q3 + 1.5 * (q3 - q1))).sum()
        assert out or name == "b.c"
        assert found[name] == pytest.approx(100 - 100 * out / len(own), abs=1e-9)
    assert found["s"] == found["flat"] == 100.0
