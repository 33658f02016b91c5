"""Hand-computed results on small frames: empty, constant, null, NaN, infinite, ties."""

import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions.dates import parse_timestamp
from plumbline.functions.values import json_safe, parse_number
from plumbline.operators import anomaly, clean, detail, quality, recommend, rows, series
from plumbline.sources import files, jdbc
from plumbline.plans.materialize import fresh_path

INF = float("inf")


def one(df):
    return df.first().asDict()


def test_empty_table_scores_zero(spark):
    df = spark.createDataFrame([], "a double, b string")
    got = one(quality.table_metrics(df, "t"))
    assert got["total_rows"] == 0 and got["quality_score"] == 0.0
    assert one(detail.detail_metrics(df, "t"))["volumetry"] == 0.0


def test_scores_of_a_small_table(spark):
    df = spark.createDataFrame(
        [(1.0, "5", True), (2.0, "6", True), (2.0, None, False), (float("nan"), "7", None), (100.0, "8", None)],
        "x double, s string, b boolean",
    )
    got = {r.column_name: r for r in quality.column_metrics(df, "t").collect()}
    assert got["x"].completeness == 80.0 and got["x"].uniqueness == 75.0
    # Quartiles 1.75 and 26.5, upper fence 63.625: one of four is outside.
    assert got["x"].accuracy == 75.0 and got["x"].mean_value == 26.25
    assert got["s"].validity == 95.0 and got["s"].uniqueness == 100.0
    assert got["b"].accuracy == 100.0 and got["b"].completeness == 60.0


def test_all_null_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 3, None)] * 4, "a double, c int, s string")
    got = {r.column_name: r for r in quality.column_metrics(df, "t").collect()}
    assert got["a"].completeness == 0.0 and got["a"].uniqueness == 0.0 and got["a"].accuracy == 100.0
    assert got["s"].validity == 95.0
    assert got["c"].uniqueness == 25.0 and got["c"].accuracy == 100.0


def test_infinite_results_become_null(spark):
    df = spark.createDataFrame([(INF,), (1.0,), (-INF,)], "x double")
    assert [r.x for r in json_safe(df).collect()] == [None, 1.0, None]
    assert [r.x for r in json_safe(df, legacy=True).collect()] == [0.0, 1.0, 0.0]
    got = quality.column_metrics(df, "t").first()
    assert got.max_value is None and got.min_value is None


def test_outlier_is_found(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 1000]], "x double")
    assert quality.accuracy_iqr(df, "t").first().score == 90.0
    assert clean.remove_outliers(df).count() == 9


def test_names_with_spaces_dots_and_quotes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "`a b` int, `c.d'{e}` string")
    got = {r.column_name: r.null_count for r in quality.column_metrics(df, "it's").collect()}
    assert got == {"a b": 0, "c.d'{e}": 1}


def test_nested_columns_get_completeness_only(spark):
    df = spark.createDataFrame([([1.0],), (None,)], "v array<double>")
    got = quality.column_metrics(df, "t").first()
    assert got.completeness == 50.0 and got.unique_count is None


def test_tied_modes_take_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert clean.modes(df, ["s"]) == {"s": "a"}


def test_half_null_is_kept_by_a_strict_threshold(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5, None)], "a int, b int, c int")
    assert clean.drop_nulls(df, "threshold", 0.5).columns == ["a", "b"]
    assert series.valid_series_columns(spark.createDataFrame([(1.0, 1.0), (None, 2.0)], "h double, f double")) == ["f"]


def test_duplicates_keep_first_last_none(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 30)], "k string, t int, v int")
    keep = lambda k: sorted(r.v for r in clean.drop_duplicates(df, ["k"], k, ["t"]).collect())
    assert keep("first") == [10, 30] and keep("last") == [20, 30] and keep(None) == [30]
    assert clean.drop_duplicates(clean.drop_duplicates(df)).count() == 3


def test_scaling_properties(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in range(11)], "x double, c double")
    z = clean.standardize(df).agg(F.avg("x"), F.stddev_samp("x"), F.max("c")).first()
    assert z[0] == pytest.approx(0) and z[1] == pytest.approx(1) and z[2] == 1.0
    m = clean.standardize(df, "minmax").agg(F.min("x"), F.max("x")).first()
    assert tuple(m) == (0.0, 1.0)


def test_fractions_do_not_become_integers(spark):
    df = spark.createDataFrame([("1", "1.5"), ("x", "2")], "a string, b string")
    got, log = clean.convert_types(df, {"a": "int", "b": "int"})
    assert [r.a for r in got.collect()] == [1, None] and dict(got.dtypes)["b"] == "string"
    assert {r.column_name: r.success for r in log.collect()} == {"a": True, "b": False}


def test_number_and_date_text(spark):
    df = spark.createDataFrame([(" 1e3 ",), ("1d",), (".5",), ("",), ("2024-01-02",), ("01/31/2024",), ("Jan 2, 2023",), ("junk",)], "s string")
    numbers = [r[0] for r in df.select(parse_number(F.col("s"))).collect()]
    assert numbers == [1000.0, None, 0.5, None, None, None, None, None]
    dates = [r[0] for r in df.select(parse_timestamp(F.col("s"))).collect()]
    assert dates[4:] == [datetime.datetime(2024, 1, 2), datetime.datetime(2024, 1, 31), datetime.datetime(2023, 1, 2), None]


def test_boolean_and_id_columns(spark):
    df = spark.createDataFrame([(i, i % 2, "yes" if i % 2 else "No", i * 1.5, None) for i in range(12)], "paid int, f int, w string, m double, n string")
    assert {r.column_name: r.is_boolean for r in recommend.boolean_columns(df).collect()} == {
        "paid": False, "f": True, "w": True, "m": False, "n": True,
    }
    assert {r.column_name: r.is_id for r in recommend.id_columns(df).collect()} == {
        "paid": True, "f": False, "w": False, "m": True, "n": True,
    }
    assert series.series_columns(df) == ["paid", "f", "m"]
    assert series.series_columns(df, "letters") == []


def test_detector_guard_rails(spark):
    frame = lambda n: spark.createDataFrame([(i, float(i * i % 7)) for i in range(n)], "t int, x double")
    assert anomaly.detect(frame(9), ["t"], ["x"]).status == "too few rows"
    assert anomaly.detect(frame(10), ["t"], ["x"]).status == "ok"
    text = spark.createDataFrame([("a",), ("b",)], "s string")
    got = anomaly.detect(text, ["s"])
    assert got.status == "no numeric column" and not any(r.anomaly for r in got.rows.collect())
    flat = spark.createDataFrame([(i, 1.0) for i in range(20)], "t int, x double")
    assert anomaly.detect(flat, ["t"], ["x"]).status == "no valid column"


def test_planted_anomalies_are_flagged(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    a = 10 + rng.normal(0, 0.5, 100)
    b = 20 + rng.normal(0, 0.5, 100)
    for i in (25, 50, 75):
        a[i] += 8
    start = datetime.datetime(2024, 1, 1)
    data = [(start + datetime.timedelta(hours=i), float(a[i]), float(b[i])) for i in range(100)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, sales double, orders double").repartition(6)
    flagged = {r.ts for r in anomaly.detect_anomalies(df, ["ts"]).where("anomaly").collect()}
    assert {start + datetime.timedelta(hours=i) for i in (25, 50, 75)} <= flagged
    small = {r.ts for r in anomaly.detect_anomalies(df, ["ts"], window_rows=10, bucket_rows=32).where("anomaly").collect()}
    assert small == flagged
    assert anomaly.run_anomalies(df, ["ts"]).where("anomaly_varima").count() == len(flagged)
    no_dates = df.select("sales", "orders")
    assert anomaly.run_anomalies(no_dates, ["sales"]).select("status").distinct().first()[0].startswith("no date")


def test_unknown_tables_and_rows_are_errors(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        detail.selected_tables_metrics({"a": df}, ["a", "b"])
    edits = spark.createDataFrame([(9, "v", "1")], "k int, column_name string, new_value string")
    with pytest.raises(KeyError):
        rows.update_rows(df, edits, "k")


def test_clashing_types_become_text(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([(2.5, 3)], "n double, s int")
    assert dict(rows.union_tables({"a": a, "b": b}).dtypes)["s"] == "string"
    assert dict(rows.union_tables({"a": a, "b": b}).dtypes)["n"] == "double"


def test_files_round_trip_and_delimiters(spark):
    df = spark.createDataFrame([(1, "a;b", 1.5), (2, None, None)], "i long, s string, x double")
    for sep in (",", "\t", "|"):
        path = files.write_delimited(df, fresh_path(spark, "csv"), sep)
        assert files.read_delimited(spark, path, sep).orderBy("i").collect() == df.orderBy("i").collect()
    path = files.write_delimited(df.drop("s"), fresh_path(spark, "csv"), "|")
    assert files.sniff_delimiter(spark, path) == "|"
    with pytest.raises(ValueError):
        files.read_delimited(spark, files.write_delimited(df.limit(0), fresh_path(spark, "csv")))


def test_database_options():
    db = jdbc.Database("postgresql", "shop", "db.local", user="u", password="p")
    assert db.options() == {"url": "jdbc:postgresql://db.local:5432/shop", "driver": "org.postgresql.Driver", "user": "u", "password": "p"}
    assert jdbc.Database("sqlserver", "shop").url == "jdbc:sqlserver://localhost:1433;databaseName=shop"
    assert jdbc.partition_options("id", 1, 9, 4) == {"partitionColumn": "id", "lowerBound": "1", "upperBound": "9", "numPartitions": "4"}


def test_severity_limits(spark):
    df = spark.createDataFrame([(2.1,), (2.6,), (3.6,)], "s double")
    assert [r[0] for r in df.select(anomaly.severity(F.col("s"))).collect()] == ["low", "medium", "high"]
    assert [r[0] for r in df.select(anomaly.severity(F.col("s"), "ui")).collect()] == ["medium", "medium", "high"]
    assert [r[0] for r in df.select(anomaly.confidence(F.col("s"))).collect()] == [63.0, 78.0, 95.0]


def test_weighted_quality_of_the_known_result(spark):
    df = spark.createDataFrame([(85.0, 90.0, 75.0, 80.0, 88.0)], list(detail.DETAIL_DIMENSIONS))
    assert df.select(F.round(detail.overall_quality())).first()[0] == 84.0
    assert detail.with_risk(df).first().risk_level == "Low"


def test_approximate_scores_are_close(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("x"), F.lit("a").alias("s"))
    exact, rough = (quality.table_metrics(df, "t", approx=a).first() for a in (False, True))
    assert rough.quality_score == pytest.approx(exact.quality_score, rel=0.05)


def test_pipeline_log_counts_every_step(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None)], "k int, x double")
    options = {"drop_nulls": {"method": "any"}, "drop_duplicates": {}}
    log = clean.clean_pipeline(df, options).log().orderBy("step").collect()
    assert [(r.action, r.rows_before, r.rows_after) for r in log] == [("drop_nulls", 3, 2), ("drop_duplicates", 2, 1)]
    assert log[0].details == {"method": "any"}


def test_late_rows_refuse_a_count_that_may_fall_short(spark):
    from types import SimpleNamespace

    from plumbline.streaming.quality import dropped_rows

    report = {"stateOperators": [{"numRowsDroppedByWatermark": 2}]}
    most = int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates"))
    assert dropped_rows(SimpleNamespace(recentProgress=[report] * (most - 1))) == 2 * (most - 1)
    with pytest.raises(RuntimeError):
        dropped_rows(SimpleNamespace(recentProgress=[report] * most))
