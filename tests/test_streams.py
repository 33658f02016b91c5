"""Streams over several micro-batches: exact windows equal the batch form and DuckDB, late rows and eviction."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.streaming import quality as sq

EVENTS = "/root/testdata/sf0.001/events.parquet"
FACTS = ["rows", *[f"{c}_{f}" for c in ("value", "kind") for f in ("completeness", "distinct", "min", "max", "mean", "median")]]


def _events(spark):
    n = F.col("event_id")
    value = F.when(n % 7 == 0, None).when(n % 11 == 0, float("nan")).otherwise(F.round("value", 1))
    return spark.read.parquet(EVENTS).select("event_id", "ts", value.alias("value"), F.when(n % 5 != 0, F.col("event_type")).alias("kind"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events in five files, written in order of time; the second holds the same hot value in most rows."""
    path = str(tmp_path_factory.mktemp("stream") / "in")
    events = _events(spark)
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) / 5
    for i in range(5):
        part = events.where((F.col("ts") >= low + step * i) & (F.col("ts") < low + step * (i + 1) if i < 4 else F.lit(True)))
        if i == 1:
            part = part.withColumn("value", F.when(F.col("event_id") % 4 != 0, 1.5).otherwise(F.col("value")))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def _stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _drain(df, path):
    spark = df.sparkSession
    query = (
        df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out"), query


def _rows(df):
    out = df.toPandas().sort_values("window_start").reset_index(drop=True)
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in out.astype(object).where(out.notna(), None).itertuples(index=False)]


@pytest.mark.parametrize("slide", [None, "6 hours"])
def test_exact_windows_of_a_stream_equal_the_batch(spark, folder, tmp_path, slide):
    windows = lambda df: sq.quality_windows(df, "ts", ["value", "kind"], "1 day", slide, "6 hours")
    out, query = _drain(windows(_stream(spark, folder)), str(tmp_path))
    batch = spark.read.parquet(folder)
    high = batch.agg(F.max("ts")).first()[0]
    closed = windows(batch).where(F.col("window_end").cast("timestamp_ntz") <= F.lit(high).cast("timestamp_ntz") - F.expr("INTERVAL 6 HOURS"))
    assert sum(p.numInputRows > 0 for p in query.recentProgress) == 5
    got, want = _rows(out), _rows(closed)
    assert got == want and len(got) > 10
    # Windows that are out are forgotten: only those the watermark has not passed are left.
    left = query.recentProgress[-1].stateOperators
    assert all(op.numRowsTotal < batch.count() for op in left)


def test_exact_windows_equal_duckdb(spark, folder):
    got = sq.quality_windows(spark.read.parquet(folder), "ts", ["value", "kind"], "1 day")
    con = duckdb.connect()
    want = con.execute(f"""
      WITH e AS (SELECT date_trunc('day', ts) AS d, CASE WHEN isnan(value) THEN NULL ELSE value END AS value, kind FROM read_parquet('{folder}/*.parquet'))
      SELECT d, count(*), count(value) * 100.0 / count(*), count(DISTINCT value), min(value), max(value), avg(value), median(value),
        count(kind) * 100.0 / count(*), count(DISTINCT kind) FROM e GROUP BY d ORDER BY d""").fetchall()
    rows = [tuple(r[k] for k in ("rows", *FACTS[1:7], "kind_completeness", "kind_distinct")) for r in got.orderBy("window_start").collect()]
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert a == pytest.approx(b[1:], rel=1e-9)


def test_windows_of_no_values_and_of_no_rows(spark):
    df = spark.createDataFrame([("2024-01-01 01:00:00", None), ("2024-01-01 02:00:00", None)], "t string, x double")
    df = df.select(F.col("t").cast("timestamp").alias("t"), "x")
    row = sq.quality_windows(df, "t", ["x"], "1 day").first()
    assert (row.rows, row.x_completeness, row.x_distinct, row.x_median) == (2, 0.0, 0, None)
    assert sq.quality_windows(df, "t", [], "1 day").first().rows == 2
    assert sq.quality_windows(df.limit(0), "t", ["x"], "1 day").count() == 0


def test_signs_of_zero_long_texts_and_big_integers_count_once_each(spark):
    big = 2**60
    rows = [(0.0, "a" * 5000, big), (-0.0, "a" * 5000, big + 1), (1.0, "a" * 4999 + "b", big)]
    df = spark.createDataFrame(rows, "x double, s string, n bigint").withColumn("t", F.lit("2024-01-01 01:00:00").cast("timestamp"))
    row = sq.quality_windows(df, "t", ["x", "s", "n"], "1 day").first()
    assert (row.x_distinct, row.s_distinct, row.n_distinct) == (2, 2, 2)


def test_sketches_stay_an_option(spark, folder):
    row = sq.quality_windows(spark.read.parquet(folder), "ts", ["value"], "1 day", approx=True).orderBy("window_start").first()
    exact = sq.quality_windows(spark.read.parquet(folder), "ts", ["value"], "1 day").orderBy("window_start").first()
    assert row.value_distinct == pytest.approx(exact.value_distinct, rel=0.2) and row.rows == exact.rows


def test_late_rows_over_more_than_a_hundred_batches(spark, tmp_path):
    hours = [(i, 10 * i if i % 4 else 10 * i - 45) for i in range(104)]  # every fourth row is 45 minutes behind
    folder = tmp_path / "in"
    folder.mkdir()
    for i, minute in hours:
        (folder / f"{i:04}.json").write_text('{"id": %d, "t": %s}' % (i, minute * 60 if i % 50 != 49 else "null"))
        os.utime(folder / f"{i:04}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    source = spark.readStream.schema("id int, t bigint").option("maxFilesPerTrigger", 1).json(str(folder))
    timed = source.select("id", F.timestamp_seconds("t").alias("t"))
    path = str(tmp_path / "out")
    query = sq.route_late(timed, "t", "30 minutes", path)
    query.awaitTermination()
    assert query.lastProgress.batchId > 100
    seen, want = None, []
    for i, minute in hours:
        if i % 50 == 49:
            continue
        if seen is not None and minute <= seen - 30:
            want.append(i)
        seen = minute if seen is None else max(seen, minute)
    assert sorted(r.id for r in sq.late_rows(spark, path).collect()) == want and len(want) > 20
    assert sq.rows_in_time(spark, path).count() == len(hours) - len(want)
    # A restart finds nothing new and keeps the counts.
    sq.route_late(timed, "t", "30 minutes", path).awaitTermination()
    assert sq.late_rows(spark, path).count() == len(want)


def test_late_rows_of_a_stream_without_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("id int, t timestamp").json(str(tmp_path / "in"))
    sq.route_late(source, "t", "1 hour", str(tmp_path / "out")).awaitTermination()
    assert sq.late_rows(spark, str(tmp_path / "out")).count() == 0
    with pytest.raises(ValueError):
        sq.route_late(source.withColumnRenamed("id", "late"), "t", "1 hour", str(tmp_path / "no"))
