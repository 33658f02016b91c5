"""Dates as people write them, in any session time zone."""

import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions.dates import Reading, date_shapes, epoch_seconds, parse_timestamp, read_shapes
from plumbline.operators import clean, features, recommend

D = datetime.datetime
CASES = {
    "2024-01-02": D(2024, 1, 2), "2024/1/2": D(2024, 1, 2), "2024.01.02 03:04": D(2024, 1, 2, 3, 4), "2024-01-01T10:00:00Z": D(2024, 1, 1, 10),
    "2024-01-01 10:00:00.123456789+02:00": D(2024, 1, 1, 8, 0, 0, 123456), "2024-01-01T23:30-0130": D(2024, 1, 2, 1),
    "31-Jan-2024": D(2024, 1, 31), "20240131": D(2024, 1, 31), "20240131T101112": D(2024, 1, 31, 10, 11, 12), "202401311011": D(2024, 1, 31, 10, 11),
    "01/31/2024": D(2024, 1, 31), "31/01/2024 5:06 pm": D(2024, 1, 31, 17, 6), "Jan 2, 2023": D(2023, 1, 2), "  2 Sept 2021 ": D(2021, 9, 2),
    "January 2nd, 2023 at 3:04 AM": D(2023, 1, 2, 3, 4), "Mon, 2 Jan 2006 15:04:05 -0700": D(2006, 1, 2, 22, 4, 5), "may 2020": D(2020, 5, 1),
    "2024-Mar-05": D(2024, 3, 5), "3rd of May 1999 12 a.m.": D(1999, 5, 3), "1-1-70": D(1970, 1, 1), "1-1-68 12:00 PM": D(2068, 1, 1, 12),
    "2024-03-10 02:30:00": D(2024, 3, 10, 2, 30), "2024-02-30": None, "2024-13-01": None, "2024-01-02 24:00": None, "2024-01-02 10:00:60": None,
    "2024-01-02 13:00 pm": None, "31/31/2024": None, "12:30": None, "junk": None, "": None, "12345678": None, "1.5": None, "x" * 500 + "1": None,
}


@pytest.fixture(params=["UTC", "America/New_York"])
def zoned(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_every_form_in_every_zone(zoned):
    df = zoned.createDataFrame([(i, t) for i, t in enumerate([*CASES, None])], "i int, s string")
    got = [r.t for r in df.select("i", parse_timestamp(F.col("s")).alias("t")).orderBy("i").collect()]
    assert dict(zip(CASES, got)) == CASES and got[-1] is None


def test_day_and_month_by_vote(spark):
    rows = [("3/4/2021", "3/4/2021", "3.4.21", "3/4/2021"), ("25/4/2021", "4/25/2021", "5.6.21", "5/6/2021"), ("1/2/2021", "1/2/2021", None, "no date")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    read = read_shapes(df, ["a", "b", "c", "d"])
    assert {c: r.day_first for c, r in read.items()} == {"a": True, "b": False, "c": True, "d": False}
    assert {r.forms for r in read.values()} == {("mixed",)}
    got, log = clean.convert_types(df, dict.fromkeys("abcd", "datetime"))
    assert [tuple(r) for r in got.collect()][:2] == [
        (D(2021, 4, 3), D(2021, 3, 4), D(2021, 4, 3), D(2021, 3, 4)), (D(2021, 4, 25), D(2021, 4, 25), D(2021, 6, 5), D(2021, 5, 6))
    ]
    assert {r.column_name: (r.success, r.lost_values) for r in log.collect()} == {"a": (True, 0), "b": (True, 0), "c": (True, 0), "d": (True, 1)}
    shapes = {(r.column_name, r.shape): (r.rows, r.day_proofs, r.month_proofs) for r in date_shapes(df, ["a", "b", "d"]).collect()}
    assert shapes["a", "99/9/9999"] == (1, 1, 0) and shapes["b", "9/99/9999"] == (1, 0, 1) and shapes["d", None] == (1, 0, 0)


def test_no_form_reads_nothing(spark):
    df = spark.createDataFrame([("junk",)], "s string")
    assert read_shapes(df, ["s"]) == {"s": Reading((), False)}
    assert df.select(parse_timestamp(F.col("s"), Reading(()))).first()[0] is None


def test_epochs_and_steps_in_every_zone(zoned):
    times = ["2024-03-10 01:30:00", "2024-03-10 02:30:00", "2024-03-10 03:30:00", "1969-12-31 23:59:58.500000"]
    df = zoned.createDataFrame([(t,) for t in times], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    seconds = [r[0] for r in df.select(epoch_seconds(F.col("t"), df.schema["t"].dataType)).collect()]
    assert seconds == [1710034200, 1710037800, 1710041400, -2]
    step = features.frequency(df.where("t > '2000-01-01'"), "t").first()
    assert (step.step_seconds, step.steps) == (3600.0, 2)
    text = df.select(F.col("t").cast("string").alias("event_date"), F.lit(1).alias("n"))
    assert sorted(r.event_date_timestamp for r in clean.clean_frame(text).collect()) == sorted(seconds)


def test_tables_without_fitting_columns(spark):
    text = spark.createDataFrame([("a", [1]), (None, None)], "s string, v array<int>")
    assert clean.fill_mean(text).count() == clean.standardize(text).count() == clean.standardize(text, "minmax").count() == 2
    assert {r.s for r in clean.fill_mode(text).collect()} == {"a"}
    numbers = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert recommend.type_conversion_suggestions(numbers).collect() == []
    assert clean.convert_types(numbers, {})[1].collect() == []
