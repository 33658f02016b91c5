"""Checks of the streaming operators: each stream reads whole tables to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.plans.materialize import fresh_path
from plumbline.streaming import anomalies as sa
from plumbline.streaming import quality as sq

from .quality import rounded
from .tables import load, with_views


def stream(spark, sf: str, table: str) -> DataFrame:
    """The parquet file of a table as a stream of files."""
    schema = load(spark, sf, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)


def dirty_stream(spark, sf: str) -> DataFrame:
    """Events with missing values, planted by the same rules as ``dirty_events``."""
    n = F.col("event_id")
    value = (
        F.when((n % 5).isin(0, 1), None).when(n % 35 == 2, float("nan")).when(n % 211 == 0, F.col("value") * 20).otherwise(F.col("value"))
    )
    return stream(spark, sf, "events").withColumn("value", value).drop("props")


def drain(df: DataFrame, mode: str = "append"):
    """Run a stream over all files there are; returns its files sink and query."""
    spark = df.sparkSession
    path = fresh_path(spark, "stream")
    query = (
        df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out"), query


def naive(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else f.name for f in df.schema])


def tumbling(spark, sf):
    out, _ = drain(sq.quality_windows(dirty_stream(spark, sf), "ts", ["value"], "1 day", delay="6 hours"))
    return rounded(naive(out), 5)


def sliding(spark, sf):
    out, _ = drain(sq.quality_windows(dirty_stream(spark, sf), "ts", ["value"], "1 day", "6 hours", delay="6 hours"))
    return rounded(naive(out), 5)


def windows_batch(spark, sf):
    """The same windows over the table as a batch, of two columns."""
    return rounded(naive(sq.quality_windows(load(spark, sf, "dirty_events"), "ts", ["value", "user_id"], "1 day")), 5)


def sessions(spark, sf):
    out, _ = drain(sq.sessions(stream(spark, sf, "events"), "ts", ["user_id"], "2 hours", "6 hours"))
    return naive(out)


def dedup(spark, sf):
    once = stream(spark, sf, "events")
    again = stream(spark, sf, "events").where("event_type = 'click'")
    out, _ = drain(sq.deduplicate(once.unionByName(again), "ts", ["event_id"], "40 days"))
    return naive(out.select("event_id", "ts", "user_id"))


def late(spark, sf):
    """Recent half first, then the older half: all of that is late."""
    events = load(spark, sf, "events").select("event_id", "ts")
    middle = "timestamp_ntz '2024-01-16 00:00:00'"
    path = fresh_path(spark, "late")
    for part in (f"ts >= {middle}", f"ts < {middle}"):
        events.where(part).write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        sq.route_late(source, "ts", "6 hours", f"{path}/out").awaitTermination()
    return sq.late_rows(spark, f"{path}/out").select(F.count("*").alias("late_rows"), F.sum("event_id").alias("late_ids"))


def scored(spark, sf):
    history = load(spark, sf, "events")
    model = sa.fit_steps(history, "user_id", ["ts", "event_id"], "value")
    source = stream(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    out, _ = drain(sa.score_stream(source, "user_id", "ts", "event_id", "value", model, 2.0))
    return rounded(naive(out), 5)


def _facts_sql(c: str) -> str:
    facts = {"min": f"min({c})", "max": f"max({c})", "mean": f"avg({c})", "median": f"median({c})"}
    return ", ".join(
        [f"round(1e2 * count({c}) / count(*), 5) AS {c}_completeness", f"count(DISTINCT {c}) AS {c}_distinct"]
        + [f"round(CAST({f} AS DOUBLE), 5) AS {c}_{n}" for n, f in facts.items()]
    )


def _window_sql(starts: str, columns: tuple[str, ...] = ("value",), closed: bool = True) -> str:
    facts = ", ".join(map(_facts_sql, columns))
    return with_views(f"""
      WITH w AS (SELECT {starts} AS window_start, {", ".join(columns)} FROM dirty_events),
      g AS (SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, count(*) AS rows, {facts} FROM w GROUP BY window_start)
      SELECT * FROM g {"WHERE window_end <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events)" if closed else ""}""", "dirty_events")


_SIX = "unnest([time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR for k in [0, 1, 2, 3]])"

CHECKS = {
    "stream_quality_tumbling": (tumbling, _window_sql("date_trunc('day', ts)")),
    "stream_quality_sliding": (sliding, _window_sql(_SIX)),
    "quality_windows_batch": (windows_batch, _window_sql("date_trunc('day', ts)", ("value", "user_id"), closed=False)),
    "stream_sessions": (
        sessions,
        """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
           n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s),
           g AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS rows FROM n GROUP BY user_id, k)
           SELECT * FROM g WHERE session_end <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events)""",
    ),
    "stream_dedup": (dedup, "SELECT DISTINCT event_id, ts, user_id FROM events"),
    "stream_late_rows": (
        late,
        """SELECT count(*) AS late_rows, CAST(sum(event_id) AS BIGINT) AS late_ids FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00'
           AND ts <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00')""",
    ),
    "stream_anomalies": (
        scored,
        """WITH l AS (SELECT event_id, ts, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events),
           c AS (SELECT regr_slope(value, previous) AS b, regr_intercept(value, previous) AS a FROM l),
           r AS (SELECT *, value - a - b * previous AS r FROM l, c), m AS (SELECT avg(r) AS m, stddev_samp(r) AS s FROM r)
           SELECT event_id, ts, user_id, round(value, 5) AS value, round(previous, 5) AS previous, round(abs((r - m) / s), 5) AS score,
                  coalesce(abs((r - m) / s) > 2, false) AS anomaly FROM r, m""",
    ),
}
