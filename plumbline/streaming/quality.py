"""Quality over windows of a stream, sessions, duplicates and late rows.

Every function takes a streaming DataFrame (a batch one works too) with an event
time column and returns a DataFrame; the caller picks sink and trigger.  State is
bounded by the watermark: windows that it has passed are written and forgotten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import epoch_micros
from ..functions.schema import is_datetime, is_text, normalize, quoted
from ..functions.values import text_key


def with_event_time(df: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermark on ``time``; a timestamp without zone is read as UTC, whatever the session's zone."""
    if not is_datetime(df.schema[time].dataType):
        raise ValueError(f"{time} is not a time column")
    return normalize(df).withColumn(time, F.timestamp_micros(epoch_micros(quoted(time), df.schema[time].dataType))).withWatermark(time, delay)


def _key(df: DataFrame, c: str) -> Column:
    """Text that is equal exactly when two values of the column are; zero has one sign."""
    kind = df.schema[c].dataType
    if is_text(kind):
        return text_key(quoted(c))
    return (quoted(c) + F.lit(0.0) if kind.typeName() in ("float", "double") else quoted(c)).cast("string")


def _value_counts(timed: DataFrame, time: str, window: Column, columns: list[str]) -> DataFrame:
    """How often each value stands in each window: w, i (place of the column), k (the value as a key), v (as a number), n."""
    cells = [
        F.struct(F.lit(i).alias("i"), _key(timed, c).alias("k"), quoted(c).try_cast("double").alias("v")) for i, c in enumerate(columns)
    ] or [F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("k"), F.lit(None).cast("double").alias("v"))]
    rows = timed.select(quoted(time), F.explode(F.array(*cells)).alias("cell"))
    counted = rows.groupBy(window.alias("w"), F.col("cell.i").alias("i"), F.col("cell.k").alias("k"))
    return counted.agg(F.max("cell.v").alias("v"), F.count(F.lit(1)).alias("n"))


def _exact_facts(columns: list[str]) -> list[Column]:
    """The facts of a window from the counts of its values."""
    count = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0))
    out = [count(F.col("i") == 0).alias("rows")]
    for i, c in enumerate(columns):
        here = F.col("i") == i
        v = F.when(here, F.col("v"))
        out += [
            (count(here & F.col("k").isNotNull()) * 100.0 / count(here)).alias(f"{c}_completeness"),
            F.count_if(here & F.col("k").isNotNull()).alias(f"{c}_distinct"),
            F.min(v).alias(f"{c}_min"),
            F.max(v).alias(f"{c}_max"),
            F.try_divide(F.sum(v * F.col("n")), count(v.isNotNull())).alias(f"{c}_mean"),
            F.percentile(v, F.lit(0.5), F.col("n")).alias(f"{c}_median"),
        ]
    return out


def _facts(columns: list[str]) -> list[Column]:
    """The same from the rows of a window, distinct counts and medians as sketches."""
    out = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        v = quoted(c).cast("double")
        out += [
            (F.count(quoted(c)) * 100.0 / F.count(F.lit(1))).alias(f"{c}_completeness"),
            F.approx_count_distinct(quoted(c)).alias(f"{c}_distinct"),
            F.min(v).alias(f"{c}_min"),
            F.max(v).alias(f"{c}_max"),
            F.avg(v).alias(f"{c}_mean"),
            F.percentile_approx(v, 0.5, 1000).alias(f"{c}_median"),
        ]
    return out


def quality_windows(
    df: DataFrame, time: str, columns: list[str], length: str, slide: str | None = None, delay: str = "1 hour", approx: bool = False
) -> DataFrame:
    """Quality per tumbling window, or per sliding one when ``slide`` is given.

    Two aggregations follow each other: values are counted per window and column, spread over all tasks, and when the
    watermark has passed a window its counts make one row. So distinct counts and medians are exact, and the state is
    one row per window, column and value. With ``approx`` one aggregation keeps sketches of both: state of fixed size.
    """
    timed = with_event_time(df, time, delay)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    if approx:
        grouped = timed.groupBy(window.alias("w")).agg(*_facts(columns))
    else:
        grouped = _value_counts(timed, time, window, columns).groupBy("w").agg(*_exact_facts(columns))
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in grouped.columns if c != "w"]
    )


def sessions(df: DataFrame, time: str, keys: list[str], gap: str, delay: str = "1 hour") -> DataFrame:
    """Runs of activity per key, closed by a silence longer than ``gap``."""
    timed = with_event_time(df, time, delay)
    grouped = timed.groupBy(F.session_window(time, gap).alias("w"), *[quoted(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return grouped.select(
        *keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "rows"
    )


def deduplicate(df: DataFrame, time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a key that arrive within the watermark."""
    return with_event_time(df, time, delay).dropDuplicatesWithinWatermark(keys)


def dropped_rows(query) -> int:
    """Rows that a finished query dropped for coming after the watermark.

    Spark keeps the last ``spark.sql.streaming.numRecentProgressUpdates`` reports. Where earlier ones may be gone the
    count would fall short, so it is refused; raise that setting before the query starts, or use ``route_late``, which
    needs no reports.
    """
    setting = "spark.sql.streaming.numRecentProgressUpdates"
    if len(query.recentProgress) >= int(SparkSession.active().conf.get(setting)):
        raise RuntimeError(f"reports of this query may be lost: raise {setting}")
    return sum(
        op.get("numRowsDroppedByWatermark", 0) if isinstance(op, dict) else op.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for op in (progress["stateOperators"] if isinstance(progress, dict) else progress.stateOperators)
    )


def route_late(df: DataFrame, time: str, delay: str, path: str, trigger: dict | None = None):
    """Start a query that writes every row of a stream once, under ``path``, beside whether it came too late.

    A row is late if an earlier micro-batch held a time at least ``delay`` after its own; a null time is never late.
    Each micro-batch is one folder, overwritten if it runs again, and leaves the highest time so far for the next, so
    the count holds for any number of batches and restarts. Read it with ``late_rows`` and ``rows_in_time``; the table
    grows with the stream.
    """
    kind = df.schema[time].dataType
    if not is_datetime(kind):
        raise ValueError(f"{time} is not a time column")
    if {"late", "batch"} & {c.lower() for c in df.columns}:
        raise ValueError("columns named late and batch are this function's own")
    micros = epoch_micros(quoted(time), kind)

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        high = spark.read.parquet(f"{path}/highs/batch={batch - 1}").first()[0] if batch else None
        limit = F.timestamp_micros(F.lit(high).cast("bigint")) - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.timestamp_micros(micros) <= limit, F.lit(False))
        folder = f"{path}/rows/batch={batch}"
        rows.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(folder)
        written = spark.read.schema(rows.schema).parquet(folder)
        highest = F.greatest(F.max(micros), F.lit(high).cast("bigint")).alias("high")
        written.agg(highest).write.mode("overwrite").parquet(f"{path}/highs/batch={batch}")

    # So that a stream without a batch can be read, too.
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{path}/rows/batch=-1/late=false")
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _routed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").withColumn("late", F.col("late").cast("boolean"))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came too late, of all batches so far."""
    return _routed(spark, path).where("late").drop("late", "batch")


def rows_in_time(spark: SparkSession, path: str) -> DataFrame:
    """All other rows."""
    return _routed(spark, path).where("NOT late").drop("late", "batch")
