"""Results kept between runs: append, latest within an age, publish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Seconds that results stay valid, current and legacy form.
TTL_SECONDS = 3600
LEGACY_TTL_SECONDS = 86400

STORE_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("analyzed_at", T.TimestampType()),
        T.StructField("payload", T.StringType()),
        T.StructField("run_id", T.StringType()),
    ]
)


def save_results(results: DataFrame, path: str, kind: str, run_id: str, analyzed_at: Column | None = None) -> None:
    """Append rows that have a ``table_name``; their other columns become JSON."""
    others = [c for c in results.columns if c != "table_name"]
    results.select(
        F.lit(kind).alias("kind"),
        "table_name",
        (analyzed_at if analyzed_at is not None else F.current_timestamp()).cast("timestamp").alias("analyzed_at"),
        F.to_json(F.struct(*others)).alias("payload"),
        F.lit(run_id).alias("run_id"),
    ).write.mode("append").partitionBy("run_id").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE_SCHEMA).parquet(path)


def latest_results(
    spark: SparkSession,
    path: str,
    kind: str,
    schema: str | T.StructType,
    ttl_seconds: int | None = TTL_SECONDS,
    now: Column | None = None,
    table_name: str | None = None,
) -> DataFrame:
    """The newest result per table, without those older than the time to live."""
    now = F.current_timestamp() if now is None else now.cast("timestamp")
    found = load_results(spark, path).where(F.col("kind") == kind)
    if table_name is not None:
        found = found.where(F.col("table_name") == table_name)
    if ttl_seconds is not None:
        found = found.where(F.unix_seconds(now) - F.unix_seconds("analyzed_at") <= ttl_seconds)
    newest = found.groupBy("table_name").agg(
        F.max_by(F.struct("payload", "run_id"), F.struct("analyzed_at", "run_id")).alias("r"),
        F.max("analyzed_at").alias("analyzed_at"),
    )
    return newest.select(
        "table_name", "analyzed_at", F.col("r.run_id").alias("run_id"), F.from_json("r.payload", schema).alias("p")
    ).select("table_name", "analyzed_at", "run_id", "p.*")


def publish_rows(quality: DataFrame | None, anomalies: DataFrame | None, source: str, at: Column) -> DataFrame:
    """Rows for a dashboard: one kind for quality, one for anomalies."""
    dims = ["completeness", "uniqueness", "cardinality", "consistency", "volumetry"]
    parts = []
    if quality is not None:
        parts.append(quality.select(F.lit("quality_metrics").alias("analysis_type"), F.lit(source).alias("connection_id"),
                                    *dims, at.alias("analyzed_at")))
    if anomalies is not None:
        parts.append(
            anomalies.select(
                F.lit("anomaly_detection").alias("analysis_type"), F.lit(source).alias("connection_id"), "model_type",
                "anomalies_detected", F.col("total_observations").alias("total_records"), at.alias("analyzed_at"),
            )
        )
    if not parts:
        raise ValueError("no results to publish")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
