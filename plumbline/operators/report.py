"""Reports: statistics by table and column, risk, summary, dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .detail import DETAIL_DIMENSIONS, overall_quality, risk_level, risk_percentage
from .quality import DIMENSIONS

# Headers of the two statistics files and of the risk file.
TABLE_HEADERS = (
    "Table_Name", "Total_Rows", "Total_Columns", "Quality_Score", "Completeness", "Validity", "Consistency",
    "Uniqueness", "Accuracy",
)
COLUMN_HEADERS = (
    "Table_Name", "Column_Name", "Data_Type", "Completeness", "Validity", "Consistency", "Uniqueness", "Accuracy",
    "Null_Count", "Unique_Count", "Min_Value", "Max_Value", "Mean_Value",
)
RISK_HEADERS = (
    "Table Name", "Data Source Type", "Database Type", "Filename", "Completeness (%)", "Uniqueness (%)",
    "Cardinality (%)", "Consistency (%)", "Volumetry (%)", "Overall_Quality(%)", "Risk Level", "Risk Percentage (%)",
    "Sample Size", "Total Records", "Anomalies Detected", "Anomaly Percentage (%)", "Analysis Timestamp",
)
RISK_COLUMNS = (
    "table_name", "data_source_type", "database_type", "filename", *DETAIL_DIMENSIONS, "overall_quality",
    "risk_level", "risk_percentage", "sample_size", "total_records", "anomalies_detected", "anomaly_percentage",
    "analysis_timestamp",
)


def table_statistics_report(tables: DataFrame) -> DataFrame:
    """The table section: nine columns, failed tables left out."""
    good = tables.where(F.col("error").isNull()) if "error" in tables.columns else tables
    source = ("table_name", "total_rows", "total_columns", "quality_score", *DIMENSIONS)
    return good.select(*[F.col(c).alias(h) for c, h in zip(source, TABLE_HEADERS)])


def column_statistics_report(columns: DataFrame) -> DataFrame:
    """The column section: thirteen columns."""
    source = (
        "table_name", "column_name", "data_type", *DIMENSIONS, "null_count", "unique_count", "min_value", "max_value",
        "mean_value",
    )
    return columns.select(*[F.col(c).alias(h) for c, h in zip(source, COLUMN_HEADERS)])


def risk_report(
    metrics: DataFrame,
    anomalies: DataFrame,
    at: Column,
    source_type: str = "database",
    database_type: str = "parquet",
    filename: str = "N/A",
) -> DataFrame:
    """One row per table with its risk and anomalies, and an overall row for several."""
    quality = overall_quality()
    found = anomalies.select(
        "table_name", F.col("total_observations").alias("total_records"), "anomalies_detected"
    )
    share = lambda part, whole: F.coalesce(F.round(F.try_divide(part * 100.0, whole), 2), F.lit(0.0))
    tables = (
        metrics.withColumn("_q", quality)
        .join(found, "table_name", "left")
        .select(
            "table_name", F.lit(source_type).alias("data_source_type"), F.lit(database_type).alias("database_type"),
            F.lit(filename).alias("filename"), *[F.round(d, 2).alias(d) for d in DETAIL_DIMENSIONS],
            F.round("_q", 2).alias("overall_quality"), risk_level(F.col("_q")).alias("risk_level"),
            F.coalesce(risk_percentage(F.col("_q")), F.lit(0.0)).alias("risk_percentage"),
            F.col("total_rows").alias("sample_size"), F.coalesce("total_records", F.lit(0)).alias("total_records"),
            F.coalesce("anomalies_detected", F.lit(0)).alias("anomalies_detected"),
            share(F.col("anomalies_detected"), F.col("total_records")).alias("anomaly_percentage"),
            at.alias("analysis_timestamp"),
        )
    )
    totals = tables.agg(
        F.count(F.lit(1)).alias("_n"), *[F.round(F.avg(d), 2).alias(d) for d in DETAIL_DIMENSIONS],
        *[F.sum(c).alias(c) for c in ("sample_size", "total_records", "anomalies_detected")],
    ).where("_n > 1").withColumn("_q", quality)
    summary = totals.select(
        F.lit("OVERALL SUMMARY").alias("table_name"), F.lit(source_type).alias("data_source_type"),
        F.lit(database_type).alias("database_type"), F.concat(F.col("_n").cast("string"), F.lit(" tables")).alias("filename"),
        *DETAIL_DIMENSIONS, F.round("_q", 2).alias("overall_quality"), risk_level(F.col("_q")).alias("risk_level"),
        risk_percentage(F.col("_q")).alias("risk_percentage"), "sample_size", "total_records", "anomalies_detected",
        share(F.col("anomalies_detected"), F.col("total_records")).alias("anomaly_percentage"), at.alias("analysis_timestamp"),
    )
    return tables.unionByName(summary).select(*RISK_COLUMNS)


# Advice of the summary, in the order it is given.
SUMMARY_ADVICE = {
    "quality": "Focus on data quality improvement - overall score is below acceptable threshold",
    "anomalies": "Investigate anomalies found by VARIMA analysis for potential data issues",
    "completeness": "Address missing data to improve completeness score",
    "uniqueness": "Review duplicate records to improve uniqueness",
}


def report_summary(metrics: DataFrame, rollup: DataFrame) -> DataFrame:
    """One row: tables, rounded quality, anomalies, risk, and what to do."""
    means = metrics.agg(F.lit(1).alias("j"), F.count(F.lit(1)).alias("tables_analyzed"), *[F.avg(d).alias(d) for d in DETAIL_DIMENSIONS])
    both = means.join(F.broadcast(rollup.drop("tables_analyzed").withColumn("j", F.lit(1))), "j").withColumn("overall_quality", F.round(overall_quality()))
    tests = {
        "quality": F.col("overall_quality") < 70,
        "anomalies": F.col("total_anomalies") > 0,
        "completeness": F.col("completeness") < 90,
        "uniqueness": F.col("uniqueness") < 95,
    }
    return both.select(
        "tables_analyzed", "overall_quality", *DETAIL_DIMENSIONS, "total_anomalies", "total_records", "anomaly_rate", "risk_level",
        F.array_compact(F.array(*[F.when(t, F.lit(SUMMARY_ADVICE[k])) for k, t in tests.items()])).alias("advice"),
    )


def dashboard_overview(quality: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row over stored results: sources, results, anomalies, mean score."""
    q = quality.agg(F.lit(1).alias("j"), F.count(F.lit(1)).alias("_nq"), F.avg(overall_quality()).alias("_score"))
    a = anomalies.agg(F.lit(1).alias("j"), F.count(F.lit(1)).alias("_na"), F.coalesce(F.sum("anomalies_detected"), F.lit(0)).alias("anomalies_detected"))
    names = quality.select("table_name").union(anomalies.select("table_name")).agg(
        F.lit(1).alias("j"), F.count_distinct("table_name").alias("total_sources"))
    return q.join(F.broadcast(a), "j").join(F.broadcast(names), "j").select(
        "total_sources", (F.col("_nq") + F.col("_na")).alias("active_analyses"), "anomalies_detected",
        F.coalesce(F.round("_score"), F.lit(0.0)).alias("avg_quality_score"),
    )


def quality_trend(history: DataFrame) -> DataFrame:
    """Mean score per stored run, oldest first in ``analyzed_at``."""
    return history.groupBy("run_id").agg(F.max("analyzed_at").alias("analyzed_at"), F.round(F.avg(overall_quality()), 2).alias("quality"))
