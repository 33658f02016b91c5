"""Checks of sources, stores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import anomaly as a
from plumbline.operators import detail as d
from plumbline.operators import quality as q
from plumbline.operators import report as p
from plumbline.plans.materialize import fresh_path
from plumbline.sources import catalog, files, store

from . import detail as cd
from . import series as cs
from .quality import columns, rounded, scored_sql, sources, tables_sql, union
from .tables import COLUMNS, RELATIONAL, load, with_views


def csv(sep: str | None, table: str, dates: bool = False):
    def run(spark, sf):
        path = files.write_delimited(load(spark, sf, table), fresh_path(spark, "csv"), sep or ";")
        return files.read_delimited(spark, path, sep, dates=dates)

    return run


def csv_line_breaks(spark, sf):
    """All documents, whose texts hold line breaks, quotes and delimiters, written and read back."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = files.write_delimited(docs, fresh_path(spark, "csv"))
    return files.read_delimited(spark, path, schema=docs.schema, na_tokens=())


def csv_missing(spark, sf):
    df = load(spark, sf, "dirty_orders").select(
        "o_orderkey", F.when(F.col("o_totalprice").isNull(), "N/A").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("sparse").isNull(), "null").otherwise("set").alias("state"))
    path = files.write_delimited(df, fresh_path(spark, "csv"))
    return files.read_delimited(spark, path)


def row_counts(spark, sf):
    counts = catalog.table_row_counts(spark, sources(spark, sf))
    total = catalog.total_rows(counts).select(F.lit("(total)").alias("table_name"), F.col("total_records").alias("record_count"))
    return counts.withColumn("failed", F.col("error").isNotNull()).drop("error").unionByName(total, allowMissingColumns=True)


def statistics(spark, sf):
    facts, _ = catalog.table_statistics(load(spark, sf, "dirty_customer"), "dirty_customer", ["c_custkey"], analyzed=True)
    return facts.withColumn("samples", F.array_join("samples", " | "))


def column_catalog(spark, sf):
    got = catalog.column_catalog(spark, {
        "nation": (lambda: load(spark, sf, "nation"), ["n_nationkey"]),
        "dirty_customer": (lambda: load(spark, sf, "dirty_customer"), ["c_custkey"]),
        "absent_table": (lambda: spark.read.parquet(f"{sf}/absent_table.parquet"), []),
    })
    return got.withColumn("data_type", F.when(F.col("column_name") != "ERROR", F.col("data_type")))


def _catalog_sql() -> str:
    parts = []
    for t, key in (("nation", "n_nationkey"), ("dirty_customer", "c_custkey")):
        for n, k in COLUMNS[t]:
            parts.append(
                f"SELECT '{t}' AS table_name, '{n}' AS column_name, '{k}' AS data_type, count(*) - count({n}) AS null_count, count(DISTINCT {n}) AS unique_count, "
                f"(SELECT substr('[' || string_agg(CAST({n} AS VARCHAR), ', ' ORDER BY {key}) || ']', 1, 100) FROM (SELECT {n}, {key} FROM {t} WHERE {n} IS NOT NULL ORDER BY {key} LIMIT 3) x) AS sample_values FROM {t}"
            )
    parts.append("SELECT 'absent_table', 'ERROR', NULL, NULL, NULL, NULL")
    return with_views(" UNION ALL ".join(parts), "dirty_customer")


def _statistics_sql() -> str:
    parts = [
        f"SELECT 'dirty_customer' AS table_name, count(*) AS total_rows, 5 AS total_columns, {i} AS position, '{n}' AS column_name, '{k}' AS data_type, count({n}) AS non_null, "
        f"(SELECT string_agg(CAST({n} AS VARCHAR), ' | ' ORDER BY c_custkey) FROM (SELECT {n}, c_custkey FROM dirty_customer WHERE {n} IS NOT NULL ORDER BY c_custkey LIMIT 3) x) AS samples, true AS is_analyzed FROM dirty_customer"
        for i, (n, k) in enumerate(COLUMNS["dirty_customer"])
    ]
    return with_views(" UNION ALL ".join(parts), "dirty_customer")


def report_tables(spark, sf):
    return rounded(p.table_statistics_report(q.dataset_metrics(spark, sources(spark, sf))))


def report_columns(spark, sf):
    return rounded(p.column_statistics_report(columns(spark, sf, "part", "dirty_customer").withColumn("mean_value", F.round("mean_value", 5))))


AT = "TIMESTAMP_NTZ '2024-01-31 12:00:00'"


def _summaries(spark, sf):
    """Detection on the tables of the risk report; those that are no series have no row."""
    return cs.summaries(spark, sf).where("error IS NULL")


RISK_TABLES = ("order_series", "price_series", "customer")
SERIES = ("order_series", "price_series")
_VIEWS = ("daily_orders", *SERIES)


def risk_report(spark, sf):
    got = p.risk_report(cd.metrics(spark, sf, RISK_TABLES), _summaries(spark, sf), F.expr(AT))
    return got


_ANOM = cs.TABLES.strip()
_R2 = ", ".join(f"round({x}, 2) AS {x}" for x in d.DETAIL_DIMENSIONS)
_SUM = " + ".join(d.DETAIL_DIMENSIONS)
_RISK = "CASE WHEN {q} >= 80 THEN 'Low' WHEN {q} >= 60 THEN 'Medium' ELSE 'High' END"


def _risk_sql() -> str:
    cols = ", ".join(p.RISK_COLUMNS)
    return with_views(f"""
      WITH {_ANOM}, {cd.detail_sql(*RISK_TABLES)},
      t AS (SELECT table_name, 'database' AS data_source_type, 'parquet' AS database_type, 'N/A' AS filename, {_R2}, ({_SUM}) / 5 AS q0,
                   total_rows AS sample_size, coalesce(n, 0) AS total_records, coalesce(a, 0) AS anomalies_detected,
                   coalesce(round(1e2 * a / n, 2), 0e0) AS anomaly_percentage, TIMESTAMP '2024-01-31 12:00:00' AS analysis_timestamp
            FROM dtabs LEFT JOIN an USING (table_name)),
      s AS (SELECT count(*) AS k, {', '.join(f'round(avg({x}), 2) AS {x}' for x in d.DETAIL_DIMENSIONS)}, CAST(sum(sample_size) AS BIGINT) AS sample_size,
                   CAST(sum(total_records) AS BIGINT) AS total_records, CAST(sum(anomalies_detected) AS BIGINT) AS anomalies_detected FROM t),
      u AS (SELECT *, ({_SUM}) / 5 AS q0 FROM s)
      SELECT {cols} FROM (
        SELECT *, round(q0, 2) AS overall_quality, {_RISK.format(q='q0')} AS risk_level, round(greatest(0e0, 1e2 - q0), 2) AS risk_percentage FROM t)
      UNION ALL SELECT 'OVERALL SUMMARY', 'database', 'parquet', k || ' tables', {', '.join(d.DETAIL_DIMENSIONS)}, round(q0, 2), {_RISK.format(q='q0')},
             round(greatest(0e0, 1e2 - q0), 2), sample_size, total_records, anomalies_detected, coalesce(round(1e2 * anomalies_detected / total_records, 2), 0e0),
             TIMESTAMP '2024-01-31 12:00:00' FROM u""", *_VIEWS)


def report_summary(spark, sf):
    rollup = a.anomaly_rollup(_summaries(spark, sf))
    got = p.report_summary(cd.metrics(spark, sf, SERIES), rollup)
    return rounded(got.withColumn("advice", F.array_join("advice", " | ")), 5)


def _summary_sql() -> str:
    advice = p.SUMMARY_ADVICE
    return with_views(f"""
      WITH {_ANOM}, {cd.detail_sql(*SERIES)},
      mt AS (SELECT count(*) AS tables_analyzed, {', '.join(f'avg({x}) AS {x}' for x in d.DETAIL_DIMENSIONS)} FROM dtabs),
      rt AS (SELECT CAST(sum(a) AS BIGINT) AS total_anomalies, CAST(sum(n) AS BIGINT) AS total_records, 1e2 * sum(a) / sum(n) AS rate FROM an),
      bt AS (SELECT *, round(({_SUM}) / 5) AS overall_quality FROM mt, rt)
      SELECT tables_analyzed, overall_quality, {', '.join(f'round({x}, 5) AS {x}' for x in d.DETAIL_DIMENSIONS)}, total_anomalies, total_records, round(rate, 5) AS anomaly_rate,
             CASE WHEN rate = 0 THEN 'low' WHEN rate < 5 THEN 'medium' ELSE 'high' END AS risk_level,
             concat_ws(' | ', CASE WHEN overall_quality < 70 THEN '{advice['quality']}' END, CASE WHEN total_anomalies > 0 THEN '{advice['anomalies']}' END,
                       CASE WHEN completeness < 90 THEN '{advice['completeness']}' END, CASE WHEN uniqueness < 95 THEN '{advice['uniqueness']}' END) AS advice
      FROM bt""", *_VIEWS)


NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def _store(spark, sf):
    """Two runs of all tables, one of them out of date for one table."""
    path = fresh_path(spark, "results")
    metrics = cd.metrics(spark, sf, ("nation", "region", "supplier"))
    store.save_results(metrics.where("table_name <> 'supplier'").withColumn("completeness", F.lit(0.0)), path, "quality_metrics", "run-1", F.expr("TIMESTAMP '2024-01-31 23:15:00'"))
    store.save_results(metrics.where("table_name <> 'region'"), path, "quality_metrics", "run-2", F.expr("TIMESTAMP '2024-01-31 23:30:00'"))
    store.save_results(metrics, path, "quality_metrics", "run-0", F.expr("TIMESTAMP '2024-01-30 00:00:00'"))
    return path, metrics


RESULT_SCHEMA = "total_rows long, total_columns long, completeness double, uniqueness double, cardinality double, consistency double, volumetry double"


def results_store(spark, sf):
    path, _ = _store(spark, sf)
    return rounded(store.latest_results(spark, path, "quality_metrics", RESULT_SCHEMA, now=F.expr(NOW)).drop("analyzed_at"))


def results_history(spark, sf):
    path, _ = _store(spark, sf)
    stored = store.load_results(spark, path)
    flat = stored.select("run_id", "analyzed_at", F.from_json("payload", RESULT_SCHEMA).alias("p")).select("run_id", "analyzed_at", "p.*")
    return p.quality_trend(flat).drop("analyzed_at")


def publish(spark, sf):
    metrics = cd.metrics(spark, sf, ("nation",))
    return rounded(store.publish_rows(metrics, a.anomaly_summary(cs.flagged(spark, sf), "daily_orders", 1), "source-1", F.expr(AT)))


def dashboard(spark, sf):
    path, _ = _store(spark, sf)
    quality = store.latest_results(spark, path, "quality_metrics", RESULT_SCHEMA, now=F.expr(NOW))
    return p.dashboard_overview(quality, _summaries(spark, sf))


_STORED = ("nation", "region", "supplier")
_DIMS6 = ", ".join(f"round({x}, 6) AS {x}" for x in d.DETAIL_DIMENSIONS)

CHECKS = {
    "scan_csv": (csv(",", "orders", dates=True), "SELECT * FROM orders"),
    "scan_csv_types": (
        csv(",", "part"),
        "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
    ),
    "scan_csv_missing_words": (
        csv_missing,
        with_views("SELECT o_orderkey, o_totalprice AS price, CASE WHEN sparse IS NOT NULL THEN 'set' END AS state FROM dirty_orders", "dirty_orders"),
    ),
    "scan_csv_line_breaks": (csv_line_breaks, "SELECT * FROM documents"),
    "scan_csv_sniffed": (csv(None, "customer"), "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "write_csv": (csv("\t", "supplier"), "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier"),
    "table_row_counts": (
        row_counts,
        "WITH c AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS record_count FROM {t}" for t in RELATIONAL)
        + ") SELECT table_name, record_count, false AS failed FROM c UNION ALL SELECT 'absent_table', NULL, true UNION ALL SELECT '(total)', CAST(sum(record_count) AS BIGINT), NULL FROM c",
    ),
    "table_statistics": (statistics, _statistics_sql()),
    "column_catalog": (column_catalog, _catalog_sql()),
    "statistics_report": (
        report_tables,
        f"""{tables_sql(*RELATIONAL)} SELECT table_name AS Table_Name, total_rows AS Total_Rows, total_columns AS Total_Columns, round(quality_score, 6) AS Quality_Score,
            round(completeness, 6) AS Completeness, round(validity, 6) AS Validity, round(consistency, 6) AS Consistency, round(uniqueness, 6) AS Uniqueness,
            round(accuracy, 6) AS Accuracy FROM tabs""",
    ),
    "statistics_report_columns": (
        report_columns,
        with_views(
            f"""SELECT table_name AS Table_Name, column_name AS Column_Name, data_type AS Data_Type, round(completeness, 6) AS Completeness, round(validity, 6) AS Validity,
                round(consistency, 6) AS Consistency, round(uniqueness, 6) AS Uniqueness, round(accuracy, 6) AS Accuracy, null_count AS Null_Count, unique_count AS Unique_Count,
                round(min_value, 6) AS Min_Value, round(max_value, 6) AS Max_Value, round(mean_value, 5) AS Mean_Value FROM ({scored_sql('part', 'dirty_customer')}) s""",
            "dirty_customer",
        ),
    ),
    "statistics_report_risk": (risk_report, _risk_sql()),
    "report_summary": (report_summary, _summary_sql()),
    "results_store": (
        results_store,
        f"""WITH {cd.detail_sql(*_STORED)} SELECT table_name, CASE WHEN table_name = 'region' THEN 'run-1' ELSE 'run-2' END AS run_id, total_rows, total_columns,
            CASE WHEN table_name = 'region' THEN 0e0 ELSE round(completeness, 6) END AS completeness, round(uniqueness, 6) AS uniqueness, round(cardinality, 6) AS cardinality,
            round(consistency, 6) AS consistency, round(volumetry, 6) AS volumetry FROM dtabs""",
    ),
    "results_history": (
        results_history,
        f"""WITH {cd.detail_sql(*_STORED)}, r AS (
              SELECT 'run-0' AS run_id, ({_SUM}) / 5 AS q FROM dtabs UNION ALL
              SELECT 'run-1', ({_SUM} - completeness) / 5 FROM dtabs WHERE table_name <> 'supplier' UNION ALL
              SELECT 'run-2', ({_SUM}) / 5 FROM dtabs WHERE table_name <> 'region')
            SELECT run_id, round(avg(q), 2) AS quality FROM r GROUP BY run_id""",
    ),
    "publish_rows": (
        publish,
        with_views(f"""WITH {cs.VAR1.strip()}, {cs.SCORES}, {cd.detail_sql('nation')}
          SELECT 'quality_metrics' AS analysis_type, 'source-1' AS connection_id, {_DIMS6}, TIMESTAMP '2024-01-31 12:00:00' AS analyzed_at,
                 CAST(NULL AS VARCHAR) AS model_type, CAST(NULL AS BIGINT) AS anomalies_detected, CAST(NULL AS BIGINT) AS total_records FROM dtabs
          UNION ALL SELECT 'anomaly_detection', 'source-1', NULL, NULL, NULL, NULL, NULL, TIMESTAMP '2024-01-31 12:00:00', 'PCA + VAR(1)',
                 count(*) FILTER (score > 2), count(*) FROM sc""", "daily_orders"),
    ),
    "dashboard_overview": (
        dashboard,
        with_views(f"""WITH {_ANOM}, {cd.detail_sql(*_STORED)},
          s AS (SELECT avg(({_SUM} - CASE WHEN table_name = 'region' THEN completeness ELSE 0 END) / 5) AS q FROM dtabs)
          SELECT (SELECT count(*) FROM (SELECT table_name FROM dtabs UNION SELECT table_name FROM an)) AS total_sources,
                 (SELECT count(*) FROM dtabs) + (SELECT count(*) FROM an) AS active_analyses, (SELECT CAST(sum(a) AS BIGINT) FROM an) AS anomalies_detected,
                 (SELECT round(q) FROM s) AS avg_quality_score""", "daily_orders", "daily_events"),
    ),
}
