"""Checks of series preparation, models, and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import anomaly as a
from plumbline.operators import keyed as k
from plumbline.operators import rows as r
from plumbline.operators import series as s

from .quality import rounded, union
from .tables import load, with_views

MEASURES = ["n_orders", "total_price", "avg_price"]


def daily(sql: str) -> str:
    return with_views(sql, "daily_orders")


def orders(spark, sf):
    return load(spark, sf, "daily_orders")


def prepared(spark, sf):
    df = load(spark, sf, "dirty_events")
    return rounded(s.series_prepare(df, ["event_id"], ["value"], "ts"))


IMPUTE = """
  p AS (SELECT *, row_number() OVER ({part}ORDER BY ts, event_id) - 1 AS i FROM dirty_events),
  q AS (SELECT *, CASE WHEN value IS NOT NULL THEN i END AS vi FROM p),
  n AS (SELECT *, last_value(value IGNORE NULLS) OVER f AS v0, last_value(vi IGNORE NULLS) OVER f AS i0,
               last_value(value IGNORE NULLS) OVER b AS v1, last_value(vi IGNORE NULLS) OVER b AS i1 FROM q
        WINDOW f AS ({part}ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               b AS ({part}ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  filled AS (SELECT * EXCLUDE (value), coalesce(value, CASE WHEN i1 > i0 THEN v0 + (v1 - v0) * ((i - i0) * 1e0 / (i1 - i0)) END, v0, v1) AS value FROM n)"""


def valid_columns(spark, sf):
    df = load(spark, sf, "dirty_orders")
    rows = [(c,) for c in s.valid_series_columns(df)]
    return spark.createDataFrame(rows, "column_name string")


def imputed(spark, sf):
    df = load(spark, sf, "dirty_events")
    return rounded(s.impute_series(df, ["ts", "event_id"], ["value"], ["user_id"]))


def pca(spark, sf):
    got, fitted = s.pca_project(orders(spark, sf), ["n_orders", "total_price"])
    ratio = s.explained_variance(spark, fitted)
    return rounded(got.select("d", "PC_1", "PC_2").withColumn("ratio_1", F.lit(fitted.ratios[0])), 5)


def pca_embeddings(spark, sf):
    got, _ = s.pca_vectors(load(spark, sf, "embeddings"), "embedding")
    return got.select("vec_id", "PC_1", "PC_2", "PC_3", "PC_4", "PC_5")


def pca_lineitem(spark, sf):
    got, fitted = s.pca_project(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(got.agg(*[F.var_pop(f"PC_{i}").alias(f"variance_{i}") for i in range(1, 5)]))


def adf(spark, sf):
    return rounded(s.adf_stationarity(orders(spark, sf), ["d"], ["total_price"], lags=0), 4)


def adf_full(spark, sf):
    return s.adf_stationarity(orders(spark, sf), ["d"], MEASURES)


def differenced(spark, sf):
    return rounded(s.difference_series(orders(spark, sf), ["d"], MEASURES))


def var_fit(spark, sf):
    return rounded(s.var1_coefficients(s.scale_series(orders(spark, sf), MEASURES), ["d"], ["total_price"]), 5)


def var_fit_full(spark, sf):
    return s.var1_coefficients(s.scale_series(orders(spark, sf), MEASURES), ["d"], MEASURES)


def var_residuals(spark, sf):
    scaled = s.scale_series(orders(spark, sf), MEASURES)
    return rounded(s.var1_residual_anomalies(scaled, ["d"], ["total_price"]).select("d", "score", "anomaly"), 5)


VAR1 = """
  z AS (SELECT d, (total_price - (SELECT avg(total_price) FROM daily_orders)) / (SELECT stddev_pop(total_price) FROM daily_orders) AS y FROM daily_orders),
  l AS (SELECT d, y, lag(y) OVER (ORDER BY d) AS x FROM z),
  c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l),
  r AS (SELECT d, y - a - b * x AS r FROM l, c),
  m AS (SELECT avg(r) AS m, stddev_samp(r) AS s FROM r)"""


def flagged(spark, sf):
    return s.var1_residual_anomalies(s.scale_series(orders(spark, sf), MEASURES), ["d"], ["total_price"])


def detect(spark, sf):
    return a.detect_anomalies(orders(spark, sf), ["d"], columns=MEASURES)


def detect_events(spark, sf):
    return a.detect_anomalies(load(spark, sf, "dirty_events"), ["ts", "event_id"], columns=["value"])


def run(spark, sf):
    return a.run_anomalies(orders(spark, sf), ["d"])


def summary(spark, sf):
    return rounded(a.anomaly_summary(flagged(spark, sf), "daily_orders", 1), 5)


def keys(spark, sf):
    return rounded(a.anomaly_keys(flagged(spark, sf), ["d"]), 5)


def severities(spark, sf):
    got = a.with_severity(flagged(spark, sf))
    return rounded(got.select("d", "score", "severity", "ui_severity", "confidence"), 5)


def top(spark, sf):
    return rounded(a.top_anomalies(flagged(spark, sf), ["d"]).select("d", "score"), 5)


def _events_flagged(spark, sf):
    daily_events = s.scale_series(load(spark, sf, "daily_events"), ["sum_value"])
    return s.var1_residual_anomalies(daily_events, ["d"], ["sum_value"])


def summaries(spark, sf):
    """Detection on all tables: text days and copies, several measures, one that is no series, one that is not there."""
    return a.summarize_tables(spark, {
        "order_series": (lambda: load(spark, sf, "order_series"), ["order_date"]),
        "price_series": (load(spark, sf, "price_series"), ["d"]),
        "region": (load(spark, sf, "region"), ["r_regionkey"]),
        "absent_table": (lambda: spark.read.parquet(f"{sf}/absent_table.parquet"), ["x"]),
    })


def table_anomalies(spark, sf):
    got = summaries(spark, sf).drop("component_shares", "threshold", "model_type")
    return rounded(got.withColumn("columns_analyzed", F.array_join("columns_analyzed", ",")).withColumn("differenced", F.array_join("differenced", ",")), 5)


def rollup(spark, sf):
    return rounded(a.anomaly_rollup(summaries(spark, sf)), 5)


def run_text(spark, sf):
    """A run on days written as text, with copies; every row is flagged."""
    return rounded(a.run_anomalies(load(spark, sf, "order_series"), ["order_date"]), 5)


def detect_pair(spark, sf):
    return rounded(a.detect_anomalies(orders(spark, sf), ["d"], columns=["n_orders", "total_price"]).select("d", "score", "anomaly"), 5)


def var_fit_keys(spark, sf):
    return rounded(k.coefficients_by_key(load(spark, sf, "dirty_events"), ["ts", "event_id"], ["user_id"], "value"), 5)


def detect_keys(spark, sf):
    """One model per user, over the values of all users at once."""
    got = k.detect_by_key(load(spark, sf, "dirty_events"), ["ts", "event_id"], ["user_id"], ["value"], difference=False)
    return rounded(got.select("event_id", "user_id", "score", "anomaly", "status"), 5)


def detect_keys_differenced(spark, sf):
    return a.detect_anomalies(load(spark, sf, "dirty_events"), ["ts", "event_id"], keys=["user_id"], columns=["value"])


def pair_sql(p: str, c1: str, c2: str, view: str = "daily_orders") -> str:
    """Scores of two measures: components are their sum and difference, each regressed on both the day before."""
    det = "(sxx * syy - sxy * sxy)"
    beta = lambda v: f"(s{v}x * syy - s{v}y * sxy) / {det} AS {v}1, (s{v}y * sxx - s{v}x * sxy) / {det} AS {v}2"
    return f"""
  {p}z AS (SELECT d, ({c1} - avg({c1}) OVER ()) / stddev_pop({c1}) OVER () AS u, ({c2} - avg({c2}) OVER ()) / stddev_pop({c2}) OVER () AS w FROM {view}),
  {p}l AS (SELECT d, (u + w) / sqrt(2) AS a, (u - w) / sqrt(2) AS b, lag((u + w) / sqrt(2)) OVER (ORDER BY d) AS x, lag((u - w) / sqrt(2)) OVER (ORDER BY d) AS y FROM {p}z),
  {p}c AS (SELECT var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy, covar_pop(a, x) AS sax, covar_pop(a, y) AS say, covar_pop(b, x) AS sbx,
                  covar_pop(b, y) AS sby FROM {p}l WHERE x IS NOT NULL),
  {p}k AS (SELECT {beta('a')}, {beta('b')} FROM {p}c),
  {p}r AS (SELECT d, a - a1 * x - a2 * y AS ra, b - b1 * x - b2 * y AS rb FROM {p}l, {p}k),
  {p}s AS (SELECT d, greatest(abs((ra - avg(ra) OVER ()) / stddev_samp(ra) OVER ()), abs((rb - avg(rb) OVER ()) / stddev_samp(rb) OVER ())) AS score FROM {p}r)"""


ORDERS_PAIR, PRICES_PAIR = pair_sql("ord_", "n_orders", "total_price"), pair_sql("prc_", "total_price", "avg_price")
#: Rows, anomalies and largest score of the two tables that are series; copied days count twice.
TABLES = f"""{ORDERS_PAIR}, {PRICES_PAIR},
  oc AS (SELECT score, CASE WHEN day(d) % 7 = 0 THEN 2 ELSE 1 END AS n FROM ord_s),
  an AS (SELECT 'order_series' AS table_name, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (score > 2), 0)::BIGINT AS a, max(score) AS top FROM oc
         UNION ALL SELECT 'price_series', count(*), count(*) FILTER (score > 2), max(score) FROM prc_s)"""
KEYED = f"""{IMPUTE.format(part='PARTITION BY user_id ')},
  v AS (SELECT user_id, count(*) AS n, count(value) * 2 > count(*) AND stddev_samp(value) > 1e-6 AS ok FROM dirty_events GROUP BY user_id),
  z AS (SELECT f.*, v.n, v.ok, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS y FROM filled f JOIN v USING (user_id) WINDOW w AS (PARTITION BY user_id)),
  l AS (SELECT *, lag(y) OVER (PARTITION BY user_id ORDER BY i) AS x FROM z),
  c AS (SELECT user_id, any_value(n) AS n, any_value(ok) AS ok, regr_slope(y, x) AS slope, regr_intercept(y, x) AS constant FROM l GROUP BY user_id),
  st AS (SELECT *, CASE WHEN n < 10 THEN 'too few rows' WHEN ok THEN 'ok' ELSE 'no valid column' END AS status FROM c)"""


def rollup_legacy(spark, sf):
    return a.anomaly_rollup_legacy({"daily_orders": flagged(spark, sf), "daily_events": _events_flagged(spark, sf)})


def selected(spark, sf):
    tables = {"daily_orders": orders(spark, sf), "daily_events": load(spark, sf, "daily_events")}
    both = r.union_tables(tables)
    return a.detect_selected_tables(both, {
        "daily_orders": (["d"], ["n_orders", "total_price"]), "daily_events": (["d"], ["n_events", "sum_value"])})


VAR1_EVENTS = VAR1.replace("daily_orders", "daily_events").replace("total_price", "sum_value")
for _n in "zlcrm":
    VAR1_EVENTS = VAR1_EVENTS.replace(f"  {_n} AS (", f"  e{_n} AS (").replace(f"FROM {_n})", f"FROM e{_n})").replace(f"FROM {_n},", f"FROM e{_n},").replace(f", {_n})", f", e{_n})")
SCORES = "sc AS (SELECT d, abs((r - m) / s) AS score FROM r, m)"
SCORES_EVENTS = "esc AS (SELECT d, abs((r - m) / s) AS score FROM er, em)"
BOTH = f"{VAR1}, {SCORES}, {VAR1_EVENTS}, {SCORES_EVENTS}"

CHECKS = {
    "series_prepare": (
        prepared,
        with_views(f"WITH {IMPUTE.format(part='').strip()} SELECT i AS _pos, ts, round(value, 6) AS value FROM filled", "dirty_events"),
    ),
    "valid_series_columns": (
        valid_columns,
        with_views(
            " UNION ALL ".join(
                f"SELECT '{n}' AS column_name FROM dirty_orders HAVING (count(*) - count({n})) * 1e0 / count(*) < 0.5 AND stddev_samp({n}) > 1e-6"
                for n in ("o_orderkey", "o_custkey", "o_totalprice", "sparse", "flag", "constant")
            ),
            "dirty_orders",
        ),
    ),
    "impute_series": (
        imputed,
        with_views(
            f"WITH {IMPUTE.format(part='PARTITION BY user_id ').strip()} SELECT event_id, ts, user_id, event_type, round(value, 6) AS value FROM filled WHERE value IS NOT NULL",
            "dirty_events",
        ),
    ),
    "scale_series": (
        lambda spark, sf: rounded(s.scale_series(orders(spark, sf), MEASURES)),
        daily("SELECT d, " + ", ".join(f"round(({n} - (SELECT avg({n}) FROM daily_orders)) / (SELECT stddev_pop({n}) FROM daily_orders), 6) AS {n}" for n in MEASURES) + " FROM daily_orders"),
    ),
    "pca_project": (
        pca,
        daily("""
          WITH m AS (SELECT avg(n_orders) AS m1, stddev_pop(n_orders) AS s1, avg(total_price) AS m2, stddev_pop(total_price) AS s2, corr(n_orders, total_price) AS r FROM daily_orders),
          z AS (SELECT d, (n_orders - m1) / s1 AS z1, (total_price - m2) / s2 AS z2, sign(r) AS g, abs(r) AS r FROM daily_orders, m)
          SELECT d, round((z1 + g * z2) / sqrt(2e0), 5) AS PC_1, round((z1 - g * z2) / sqrt(2e0), 5) AS PC_2, round((1 + r) / 2, 5) AS ratio_1 FROM z"""),
    ),
    "pca_embeddings": (pca_embeddings, None),
    "pca_lineitem": (pca_lineitem, None),
    "adf_stationarity": (
        adf,
        daily("""
          WITH l AS (SELECT total_price - lag(total_price) OVER (ORDER BY d) AS y, lag(total_price) OVER (ORDER BY d) AS x FROM daily_orders),
          c AS (SELECT regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) * (1 - regr_r2(y, x)) AS ssr, regr_count(y, x) AS n FROM l)
          SELECT 'total_price' AS column_name, round(b / sqrt(ssr / (n - 2) / sxx), 4) AS tau, CAST(0 AS INTEGER) AS lag, CAST(n AS INTEGER) AS rows_used,
                 b / sqrt(ssr / (n - 2) / sxx) <= -2.8615e0 AS stationary FROM c"""),
    ),
    "adf_lag_choice": (adf_full, None),
    "difference_series": (
        differenced,
        daily("SELECT * FROM (SELECT d, " + ", ".join(f"round(CAST({n} - lag({n}) OVER (ORDER BY d) AS DOUBLE), 6) AS {n}" for n in MEASURES) + " FROM daily_orders) x WHERE n_orders IS NOT NULL"),
    ),
    "var1_fit": (
        var_fit,
        daily(f"WITH {VAR1.strip()} SELECT 'total_price' AS equation, 'const' AS term, round(a, 5) AS value FROM c UNION ALL SELECT 'total_price', 'total_price', round(b, 5) FROM c"),
    ),
    "var1_fit_multivariate": (var_fit_full, None),
    "var1_residual_anomalies": (
        var_residuals,
        daily(f"WITH {VAR1.strip()}, {SCORES} SELECT d, round(score, 5) AS score, coalesce(score > 2, false) AS anomaly FROM sc"),
    ),
    "detect_anomalies": (detect, None),
    "detect_anomalies_events": (detect_events, None),
    "detect_anomalies_pair": (
        detect_pair, daily(f"WITH {ORDERS_PAIR.strip()} SELECT d, round(score, 5) AS score, coalesce(score > 2, false) AS anomaly FROM ord_s")
    ),
    "detect_anomalies_keys": (
        detect_keys,
        with_views(f"""WITH {KEYED.strip()}, r AS (SELECT l.*, st.status, y - constant - slope * x AS r FROM l JOIN st USING (user_id)),
          sc AS (SELECT event_id, user_id, status, CASE WHEN status = 'ok' THEN abs((r - avg(r) OVER w) / stddev_samp(r) OVER w) END AS score FROM r WINDOW w AS (PARTITION BY user_id))
          SELECT event_id, user_id, round(score, 5) AS score, coalesce(score > 2, false) AS anomaly, status FROM sc""", "dirty_events"),
    ),
    "detect_anomalies_keys_differenced": (detect_keys_differenced, None),
    "var1_fit_keys": (
        var_fit_keys,
        with_views(f"""WITH {KEYED.strip()} SELECT user_id, n AS rows, CASE WHEN status = 'ok' THEN round(constant, 5) END AS constant,
                       CASE WHEN status = 'ok' THEN round(slope, 5) END AS slope, status FROM st""", "dirty_events"),
    ),
    "run_anomalies": (run, None),
    "run_anomalies_text": (
        run_text,
        daily(f"""WITH {ORDERS_PAIR.strip()} SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS order_date, n_orders, round(total_price, 5) AS total_price, round(score, 5) AS score,
                  coalesce(score > 2, false) AS anomaly_varima, 'ok' AS status FROM ord_s JOIN daily_orders USING (d), range(2) t(copy) WHERE copy = 0 OR day(d) % 7 = 0"""),
    ),
    "anomaly_tables": (
        table_anomalies,
        daily(f"""WITH {TABLES.strip()}
          SELECT table_name, n AS total_observations, 2 AS numeric_columns, a AS anomalies_detected, round(1e2 * a / n, 5) AS anomaly_percentage,
                 round(top, 5) AS max_score, CASE table_name WHEN 'order_series' THEN 'n_orders,total_price' ELSE 'total_price,avg_price' END AS columns_analyzed,
                 '' AS differenced, 'ok' AS status, CAST(NULL AS VARCHAR) AS error FROM an
          UNION ALL SELECT 'region', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'fewer than two numeric columns', 'NoSeries'
          UNION ALL SELECT 'absent_table', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'failed', 'AnalysisException'"""),
    ),
    "anomaly_summary": (
        summary,
        daily(f"""WITH {VAR1.strip()}, {SCORES} SELECT 'daily_orders' AS table_name, count(*) AS total_observations, 1 AS numeric_columns,
                  count(*) FILTER (score > 2) AS anomalies_detected, round(1e2 * count(*) FILTER (score > 2) / count(*), 5) AS anomaly_percentage,
                  round(max(score), 5) AS max_score, 2e0 AS threshold, 'PCA + VAR(1)' AS model_type FROM sc"""),
    ),
    "anomaly_keys": (keys, daily(f"WITH {VAR1.strip()}, {SCORES} SELECT d, round(score, 5) AS score FROM sc WHERE score > 2")),
    "anomaly_severity": (
        severities,
        daily(f"""WITH {VAR1.strip()}, {SCORES} SELECT d, round(score, 5) AS score,
                  CASE WHEN score > 3.5e0 THEN 'high' WHEN score > 2.5e0 THEN 'medium' ELSE 'low' END AS severity,
                  CASE WHEN score > 3 THEN 'high' WHEN score > 2 THEN 'medium' ELSE 'low' END AS ui_severity,
                  least(95e0, round(score * 30)) AS confidence FROM sc WHERE score > 2"""),
    ),
    "top_anomalies": (
        top, daily(f"WITH {VAR1.strip()}, {SCORES} SELECT d, round(score, 5) AS score FROM sc WHERE score > 2 ORDER BY sc.score DESC, d LIMIT 5")
    ),
    "anomaly_rollup": (
        rollup,
        daily(f"""WITH {TABLES.strip()}
          SELECT round(1e2 * sum(a) / sum(n), 5) AS anomaly_rate, CASE WHEN sum(a) = 0 THEN 'low' WHEN 1e2 * sum(a) / sum(n) < 5 THEN 'medium' ELSE 'high' END AS risk_level,
                 CAST(sum(a) AS BIGINT) AS total_anomalies, CAST(sum(n) AS BIGINT) AS total_records, count(*) + 2 AS tables_analyzed, CAST(2 AS BIGINT) AS tables_failed,
                 count(*) FILTER (a > 0) AS tables_with_anomalies FROM an"""),
    ),
    "anomaly_rollup_legacy": (
        rollup_legacy,
        with_views(f"""WITH {BOTH.strip()}, b AS (SELECT score FROM sc UNION ALL SELECT score FROM esc)
          SELECT round(1e2 * count(*) FILTER (score > 2) / count(*), 2) AS anomaly_rate,
                 CASE WHEN count(*) FILTER (score > 2) > count(*) * 5e-2 THEN 'High' WHEN count(*) FILTER (score > 2) > count(*) * 2e-2 THEN 'Medium' ELSE 'Low' END AS risk_level,
                 count(*) FILTER (score > 2) AS total_anomalies, count(*) AS total_records, CAST(2 AS BIGINT) AS tables_analyzed,
                 count(*) FILTER (score > 3.5e0) AS high_severity, count(*) FILTER (score > 2.5e0 AND score <= 3.5e0) AS medium_severity,
                 count(*) FILTER (score > 2 AND score <= 2.5e0) AS low_severity FROM b""", "daily_orders", "daily_events"),
    ),
    "detect_selected_tables": (selected, None),
}
