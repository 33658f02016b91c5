"""Checks of preprocessing and feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import clean as c
from plumbline.operators import features as f

from .detail import detail_sql
from .quality import rounded, tables_sql, union
from .series import daily, orders
from .tables import COLUMNS, is_number, load, with_views

POS = "p AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS i FROM daily_orders)"


def rolling(spark, sf):
    return rounded(f.rolling_stats(orders(spark, sf), ["d"], "total_price", 7).drop("n_orders", "avg_price"), 4)


def rolling_keyed(spark, sf):
    df = load(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return rounded(f.rolling_stats(df, ["ts", "event_id"], "value", 5, ["user_id"]), 4)


def ewma(spark, sf):
    return rounded(f.ewma(orders(spark, sf), ["d"], "total_price", 0.3).select("d", "total_price_ewma"), 3)


def decompose(spark, sf):
    return rounded(f.seasonal_decompose(orders(spark, sf), ["d"], "total_price", 7).select("d", "trend", "seasonal", "residual"), 3)


def _acf_sql(n: int) -> str:
    lags = ", ".join(f"lag(x, {k}) OVER (ORDER BY d) AS l{k}" for k in range(1, n + 1))
    body = "SELECT 0 AS lag, 1e0 AS acf UNION ALL " + " UNION ALL ".join(
        f"SELECT {k}, round(sum(x * l{k}) / sum(x * x), 5) FROM l" for k in range(1, n + 1))
    return daily(f"WITH z AS (SELECT d, total_price - (SELECT avg(total_price) FROM daily_orders) AS x FROM daily_orders), l AS (SELECT d, x, {lags} FROM z) {body}")


def _cross_sql(n: int) -> str:
    lags = ", ".join(f"lag(n_orders, {k}) OVER (ORDER BY d) AS l{k}" for k in range(n + 1))
    return daily(f"WITH l AS (SELECT total_price AS y, {lags} FROM daily_orders) " + " UNION ALL ".join(
        f"SELECT {k} AS lag, round(corr(y, l{k}), 5) AS correlation FROM l" for k in range(n + 1)))


def frequency(spark, sf):
    return rounded(f.frequency(orders(spark, sf), "d"))


def gaps(spark, sf):
    return f.gaps(load(spark, sf, "daily_orders").where("weekday(d) <> 6"), "d", "1 DAY")


def cointegration(spark, sf):
    return rounded(f.cointegration(orders(spark, sf), ["d"], "total_price", "n_orders", lags=0), 3)


def _box_sql() -> str:
    # A dense search: steps of a tenth, then ten times finer around the best, down to 1e-7.
    steps = ["g0 AS (SELECT unnest(range(-40, 41)) / 1e1 AS lam)"]
    for k in range(7):
        fit = "-count(*) / 2e0 * ln(var_pop(CASE WHEN abs(lam) < 1e-12 THEN z ELSE (exp(z * lam) - 1) / lam END))"
        steps.append(f"b{k} AS (SELECT arg_max(lam, fit) AS lam FROM (SELECT lam, {fit} AS fit FROM v, g{k} GROUP BY lam))")
        steps.append(f"g{k + 1} AS (SELECT lam + s / 1e{k + 2} AS lam FROM b{k}, unnest(range(-10, 11)) t(s))")
    return f"""WITH v AS (SELECT ln(value) - (SELECT avg(ln(value)) FROM events WHERE value > 0) AS z FROM events WHERE value > 0), {", ".join(steps)},
      b AS (SELECT round(lam, 4) AS lam FROM b6)
      SELECT event_id, lam, round(CASE WHEN value > 0 THEN CASE WHEN lam = 0 THEN ln(value) ELSE (pow(value, lam) - 1) / lam END END, 5) AS value FROM events, b"""


def box_cox(spark, sf):
    df = load(spark, sf, "events").select("event_id", "value")
    lam = round(f.box_cox_lambda(df, "value"), 4)
    got, _ = f.box_cox(df, "value", lam)
    return rounded(got.withColumn("lam", F.lit(lam)), 5)


def log_transform(spark, sf):
    return rounded(f.log_transform(load(spark, sf, "dirty_events").select("event_id", "value"), ["value"]))


def robust(spark, sf):
    return rounded(f.robust_scale(load(spark, sf, "dirty_events").select("event_id", "value"), ["value"]))


def multicollinearity(spark, sf):
    return rounded(f.multicollinearity(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]), 5)


def multicollinearity_all(spark, sf):
    return f.multicollinearity(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def importance(spark, sf):
    return f.variable_importance(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def selection(spark, sf):
    df = load(spark, sf, "dirty_orders").withColumn("twice", F.col("o_totalprice") * 2)
    return f.feature_selection(df, ["o_totalprice", "twice", "sparse", "flag", "constant"])


def latest(spark, sf):
    return f.latest_per_key(load(spark, sf, "events").select("event_id", "ts", "user_id", "value"), ["user_id"], ["ts", "event_id"])


def critical(spark, sf):
    return f.critical_columns(load(spark, sf, "dirty_orders"))


def imputation(spark, sf):
    df = load(spark, sf, "dirty_orders")
    return rounded(f.imputation_check(df, c.fill_median(df, ["o_totalprice", "sparse"]), ["o_totalprice", "sparse"]), 4)


def before_after(spark, sf):
    df = load(spark, sf, "dirty_orders")
    return rounded(f.before_after(df, c.drop_duplicates(c.drop_nulls(df, "threshold", 0.5))), 4)


def readiness(spark, sf):
    return rounded(union(f.readiness(load(spark, sf, t), t) for t in ("dirty_orders", "dirty_customer")))


def _imputation_sql() -> str:
    parts = []
    for n in ("o_totalprice", "sparse"):
        sides = f"SELECT {n} AS v, 1 AS a, 0 AS b FROM dirty_orders WHERE {n} IS NOT NULL UNION ALL SELECT coalesce({n}, (SELECT median({n}) FROM dirty_orders)), 0, 1 FROM dirty_orders"
        counts = f"SELECT v, sum(a) AS a, sum(b) AS b FROM ({sides}) GROUP BY v"
        apart = f"""(SELECT v, lead(v) OVER (ORDER BY v) AS next, abs(sum(a) OVER (ORDER BY v) / CAST(sum(a) OVER () AS DOUBLE)
          - sum(b) OVER (ORDER BY v) / CAST(sum(b) OVER () AS DOUBLE)) AS gap FROM ({counts}))"""
        parts.append(f"""SELECT '{n}' AS column_name, round(avg(x), 4) AS mean_before, round(avg(y), 4) AS mean_after, round(stddev_samp(x), 4) AS std_before,
          round(stddev_samp(y), 4) AS std_after, round(median(x), 4) AS median_before, round(median(y), 4) AS median_after,
          round(greatest(abs(quantile_cont(x, 0.25) - quantile_cont(y, 0.25)), abs(median(x) - median(y)), abs(quantile_cont(x, 0.75) - quantile_cont(y, 0.75)))
                / (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)), 4) AS quartile_shift,
          (SELECT round(max(gap), 4) FROM {apart}) AS ks_distance, (SELECT round(sum(gap * (next - v)), 4) FROM {apart}) AS wasserstein_distance
          FROM (SELECT {n} AS x, coalesce({n}, (SELECT median({n}) FROM dirty_orders)) AS y FROM dirty_orders) t""")
    return daily_free(" UNION ALL ".join(parts))


def daily_free(sql: str) -> str:
    return with_views(sql, "dirty_orders")


def _critical_sql() -> str:
    names = [n for n, _ in COLUMNS["dirty_orders"]]
    total = " + ".join(f"CASE WHEN {n} IS NULL THEN 1 ELSE 0 END" for n in names)
    return daily_free(" UNION ALL ".join(
        f"SELECT '{n}' AS column_name, count(*) FILTER ({n} IS NULL) AS rows_lost, count(*) FILTER ({n} IS NULL AND {total} = 1) AS rows_lost_only_here, "
        f"round(1e2 * count(*) FILTER ({n} IS NULL) / count(*), 4) AS percent_lost FROM dirty_orders" for n in names))


def _before_after_sql() -> str:
    dense = ", ".join(n for n, _ in COLUMNS["dirty_orders"] if n != "sparse")
    parts = []
    for n, t in COLUMNS["dirty_orders"]:
        mean = f"round(avg(CAST({n} AS DOUBLE)), 4)" if is_number(t) else "CAST(NULL AS DOUBLE)"
        side = lambda src, tag: f"(SELECT count(*) AS row_count_{tag}, count(*) - count({n}) AS null_count_{tag}, count(DISTINCT {n}) AS unique_count_{tag}, {mean} AS mean_value_{tag} FROM {src}) {tag}x"
        after = side("cleaned", "after") if n != "sparse" else "(SELECT CAST(NULL AS BIGINT) AS row_count_after, CAST(NULL AS BIGINT) AS null_count_after, CAST(NULL AS BIGINT) AS unique_count_after, CAST(NULL AS DOUBLE) AS mean_value_after) afterx"
        parts.append(f"SELECT '{n}' AS column_name, * FROM {side('dirty_orders', 'before')}, {after}")
    return daily_free(f"WITH cleaned AS (SELECT DISTINCT {dense} FROM dirty_orders) {' UNION ALL '.join(parts)}")


def _readiness_sql() -> str:
    t = ("dirty_orders", "dirty_customer")
    return with_views(f"""{tables_sql(*t)}, {detail_sql(*t)},
      j AS (SELECT a.table_name AS table_name, a.completeness AS completeness, a.accuracy AS accuracy, b.uniqueness AS row_uniqueness,
                   0.4e0 * a.completeness + 0.3e0 * b.uniqueness + 0.3e0 * a.accuracy AS r FROM tabs a JOIN dtabs b ON a.table_name = b.table_name)
      SELECT table_name, round(completeness, 6) AS completeness, round(accuracy, 6) AS accuracy, round(row_uniqueness, 6) AS row_uniqueness, round(r, 6) AS readiness,
             CASE WHEN r >= 95 THEN 'ready' WHEN r >= 80 THEN 'needs review' ELSE 'not ready' END AS verdict FROM j""", *t)


CHECKS = {
    "rolling_stats": (
        rolling,
        daily("""SELECT d, round(total_price, 4) AS total_price, round(avg(total_price) OVER w, 4) AS total_price_rolling_mean, round(stddev_samp(total_price) OVER w, 4) AS total_price_rolling_std,
                 round(min(total_price) OVER w, 4) AS total_price_rolling_min, round(max(total_price) OVER w, 4) AS total_price_rolling_max
                 FROM daily_orders WINDOW w AS (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""),
    ),
    "rolling_stats_keyed": (
        rolling_keyed,
        """SELECT event_id, ts, user_id, round(value, 4) AS value, round(avg(value) OVER w, 4) AS value_rolling_mean, round(stddev_samp(value) OVER w, 4) AS value_rolling_std,
           round(min(value) OVER w, 4) AS value_rolling_min, round(max(value) OVER w, 4) AS value_rolling_max
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    ),
    "ewma": (
        ewma,
        daily(f"""WITH {POS} SELECT a.d AS d, round(sum(b.total_price * pow(0.7e0, a.i - b.i)) / sum(pow(0.7e0, a.i - b.i)), 3) AS total_price_ewma
                  FROM p a JOIN p b ON b.i <= a.i GROUP BY a.d"""),
    ),
    "seasonal_decompose": (
        decompose,
        daily(f"""WITH {POS},
          t AS (SELECT *, i % 7 AS ph, CASE WHEN count(*) OVER w = 7 THEN avg(total_price) OVER w END AS trend FROM p WINDOW w AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
          m AS (SELECT ph, avg(total_price - trend) AS m FROM t GROUP BY ph), s AS (SELECT ph, m - (SELECT avg(m) FROM m) AS seasonal FROM m)
          SELECT d, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(total_price - trend - seasonal, 3) AS residual FROM t JOIN s USING (ph)"""),
    ),
    "acf": (lambda spark, sf: rounded(f.acf(orders(spark, sf), ["d"], "total_price", 20), 5), _acf_sql(20)),
    "pacf": (lambda spark, sf: f.pacf(orders(spark, sf), ["d"], "total_price", 20), None),
    "cross_correlation": (
        lambda spark, sf: rounded(f.cross_correlation(orders(spark, sf), ["d"], "total_price", "n_orders", 10), 5), _cross_sql(10)
    ),
    "trend": (
        lambda spark, sf: rounded(f.trend(orders(spark, sf), ["d"], "total_price").select("d", "trend", "detrended", "slope"), 3),
        daily(f"""WITH {POS}, r AS (SELECT regr_slope(total_price, i) AS b, regr_intercept(total_price, i) AS a FROM p)
                  SELECT d, round(a + b * i, 3) AS trend, round(total_price - a - b * i, 3) AS detrended, round(b, 3) AS slope FROM p, r"""),
    ),
    "frequency": (
        frequency,
        daily("""WITH s AS (SELECT epoch(lead(d) OVER (ORDER BY d)) - epoch(d) AS step FROM daily_orders), g AS (SELECT step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY step)
                 SELECT CAST(step AS DOUBLE) AS step_seconds, n AS steps, round(n * 1e0 / (SELECT sum(n) FROM g), 6) AS share FROM g ORDER BY n DESC, step LIMIT 1"""),
    ),
    "gaps": (
        gaps,
        daily("""WITH k AS (SELECT d FROM daily_orders WHERE isodow(d) <> 7)
                 SELECT CAST(g AS TIMESTAMP) AS d FROM (SELECT unnest(generate_series((SELECT min(d) FROM k), (SELECT max(d) FROM k), INTERVAL 1 DAY)) AS g) x WHERE g NOT IN (SELECT d FROM k)"""),
    ),
    "lag_selection": (lambda spark, sf: f.lag_selection(orders(spark, sf), ["d"], "total_price"), None),
    "cointegration": (
        cointegration,
        daily("""WITH c AS (SELECT regr_slope(total_price, n_orders) AS b, regr_intercept(total_price, n_orders) AS a FROM daily_orders),
          e AS (SELECT d, total_price - a - b * n_orders AS e FROM daily_orders, c), l AS (SELECT e - lag(e) OVER (ORDER BY d) AS y, lag(e) OVER (ORDER BY d) AS x FROM e),
          t AS (SELECT regr_slope(y, x) / sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / (regr_count(y, x) - 2) / regr_sxx(y, x)) AS tau FROM l)
          SELECT 'total_price' AS left_column, 'n_orders' AS right_column, round(b, 3) AS slope, round(a, 3) AS level, round(tau, 3) AS tau, CAST(0 AS INTEGER) AS lag, tau <= -3.3377e0 AS cointegrated FROM c, t"""),
    ),
    "log_transform": (
        log_transform, with_views("SELECT event_id, round(CASE WHEN value > -1 THEN ln(1 + value) END, 6) AS value FROM dirty_events", "dirty_events")
    ),
    "box_cox": (box_cox, _box_sql()),
    "robust_scale": (
        robust,
        with_views("""SELECT event_id, round((value - m) / (b - a), 6) AS value FROM dirty_events,
                      (SELECT median(value) AS m, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM dirty_events) q""", "dirty_events"),
    ),
    "variable_importance": (importance, None),
    "multicollinearity": (
        multicollinearity,
        """SELECT column_name, round(1 / (1 - r * r), 5) AS vif FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) x,
           (VALUES ('l_quantity'), ('l_extendedprice')) v(column_name)""",
    ),
    "multicollinearity_all": (multicollinearity_all, None),
    "feature_selection": (
        selection,
        daily_free("""SELECT * FROM (VALUES ('o_totalprice', true, NULL), ('twice', false, 'correlated with o_totalprice')) v(column_name, kept, reason)
          UNION ALL SELECT 'sparse', abs(corr(sparse, o_totalprice)) <= 0.95, CASE WHEN abs(corr(sparse, o_totalprice)) > 0.95 THEN 'correlated with o_totalprice' END FROM dirty_orders
          UNION ALL SELECT 'flag', abs(corr(flag, o_totalprice)) <= 0.95, NULL FROM dirty_orders
          UNION ALL SELECT 'constant', false, 'low variance'"""),
    ),
    "key_dedup_time": (
        latest,
        "SELECT event_id, ts, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1",
    ),
    "critical_columns": (critical, _critical_sql()),
    "imputation_check": (imputation, _imputation_sql()),
    "before_after": (before_after, _before_after_sql()),
    "readiness": (readiness, _readiness_sql()),
}
