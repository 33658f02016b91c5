"""Checks of recommendations and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import clean as c
from plumbline.operators import recommend as rec

from .quality import NUMBER, rounded, scored_sql
from .tables import COLUMNS, is_number, load, with_views

NUMERIC = [n for n, t in COLUMNS["dirty_orders"] if is_number(t)]


def on(table: str, operator, *args, digits: int = 6, **options):
    return lambda spark, sf: rounded(operator(load(spark, sf, table), *args, **options), digits)


def orders(sql: str) -> str:
    return with_views(sql, "dirty_orders")


def events(sql: str) -> str:
    return with_views(sql, "dirty_events")


def customer(sql: str) -> str:
    return with_views(sql, "dirty_customer")


def swap(columns, table: str, new: dict[str, str]) -> str:
    """Select list of a table with some columns replaced, doubles rounded."""
    parts = []
    for n, t in COLUMNS[table]:
        expr = new.get(n, n)
        if n in columns or t == "double":
            expr = f"round({expr}, 6)"
        parts.append(f"{expr} AS {n}")
    return ", ".join(parts)


def fenced_chain(start: str, columns: list[str], keep_null: bool = True) -> tuple[str, str]:
    """CTEs that filter column after column; returns them and the last name."""
    parts, last = [], start
    for i, n in enumerate(columns):
        null = f"{n} IS NULL OR " if keep_null else ""
        parts.append(
            f"s{i} AS (SELECT t.* FROM {last} t, (SELECT quantile_cont(CAST({n} AS DOUBLE), 0.25) AS q1, "
            f"quantile_cont(CAST({n} AS DOUBLE), 0.75) AS q3 FROM {last}) q WHERE q1 IS NULL OR {null}"
            f"{n} >= q1 - 1.5e0 * (q3 - q1) AND {n} <= q3 + 1.5e0 * (q3 - q1))"
        )
        last = f"s{i}"
    return ", ".join(parts), last


def z_chain(start: str, columns: list[str], threshold: str) -> tuple[str, str]:
    parts, last = [], start
    for i, n in enumerate(columns):
        parts.append(
            f"z{i} AS (SELECT t.* FROM {last} t, (SELECT avg(CAST({n} AS DOUBLE)) AS m, stddev_samp({n}) AS s FROM {last}) q "
            f"WHERE {n} IS NULL OR s IS NULL OR s = 0 OR abs(({n} - m) / s) <= {threshold})"
        )
        last = f"z{i}"
    return ", ".join(parts), last


_IQR, _IQR_LAST = fenced_chain("dirty_orders", NUMERIC)
_Z, _Z_LAST = z_chain("dirty_orders", NUMERIC, "1.5e0")

WINDOW = "OVER ({}ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BACK = "OVER ({}ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def carry_sql(window: str, keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return events(
        f"SELECT event_id, ts, user_id, event_type, round(last_value(value IGNORE NULLS) {window.format(part)}, 6) AS value FROM dirty_events"
    )


def interpolate_sql(keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return events(f"""
      WITH p AS (SELECT *, row_number() OVER ({part}ORDER BY ts, event_id) AS i FROM dirty_events),
      q AS (SELECT *, CASE WHEN value IS NOT NULL THEN i END AS vi FROM p),
      n AS (SELECT *, last_value(value IGNORE NULLS) {WINDOW.format(part)} AS v0, last_value(vi IGNORE NULLS) {WINDOW.format(part)} AS i0,
                   last_value(value IGNORE NULLS) {BACK.format(part)} AS v1, last_value(vi IGNORE NULLS) {BACK.format(part)} AS i1 FROM q)
      SELECT event_id, ts, user_id, event_type,
             round(coalesce(value, CASE WHEN i1 > i0 THEN v0 + (v1 - v0) * ((i - i0) * 1e0 / (i1 - i0)) END, v0), 6) AS value FROM n""")


def fill(method: str, keys=None):
    def run(spark, sf):
        return rounded(c.fill_in_order(load(spark, sf, "dirty_events"), method, ["ts", "event_id"], ["value"], keys))

    return run


TARGETS = {
    "price_text": "float", "mixed_text": "float", "date_text": "datetime", "o_totalprice": "int",
    "flag": "category", "o_custkey": "string", "constant": "int",
}


def convert(spark, sf):
    return rounded(c.convert_types(load(spark, sf, "dirty_orders"), TARGETS)[0])


def convert_dates(spark, sf):
    """Order dates written in a dozen ways, day first and month first, read back by the shapes of each column."""
    d = F.col("o_orderdate")
    ways = ("yyyy-MM-dd", "yyyy/MM/dd HH:mm", "dd MMM yyyy", "MMMM d, yyyy", "yyyyMMdd", "EEE, d MMM yyyy HH:mm:ss", "d-MMM-yy", "yyyy-MMM-dd")
    many = F.date_format(d, ways[0])
    for k, way in enumerate(ways):
        many = F.when(F.col("o_orderkey") % 10 == k, F.date_format(d, way)).otherwise(many)
    zoned = F.concat(F.date_format(d - F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-02:00"))
    many = F.when(F.col("o_orderkey") % 10 == 8, zoned).when(F.col("o_orderkey") % 10 == 9, F.lit("30 Feb 2020")).otherwise(many)
    rows = load(spark, sf, "orders").select(
        "o_orderkey", many.alias("many"), F.date_format(d, "d/M/yyyy").alias("day_first"), F.date_format(d, "M/d/yy h:mm a").alias("month_first"),
        F.date_format(d, "dd.MM.yyyy").alias("points"))
    names = ("many", "day_first", "month_first", "points")
    return c.convert_types(rows, dict.fromkeys(names, "datetime"))[0]


def convert_log(spark, sf):
    return c.convert_types(load(spark, sf, "dirty_orders"), TARGETS)[1].drop("error")


def clean_numbers(df):
    return c.remove_outliers(c.drop_nulls(df, "threshold", 0.5), "iqr", ["o_totalprice"])


def summary(spark, sf):
    df = load(spark, sf, "dirty_orders")
    return c.cleaning_summary(df, c.drop_duplicates(c.drop_nulls(df, "threshold", 0.5)))


PIPELINE = {
    "drop_nulls": {"method": "threshold", "threshold": 0.5},
    "drop_duplicates": {},
    "fill_missing": {"method": "median", "columns": ["o_totalprice"]},
    "remove_outliers": {"method": "iqr", "columns": ["o_totalprice"]},
    "standardize": {"method": "zscore", "columns": ["o_totalprice"]},
}


def pipeline(spark, sf):
    return rounded(c.clean_pipeline(load(spark, sf, "dirty_orders"), PIPELINE).df)


def pipeline_log(spark, sf):
    log = c.clean_pipeline(load(spark, sf, "dirty_orders"), PIPELINE).log()
    return log.drop("details")


DENSE = [(n, t) for n, t in COLUMNS["dirty_orders"] if n != "sparse"]
DENSE_LIST = ", ".join(n for n, _ in DENSE)
PIPE = f"""
  WITH a AS (SELECT {DENSE_LIST} FROM dirty_orders), b AS (SELECT DISTINCT * FROM a),
  f AS (SELECT * REPLACE (coalesce(o_totalprice, (SELECT median(o_totalprice) FROM b)) AS o_totalprice) FROM b),
  o AS (SELECT f.* FROM f, (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM f) q
        WHERE o_totalprice BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1))"""


def export_rows(spark, sf):
    return rounded(c.clean_for_export(load(spark, sf, "dirty_orders")))


def export_report(spark, sf):
    tables = {t: load(spark, sf, t) for t in ("dirty_orders", "dirty_customer", "part")}
    return c.export_report({t: (df, c.clean_for_export(df)) for t, df in tables.items()})


def _export_sql() -> tuple[str, str]:
    chain, last = fenced_chain("uniq", NUMERIC, keep_null=False)
    epoch = "CAST(epoch(o_orderdate) AS BIGINT) AS o_orderdate_timestamp, CAST(epoch(CAST(date_text AS TIMESTAMP)) AS BIGINT) AS date_text_timestamp"
    rows = orders(
        f"WITH uniq AS (SELECT DISTINCT * FROM dirty_orders), {chain} SELECT {swap([], 'dirty_orders', {'date_text': 'CAST(date_text AS TIMESTAMP)'})}, {epoch} FROM {last}"
    )
    parts = []
    for t in ("dirty_orders", "dirty_customer", "part"):
        names = [n for n, k in COLUMNS[t] if is_number(k)]
        sub, end = fenced_chain("uniq", names, keep_null=False)
        parts.append(
            f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS original_records, "
            f"(WITH uniq AS (SELECT DISTINCT * FROM {t}), {sub} SELECT count(*) FROM {end}) AS cleaned_records"
        )
    report = with_views(
        f"""SELECT *, original_records - cleaned_records AS removed_records,
            round(1e2 * (original_records - cleaned_records) / original_records, 2) AS cleaning_efficiency FROM ({' UNION ALL '.join(parts)}) x""",
        "dirty_orders", "dirty_customer",
    )
    return rows, report


_EXPORT_ROWS, _EXPORT_REPORT = _export_sql()


def flags_sql(chain: str) -> str:
    names = ["o_totalprice", "sparse"]
    if chain == "iqr":
        stats = ", ".join(f"quantile_cont({n}, 0.25) AS a{i}, quantile_cont({n}, 0.75) AS b{i}" for i, n in enumerate(names))
        test = lambda i, n: f"coalesce({n} < a{i} - 1.5e0 * (b{i} - a{i}) OR {n} > b{i} + 1.5e0 * (b{i} - a{i}), false)"
    else:
        stats = ", ".join(f"avg({n}) AS a{i}, stddev_samp({n}) AS b{i}" for i, n in enumerate(names))
        test = lambda i, n: f"coalesce(abs(({n} - a{i}) / b{i}) > 3e0, false)"
    flags = ", ".join(f"{test(i, n)} AS {n}_outlier" for i, n in enumerate(names))
    some = " OR ".join(test(i, n) for i, n in enumerate(names))
    return orders(
        f"SELECT {swap([], 'dirty_orders', {})}, {flags}, {some} AS anomaly FROM dirty_orders, (SELECT {stats} FROM dirty_orders) q"
    )


def preview_sql() -> str:
    parts = []
    for i, (n, t) in enumerate(COLUMNS["dirty_orders"]):
        kind = "numeric" if is_number(t) else "datetime" if t == "timestamp_ntz" else "categorical"
        out, src = "CAST(NULL AS BIGINT)", "dirty_orders"
        if kind == "numeric":
            src = f"dirty_orders, (SELECT quantile_cont(CAST({n} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({n} AS DOUBLE), 0.75) AS q3 FROM dirty_orders) q"
            out = f"count(*) FILTER ({n} < q1 - 1.5e0 * (q3 - q1) OR {n} > q3 + 1.5e0 * (q3 - q1))"
        fill = {"numeric": "'mean|median|interpolate|constant'", "categorical": "'mode|constant|forward_fill|backward_fill'"}.get(kind, "NULL")
        flag = str(kind == "numeric").lower()
        parts.append(
            f"SELECT {i} AS position, '{n}' AS column_name, '{t}' AS data_type, '{kind}' AS class, count(*) - count({n}) AS null_count, "
            f"round(1e2 * (count(*) - count({n})) / count(*), 2) AS null_percentage, {out} AS outliers, "
            f"CASE WHEN count(*) > count({n}) THEN {fill} END AS fill_methods, {flag} AS can_remove_outliers, {flag} AS can_standardize FROM {src}"
        )
    return orders(" UNION ALL ".join(parts))


def suggest(spark, sf):
    got = rec.suggest_types(load(spark, sf, "dirty_orders"), ["o_orderkey"])
    return rounded(got.withColumn("samples", F.array_join("samples", " | ")))


def suggest_sql() -> str:
    samples = " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, string_agg(CAST({n} AS VARCHAR), ' | ' ORDER BY o_orderkey) AS samples FROM (SELECT * FROM dirty_orders WHERE {n} IS NOT NULL ORDER BY o_orderkey LIMIT 3) x"
        for n, _ in COLUMNS["dirty_orders"]
    )
    return orders(f"""
      WITH facts AS ({scored_sql('dirty_orders')}), samples AS ({samples})
      SELECT position, column_name, data_type AS current_type,
             CASE WHEN data_type IN ('int', 'bigint') THEN 'integer' WHEN data_type = 'double' THEN 'decimal'
                  WHEN data_type LIKE 'timestamp%' THEN 'datetime' WHEN unique_count = 2 THEN 'boolean' ELSE 'text' END AS suggested_type,
             round(1e2 * non_null / row_count, 6) AS completeness, round(1e2 * unique_count / row_count, 6) AS uniqueness,
             null_count, unique_count, samples FROM facts JOIN samples USING (column_name)""")


def conversions_sql() -> str:
    parts = []
    for n, t in COLUMNS["dirty_orders"]:
        if t != "string":
            continue
        parts.append(
            f"SELECT '{n}' AS column_name, 'string' AS current, CASE WHEN bool_and(regexp_matches({n}, '{NUMBER}')) THEN 'numeric' "
            f"WHEN bool_and(try_cast({n} AS TIMESTAMP) IS NOT NULL) THEN 'datetime' WHEN count(DISTINCT {n}) < 0.05 * count(*) THEN 'category' END AS suggested FROM dirty_orders"
        )
    return orders(f"""
      SELECT *, CASE suggested WHEN 'numeric' THEN 'Column contains numeric values stored as text' WHEN 'datetime' THEN 'Column contains date/time values'
                ELSE 'Column has few distinct values' END AS reason
      FROM ({' UNION ALL '.join(parts)}) x WHERE suggested IS NOT NULL""")


def ids_sql(table: str) -> str:
    numeric = ", ".join(f"'{n}'" for n, t in COLUMNS[table] if is_number(t))
    return f"""
      SELECT position, column_name, contains(lower(column_name), 'id') OR lower(column_name) IN ('index', 'key', 'pk', 'primary_key') AS by_name,
             (unique_count = non_null AND row_count > 10) OR (column_name IN ({numeric}) AND unique_count = non_null AND non_null > 1
               AND max_value - min_value = non_null - 1) IS TRUE AS by_data
      FROM ({scored_sql(table)}) s"""


def booleans_sql(table: str) -> str:
    words = ", ".join(f"'{w}'" for w in ("true", "false", "True", "False", "TRUE", "FALSE", "1", "0", "yes", "no", "Yes", "No", "YES", "NO"))
    test = lambda n, t: (
        f"bool_and({n} IN (0, 1))" if is_number(t) else f"bool_and({n} IN ({words})) AND count(DISTINCT {n}) <= 2" if t == "string" else f"count({n}) = 0"
    )
    return " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, coalesce({test(n, t)}, true) AS is_boolean FROM {table}" for n, t in COLUMNS[table]
    )


def dates_query(spark, sf):
    df = load(spark, sf, "events").select(
        "event_id", "ts", F.col("ts").cast("date").cast("timestamp_ntz").alias("day_date"))
    return rounded(rec.date_columns_by_variance(df, ["event_id"]), 3)


def strict_ids(spark, sf):
    df = load(spark, sf, "part")
    return rounded(rec.id_columns_strict(df, ["p_partkey"]))


STRICT_SQL = """
  WITH n AS (SELECT *, p_partkey < lag(p_partkey) OVER w AS f0, p_size < lag(p_size) OVER w AS f1, p_retailprice < lag(p_retailprice) OVER w AS f2
             FROM part WINDOW w AS (ORDER BY p_partkey)),
  r AS (SELECT abs(corr(p_partkey, p_size)) AS r01, abs(corr(p_partkey, p_retailprice)) AS r02, abs(corr(p_size, p_retailprice)) AS r12 FROM part)
"""


def strict_sql() -> str:
    part = lambda i, n, a, b: (
        f"SELECT '{n}' AS column_name, {str('id' in n).lower()} AS by_name, count(*) FILTER (f{i}) = 0 AS increasing, "
        f"count(DISTINCT {n}) = count({n}) AS all_differ, bool_and({n} = floor({n})) AS whole_numbers, min({n}) IN (0, 1) AS starts_low, "
        f"round((SELECT ({a} + {b}) / 2 FROM r), 6) AS mean_abs_corr, round((SELECT greatest({a}, {b}) FROM r), 6) AS max_abs_corr, "
        f"count(DISTINCT {n}) = count({n}) AS is_id FROM n"
    )
    body = " UNION ALL ".join([
        part(0, "p_partkey", "r01", "r02"), part(1, "p_size", "r01", "r12"), part(2, "p_retailprice", "r02", "r12")])
    return STRICT_SQL + body


CHECKS = {
    "column_info": (
        on("dirty_orders", rec.column_info),
        orders(f"SELECT position, column_name AS name, data_type AS type, null_count, unique_count FROM ({scored_sql('dirty_orders')}) s"),
    ),
    "suggest_types": (suggest, suggest_sql()),
    "cleaning_preview": (on("dirty_orders", rec.cleaning_preview), preview_sql()),
    "cleaning_preview_table": (
        on("dirty_orders", rec.cleaning_preview_table),
        orders(f"""
          SELECT total_rows, 11 AS total_columns, 6 AS numeric_columns, 4 AS categorical_columns, 1 AS datetime_columns, null_cells, duplicate_rows,
                 round(1e2 * duplicate_rows / total_rows, 2) AS duplicate_percentage, 'threshold' AS drop_nulls_recommendation, true AS drop_duplicates_recommended
          FROM (SELECT count(*) AS total_rows, 2 * count(*) - count(o_totalprice) - count(sparse) AS null_cells,
                       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS duplicate_rows FROM dirty_orders) x"""),
    ),
    "type_conversion_suggestions": (on("dirty_orders", rec.type_conversion_suggestions), conversions_sql()),
    "duplicate_count": (
        on("dirty_customer", rec.duplicate_count),
        customer("""SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_customer)) AS distinct_rows,
                    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_customer)) AS duplicate_rows FROM dirty_customer"""),
    ),
    "is_boolean_column": (on("dirty_orders", rec.boolean_columns), orders(booleans_sql("dirty_orders"))),
    "is_id_column": (
        on("orders", rec.id_columns),
        f"SELECT *, by_name OR by_data AS is_id FROM ({ids_sql('orders')}) x",
    ),
    "id_column_strict": (strict_ids, strict_sql()),
    "numeric_columns": (
        on("dirty_orders", rec.numeric_columns),
        orders(f"""WITH i AS ({ids_sql('dirty_orders')}), b AS ({booleans_sql('dirty_orders')}),
          n AS (SELECT row_number() OVER (ORDER BY position) - 1 AS np, * FROM i WHERE column_name IN ({', '.join(f"'{n}'" for n in NUMERIC)}))
          SELECT CAST(np AS INTEGER) AS position, column_name FROM n JOIN b USING (column_name) WHERE NOT (by_name OR by_data) AND NOT is_boolean"""),
    ),
    "date_column_by_variance": (
        dates_query,
        """WITH s AS (SELECT epoch(ts) - lag(epoch(ts)) OVER w AS a,
                             epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) - lag(epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP))) OVER w AS b
                      FROM events WINDOW w AS (ORDER BY event_id)),
           v AS (SELECT var_samp(a) AS va, var_samp(b) AS vb FROM s)
           SELECT 'ts' AS column_name, round(va, 3) AS variance, va >= vb AS chosen FROM v UNION ALL SELECT 'day_date', round(vb, 3), vb > va FROM v""",
    ),
    "drop_nulls_any": (
        on("dirty_customer", c.drop_nulls, "any"),
        customer("SELECT * FROM dirty_customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL"),
    ),
    "drop_nulls_all": (
        lambda spark, sf: c.drop_nulls(load(spark, sf, "dirty_customer").select("c_acctbal", "c_mktsegment"), "all"),
        customer("SELECT c_acctbal, c_mktsegment FROM dirty_customer WHERE c_acctbal IS NOT NULL OR c_mktsegment IS NOT NULL"),
    ),
    "drop_nulls_threshold": (
        lambda spark, sf: c.drop_nulls(load(spark, sf, "dirty_orders").select("o_orderkey", "o_totalprice", "sparse", "flag"), "threshold", 0.3),
        orders("SELECT o_orderkey, o_totalprice, flag FROM dirty_orders WHERE CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END <= 0.3 * 3"),
    ),
    "drop_duplicates_first": (
        on("dirty_orders", c.drop_duplicates, ["o_custkey", "o_orderstatus"], "first", ["o_orderkey"]),
        orders(f"SELECT {swap([], 'dirty_orders', {})} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM dirty_orders) x WHERE rn = 1"),
    ),
    "drop_duplicates_last": (
        on("dirty_orders", c.drop_duplicates, ["o_custkey", "o_orderstatus"], "last", ["o_orderkey"]),
        orders(f"SELECT {swap([], 'dirty_orders', {})} FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS rn FROM dirty_orders) x WHERE rn = 1"),
    ),
    "drop_duplicates_none": (
        on("dirty_orders", c.drop_duplicates, ["o_custkey", "o_orderstatus"], None),
        orders(f"SELECT {swap([], 'dirty_orders', {})} FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM dirty_orders) x WHERE n = 1"),
    ),
    "fill_mean": (
        on("dirty_orders", c.fill_mean, ["o_totalprice", "sparse"]),
        orders(f"SELECT {swap([], 'dirty_orders', {n: f'coalesce({n}, (SELECT avg({n}) FROM dirty_orders))' for n in ('o_totalprice', 'sparse')})} FROM dirty_orders"),
    ),
    "fill_median": (
        on("dirty_orders", c.fill_median, ["o_totalprice", "sparse"]),
        orders(f"SELECT {swap([], 'dirty_orders', {n: f'coalesce({n}, (SELECT median({n}) FROM dirty_orders))' for n in ('o_totalprice', 'sparse')})} FROM dirty_orders"),
    ),
    "fill_mode": (
        on("dirty_customer", c.fill_mode),
        customer(f"SELECT {swap([], 'dirty_customer', {n: f'coalesce({n}, (SELECT {n} FROM dirty_customer WHERE {n} IS NOT NULL GROUP BY {n} ORDER BY count(*) DESC, {n} LIMIT 1))' for n in ('c_acctbal', 'c_mktsegment')})} FROM dirty_customer"),
    ),
    "fill_constant": (
        on("dirty_customer", c.fill_constant),
        customer("SELECT c_custkey, c_name, c_nationkey, coalesce(c_acctbal, 0e0) AS c_acctbal, coalesce(c_mktsegment, 'Unknown') AS c_mktsegment FROM dirty_customer"),
    ),
    "fill_forward": (fill("forward", ["user_id"]), carry_sql(WINDOW, "user_id")),
    "fill_backward": (fill("backward", ["user_id"]), carry_sql(BACK, "user_id")),
    "fill_interpolate": (fill("interpolate", ["user_id"]), interpolate_sql("user_id")),
    "fill_forward_keyless": (fill("forward"), carry_sql(WINDOW, "")),
    "fill_backward_keyless": (fill("backward"), carry_sql(BACK, "")),
    "fill_interpolate_keyless": (fill("interpolate"), interpolate_sql("")),
    "remove_outliers_iqr": (
        on("dirty_orders", c.remove_outliers, "iqr"),
        orders(f"WITH {_IQR} SELECT {swap([], 'dirty_orders', {})} FROM {_IQR_LAST}"),
    ),
    "remove_outliers_iqr_joint": (
        on("dirty_orders", c.remove_outliers, "iqr", ["o_totalprice", "sparse"], mode="joint"),
        orders(f"""SELECT {swap([], 'dirty_orders', {})} FROM dirty_orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b,
                   quantile_cont(sparse, 0.25) AS d, quantile_cont(sparse, 0.75) AS e FROM dirty_orders) q
                   WHERE (o_totalprice IS NULL OR o_totalprice BETWEEN a - 1.5e0 * (b - a) AND b + 1.5e0 * (b - a))
                     AND (sparse IS NULL OR sparse BETWEEN d - 1.5e0 * (e - d) AND e + 1.5e0 * (e - d))"""),
    ),
    "remove_outliers_zscore": (
        on("dirty_orders", c.remove_outliers, "zscore"),
        orders(f"WITH {_Z} SELECT {swap([], 'dirty_orders', {})} FROM {_Z_LAST}"),
    ),
    "standardize_zscore": (
        on("dirty_orders", c.standardize, "zscore", ["o_totalprice", "sparse", "constant"]),
        orders(f"SELECT {swap([], 'dirty_orders', {n: f'({n} - (SELECT avg({n}) FROM dirty_orders)) / (SELECT stddev_samp({n}) FROM dirty_orders)' for n in ('o_totalprice', 'sparse')})} FROM dirty_orders"),
    ),
    "standardize_minmax": (
        on("dirty_orders", c.standardize, "minmax", ["o_totalprice", "sparse", "constant"]),
        orders(f"SELECT {swap([], 'dirty_orders', {n: f'({n} - (SELECT min({n}) FROM dirty_orders)) / (SELECT max({n}) - min({n}) FROM dirty_orders)' for n in ('o_totalprice', 'sparse')})} FROM dirty_orders"),
    ),
    "convert_types": (
        convert,
        orders("""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderdate,
                  round(CAST(price_text AS DOUBLE), 6) AS price_text, round(try_cast(mixed_text AS DOUBLE), 6) AS mixed_text,
                  CAST(date_text AS TIMESTAMP) AS date_text, round(sparse, 6) AS sparse, CAST(flag AS VARCHAR) AS flag, CAST(constant AS BIGINT) AS constant
                  FROM dirty_orders"""),
    ),
    "convert_types_dates": (
        convert_dates,
        """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders)
           SELECT o_orderkey, CASE o_orderkey % 10 WHEN 9 THEN NULL WHEN 1 THEN date_trunc('minute', d) WHEN 5 THEN date_trunc('second', d)
                    WHEN 8 THEN date_trunc('second', d) ELSE date_trunc('day', d) END AS many,
                  date_trunc('day', d) AS day_first, date_trunc('minute', d) AS month_first, date_trunc('day', d) AS points FROM o""",
    ),
    "convert_types_log": (
        convert_log,
        orders("""SELECT v.*, CASE column_name WHEN 'mixed_text' THEN (SELECT count(mixed_text) - count(try_cast(mixed_text AS DOUBLE)) FROM dirty_orders) ELSE 0 END AS lost_values
                  FROM (VALUES ('price_text', 'string', 'float', true), ('mixed_text', 'string', 'float', true), ('date_text', 'string', 'datetime', true),
                  ('flag', 'int', 'category', true), ('o_custkey', 'bigint', 'string', true), ('constant', 'int', 'int', true)) v(column_name, from_type, to_type, success)
                  UNION ALL SELECT 'o_totalprice', 'double', 'int', count(*) FILTER (o_totalprice <> floor(o_totalprice)) = 0, 0 FROM dirty_orders"""),
    ),
    "cleaning_summary": (
        summary,
        orders(f"""
          WITH f AS (SELECT DISTINCT {DENSE_LIST} FROM dirty_orders),
          a AS (SELECT count(*) AS original_rows, 11 AS original_columns, 2 * count(*) - count(o_totalprice) - count(sparse) AS original_nulls,
                       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS original_duplicates FROM dirty_orders),
          b AS (SELECT count(*) AS final_rows, 10 AS final_columns, count(*) - count(o_totalprice) AS final_nulls, CAST(0 AS BIGINT) AS final_duplicates FROM f)
          SELECT *, original_rows - final_rows AS rows_removed, original_columns - final_columns AS columns_removed,
                 original_nulls - final_nulls AS nulls_removed, original_duplicates - final_duplicates AS duplicates_removed FROM a, b"""),
    ),
    "clean_pipeline": (
        pipeline,
        orders(f"""{PIPE} SELECT {', '.join('round((o_totalprice - m) / s, 6) AS o_totalprice' if n == 'o_totalprice' else n for n, _ in DENSE)}
                  FROM o, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM o) z"""),
    ),
    "cleaning_log": (
        pipeline_log,
        orders(f"""{PIPE},
          n AS (SELECT (SELECT count(*) FROM dirty_orders) AS n0, (SELECT count(*) FROM b) AS n1, (SELECT count(*) FROM o) AS n2)
          SELECT 0 AS step, 'drop_nulls' AS action, n0 AS rows_before, n0 AS rows_after, 11 AS cols_before, 10 AS cols_after FROM n
          UNION ALL SELECT 1, 'drop_duplicates', n0, n1, 10, 10 FROM n UNION ALL SELECT 2, 'fill_missing', n1, n1, 10, 10 FROM n
          UNION ALL SELECT 3, 'remove_outliers', n1, n2, 10, 10 FROM n UNION ALL SELECT 4, 'standardize', n2, n2, 10, 10 FROM n"""),
    ),
    "clean_frame": (
        on("dirty_orders", c.clean_frame),
        orders(f"""SELECT DISTINCT {', '.join('CAST(date_text AS TIMESTAMP) AS date_text' if n == 'date_text' else f'round({n}, 6) AS {n}' if t == 'double' else n for n, t in DENSE)},
                   CAST(epoch(o_orderdate) AS BIGINT) AS o_orderdate_timestamp, CAST(epoch(CAST(date_text AS TIMESTAMP)) AS BIGINT) AS date_text_timestamp FROM dirty_orders"""),
    ),
    "clean_and_export": (export_report, _EXPORT_REPORT),
    "clean_and_export_rows": (export_rows, _EXPORT_ROWS),
    "iqr_anomalies": (on("dirty_orders", c.flag_outliers, "iqr", ["o_totalprice", "sparse"]), flags_sql("iqr")),
    "zscore_anomalies": (on("dirty_orders", c.flag_outliers, "zscore", ["o_totalprice", "sparse"], 3.0), flags_sql("z")),
}
