"""Test tables: the given parquet files and views with planted defects.

The views are written once, as SQL that Spark and DuckDB both read, so that both
sides of a check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

RELATIONAL = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")

# Columns as (name, Spark type) in schema order.
COLUMNS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "supplier": [
        ("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double"),
    ],
    "customer": [
        ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
        ("c_acctbal", "double"), ("c_mktsegment", "string"),
    ],
    "part": [
        ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
        ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double"),
    ],
    "orders": [
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
        ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
    ],
    "lineitem": [
        ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
        ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
        ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
        ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
    ],
    "events": [
        ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
        ("event_type", "string"), ("value", "double"), ("props", "string"),
    ],
    "documents": [
        ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
        ("n_chars", "bigint"),
    ],
    "dirty_customer": [
        ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
        ("c_acctbal", "double"), ("c_mktsegment", "string"),
    ],
    "dirty_orders": [
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
        ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("price_text", "string"),
        ("mixed_text", "string"), ("date_text", "string"), ("sparse", "double"),
        ("flag", "int"), ("constant", "int"),
    ],
    "dirty_events": [
        ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
        ("event_type", "string"), ("value", "double"),
    ],
    "daily_orders": [
        ("d", "timestamp_ntz"), ("n_orders", "bigint"), ("total_price", "double"), ("avg_price", "double"),
    ],
    "order_series": [("order_date", "string"), ("n_orders", "bigint"), ("total_price", "double")],
    "price_series": [("d", "timestamp_ntz"), ("total_price", "double"), ("avg_price", "double")],
    "daily_events": [
        ("d", "timestamp_ntz"), ("n_events", "bigint"), ("sum_value", "double"), ("n_users", "bigint"),
    ],
}

# Daily sums are taken in whole cents, so that no order of additions shows.
# View name -> (base table, SQL body).  {src} is the base table, {ntz} the name
# of the timestamp type without zone, {dayno} the number of a day.
VIEWS = {
    "dirty_customer": (
        "customer",
        """
        WITH d AS (
          SELECT c_custkey, c_name, c_nationkey,
                 CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal,
                 CASE WHEN c_custkey % 11 = 0 THEN NULL
                      WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment)
                      WHEN c_custkey % 3 = 2 THEN concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2)))
                      ELSE c_mktsegment END AS c_mktsegment
          FROM {src})
        SELECT * FROM d UNION ALL SELECT * FROM d WHERE c_custkey % 50 = 0
        """,
    ),
    "dirty_orders": (
        "orders",
        """
        WITH d AS (
          SELECT o_orderkey, o_custkey, o_orderstatus,
                 CASE WHEN o_orderkey % 9 = 0 THEN NULL
                      WHEN o_orderkey % 97 = 0 THEN o_totalprice * 100
                      ELSE o_totalprice END AS o_totalprice,
                 o_orderdate,
                 CAST(o_totalprice AS string) AS price_text,
                 CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS string) END AS mixed_text,
                 CAST(CAST(o_orderdate AS date) AS string) AS date_text,
                 CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS sparse,
                 CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS flag,
                 1 AS constant
          FROM {src})
        SELECT * FROM d UNION ALL SELECT * FROM d WHERE o_orderkey % 40 = 0
        """,
    ),
    "dirty_events": (
        "events",
        """
        SELECT event_id, ts, user_id, event_type,
               CASE WHEN event_id % 5 IN (0, 1) THEN NULL
                    WHEN event_id % 35 = 2 THEN CAST('NaN' AS double)
                    WHEN event_id % 211 = 0 THEN value * 20
                    ELSE value END AS value
        FROM {src}
        """,
    ),
    "daily_orders": (
        "orders",
        """
        WITH g AS (
          SELECT CAST(CAST(o_orderdate AS date) AS {ntz}) AS d, count(*) AS n_orders,
                 CAST(sum(CAST(round(o_totalprice * 100) AS bigint)) AS double) AS cents
          FROM {src} GROUP BY 1)
        SELECT d, n_orders,
               CASE WHEN {dayno} % 400 = 0 THEN cents * 3 / 100 ELSE cents / 100 END AS total_price,
               cents / (100 * n_orders) AS avg_price
        FROM g
        """,
    ),
    # Days as text, and every row of one day in seven twice.
    "order_series": (
        "daily_orders",
        """
        SELECT CAST(CAST(d AS date) AS string) AS order_date, n_orders, total_price FROM {src}
        UNION ALL SELECT CAST(CAST(d AS date) AS string), n_orders, total_price FROM {src} WHERE day(d) % 7 = 0
        """,
    ),
    "price_series": ("daily_orders", "SELECT d, total_price, avg_price FROM {src}"),
    "daily_events": (
        "events",
        """
        SELECT CAST(CAST(ts AS date) AS {ntz}) AS d, count(*) AS n_events,
               round(sum(value), 4) AS sum_value, count(DISTINCT user_id) AS n_users
        FROM {src} GROUP BY 1
        """,
    ),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over one."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base, body = VIEWS[name]
    text = body.format(src="{src}", ntz="timestamp_ntz", dayno="unix_date(CAST(d AS date))")
    return spark.sql(text, src=load(spark, sf_dir, base))


def view_sql(name: str) -> str:
    """The same view as a DuckDB common table expression, NaN already null."""
    base, body = VIEWS[name]
    text = body.format(src=base, ntz="timestamp", dayno="date_diff('day', DATE '1970-01-01', CAST(d AS date))")
    text = text.replace("CAST('NaN' AS double)", "NULL")
    return f"{name} AS ({text})"


def with_views(sql: str, *names: str) -> str:
    """Put the named views in front of a query that reads them."""
    if not names:
        return sql
    head = ", ".join(view_sql(n) for n in names)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"


def is_number(spark_type: str) -> bool:
    return spark_type in ("int", "bigint", "double")
