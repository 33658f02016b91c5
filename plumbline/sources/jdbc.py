"""Tables of a database over JDBC: partitioned reads and table lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

# URL form, driver class and default port per engine.
ENGINES = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", 5432),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "oracle": ("jdbc:oracle:thin:@{host}:{port}/{database}", "oracle.jdbc.OracleDriver", 1521),
    "sqlite": ("jdbc:sqlite:{database}", "org.sqlite.JDBC", None),
}

# Query for the names of the user's tables per engine.
TABLE_LISTS = {
    "postgresql": "SELECT table_name FROM information_schema.tables WHERE table_schema = 'public'",
    "mysql": "SELECT table_name FROM information_schema.tables WHERE table_schema = DATABASE()",
    "sqlserver": "SELECT table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE'",
    "oracle": "SELECT table_name FROM user_tables",
    "sqlite": "SELECT name AS table_name FROM sqlite_master WHERE type = 'table'",
}


@dataclass(frozen=True)
class Database:
    engine: str
    database: str
    host: str = "localhost"
    port: int | None = None
    user: str | None = None
    password: str | None = None

    @property
    def url(self) -> str:
        form, _, port = ENGINES[self.engine]
        return form.format(host=self.host, port=self.port or port, database=self.database)

    def options(self) -> dict[str, str]:
        found = {"url": self.url, "driver": ENGINES[self.engine][1]}
        if self.user:
            found["user"] = self.user
        if self.password:
            found["password"] = self.password
        return found


def partition_options(column: str, lower, upper, partitions: int) -> dict[str, str]:
    """Split a read on a numeric or date column; no row is left out by the bounds."""
    return {
        "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions),
    }


def read_table(
    spark: SparkSession,
    database: Database,
    table: str,
    partition_column: str | None = None,
    partitions: int = 64,
    fetch_size: int = 10_000,
    limit: int | None = None,
) -> DataFrame:
    """One table, in parallel when a column to split on is named.

    The bounds of that column are asked from the database first.  Filters,
    columns and the limit are pushed down.
    """
    base = spark.read.format("jdbc").options(**database.options()).option("fetchsize", fetch_size)
    if partition_column:
        query = f"(SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {table}) b"
        lo, hi = base.option("dbtable", query).load().first()
        if lo is not None:
            base = base.options(**partition_options(partition_column, lo, hi, partitions))
    df = base.option("dbtable", table).load()
    return df.limit(limit) if limit is not None else df


def list_tables(spark: SparkSession, database: Database) -> DataFrame:
    reader = spark.read.format("jdbc").options(**database.options())
    names = reader.option("dbtable", f"({TABLE_LISTS[database.engine]}) t").load()
    return names.select(F.col(names.columns[0]).alias("table_name"))


def dataset(spark: SparkSession, database: Database, **options) -> dict[str, DataFrame]:
    """All tables by name, as the dataset operators take them."""
    names = [r.table_name for r in list_tables(spark, database).collect()]
    return {name: read_table(spark, database, name, **options) for name in names}
