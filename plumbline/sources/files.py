"""Delimited files: read with types, find the delimiter, write."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.schema import is_boolean, is_datetime, is_integral, is_text, quoted, sql_name
from ..functions.dates import Reading, parse_timestamp, read_shapes
from ..functions.values import NA_TOKENS, NUMBER_PATTERN, blank_to_null, parse_number
from .records import ends_inside, find_breaks, header, records

# Delimiters that are tried, in this order.
DELIMITERS = (",", ";", "\t", "|", ":")
SNIFFED_LINES = 50
_NULL_CELL = "\ue000null\ue000"
_QUOTED = re.compile(r'"(?:[^"]|"")*"')
_WHOLE = r"^\s*[+-]?\d{1,18}\s*$"


def sniff_delimiter(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The delimiter that occurs equally often, outside quotes, in each of the first records.

    Reads a bounded head of the file; falls back to a comma.
    """
    head = [r.value for r in spark.read.option("encoding", encoding).text(path).limit(SNIFFED_LINES).collect()]
    for sep in DELIMITERS:
        records, inside = [], False
        for line in head:
            if inside:
                records[-1] += "\n" + line
            elif line.strip():
                records.append(line)
            inside = ends_inside(line, inside, sep)[0]
        whole = records[:-1] if inside else records
        counts = {_QUOTED.sub("", record).count(sep) for record in whole}
        if len(counts) == 1 and counts != {0}:
            return sep
    return ","


def _typed(c: Column, dt: T.DataType, reading: Reading) -> Column:
    if is_text(dt):
        return c
    if isinstance(dt, T.TimestampNTZType):
        return parse_timestamp(c, reading)
    if is_datetime(dt):
        return F.coalesce(F.trim(c).try_cast(dt), parse_timestamp(c, reading).cast(dt))
    if is_boolean(dt):
        return F.trim(c).try_cast("boolean")
    return F.trim(c).try_cast(dt) if is_integral(dt) else parse_number(c).try_cast(dt)


def infer_types(text: DataFrame, dates: bool = False) -> T.StructType:
    """A type for every column of text: whole numbers, numbers, booleans, text.

    One aggregation over the file.  Nulls do not decide; a column without any
    value is a column of numbers, and dates stay text unless asked for.
    """
    tests = []
    for i, c in enumerate(text.columns):
        name = sql_name(c)
        tests += [
            F.expr(f"bool_and({name} RLIKE r'{_WHOLE}') AS w{i}"),
            F.expr(f"bool_and({name} RLIKE r'{NUMBER_PATTERN}') AS n{i}"),
            F.expr(f"bool_and(trim({name}) IN ('True', 'False', 'true', 'false', 'TRUE', 'FALSE')) AS b{i}"),
            F.expr(f"count({name}) AS p{i}"),
        ]
        if dates:
            tests.append(F.count(parse_timestamp(quoted(c))).alias(f"d{i}"))
    row = text.agg(F.expr("count(1) AS n"), *tests).first()
    if row.n == 0:
        raise ValueError("the file has no rows")
    fields = []
    for i, c in enumerate(text.columns):
        present = row[f"p{i}"]
        if row[f"w{i}"] and present == row.n:
            dt = T.LongType()
        elif row[f"n{i}"] or not present:
            dt = T.DoubleType()
        elif row[f"b{i}"] and present == row.n:
            dt = T.BooleanType()
        elif dates and row[f"d{i}"] == present:
            dt = T.TimestampNTZType()
        else:
            dt = T.StringType()
        fields.append(T.StructField(c, dt))
    return T.StructType(fields)


def _text_cells(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    """Every cell as text. Files without line breaks in cells go to Spark's reader, others are cut into records first."""
    # Only a cell without any character is null to the reader; a quoted empty one is empty text.
    options = {"sep": sep, "escape": '"', "encoding": encoding, "nullValue": _NULL_CELL, "emptyValue": ""}
    breaks = find_breaks(spark, path, sep, encoding)
    if not breaks.any:
        return spark.read.options(header=True, **options).csv(path)
    found = records(spark, path, breaks, sep, encoding)
    names = header(found, sep)
    schema = ", ".join(f"{sql_name(n)} string" for n in names)
    cells = F.from_csv("record", schema, {**options, "multiLine": "true"})
    return found.where(~F.col("first")).select(cells.alias("r")).select(*[F.col(f"r.{sql_name(n)}") for n in names])


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = ",",
    schema: T.StructType | None = None,
    dates: bool = False,
    encoding: str = "UTF-8",
    na_tokens: tuple[str, ...] = NA_TOKENS,
) -> DataFrame:
    """A table from files with a header; missing-value words become null.

    ``sep=None`` looks for the delimiter. Quoted cells may hold line breaks: a first pass over the lines with quotes
    finds those that reach over a line, and no file is read by one task for it. Without a ``schema`` another pass
    decides the types.
    """
    sep = sep or sniff_delimiter(spark, path, encoding)
    text = blank_to_null(_text_cells(spark, path, sep, encoding), na_tokens)
    if not text.columns:
        raise ValueError("the file has no columns")
    readings = {}
    if schema is None:
        schema = infer_types(text, dates)
        # Which of day and month stands first is told by the column's own values.
        readings = read_shapes(text, [f.name for f in schema if is_datetime(f.dataType)])
    return text.select(*[_typed(quoted(f.name), f.dataType, readings.get(f.name, Reading())).alias(f.name) for f in schema])


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "error") -> str:
    """Write files with a header, one per partition; text keeps its line breaks, quotes and outer spaces."""
    writer = df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)
    return path
