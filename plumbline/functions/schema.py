"""Column classes: which columns are numeric, text, date-like or nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def is_numeric(dt: T.DataType) -> bool:
    """Integers, floats and decimals; booleans are a class of their own."""
    return isinstance(dt, T.NumericType)


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, T.IntegralType)


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.CharType, T.VarcharType))


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_boolean(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def is_nested(dt: T.DataType) -> bool:
    """Types that only get completeness, never value statistics."""
    return isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def text_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def datetime_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_datetime(f.dataType)]


def type_class(dt: T.DataType) -> str:
    if is_numeric(dt):
        return "numeric"
    if is_datetime(dt):
        return "datetime"
    if is_text(dt) or is_boolean(dt):
        return "categorical"
    return "nested"


def sql_name(name: str) -> str:
    """A column name in SQL text, dots and spaces allowed."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """A string literal in SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> Column:
    """Column reference that also works for names with dots and spaces."""
    return F.col(sql_name(name))


def normalize(df: DataFrame) -> DataFrame:
    """NaN means null everywhere in this library: map it once, on entry."""
    if not any(is_floating(f.dataType) for f in df.schema):
        return df
    return df.select(
        *[
            F.when(~F.isnan(quoted(f.name)), quoted(f.name)).alias(f.name)
            if is_floating(f.dataType)
            else quoted(f.name)
            for f in df.schema
        ]
    )
