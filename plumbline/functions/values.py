"""Scalar expressions on values: number text, finite numbers, text keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .schema import is_floating, is_text, quoted

# Text that stands for a missing value in delimited files.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Spellings that count as boolean.
BOOLEAN_WORDS = (
    "true", "false", "True", "False", "TRUE", "FALSE", "1", "0",
    "yes", "no", "Yes", "No", "YES", "NO",
)

NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

# Text up to this many bytes is compared as it is, longer text by its digest.
DIGEST_ABOVE_BYTES = 64


def is_number_text(c: Column) -> Column:
    return c.rlike(NUMBER_PATTERN)


def parse_number(c: Column) -> Column:
    """Text to double; anything that is not a number becomes null."""
    return F.when(is_number_text(c), F.trim(c).try_cast("double"))


def finite(c: Column, legacy: bool = False) -> Column:
    """NaN and infinities become null, or 0.0 in the legacy form."""
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    if legacy:
        return F.when(c.isNull() | bad, F.lit(0.0)).otherwise(c)
    return F.when(~bad, c)


def json_safe(df: DataFrame, legacy: bool = False) -> DataFrame:
    """Every floating column made safe to serialise as JSON numbers."""
    return df.select(
        *[
            finite(quoted(f.name), legacy).alias(f.name)
            if is_floating(f.dataType)
            else quoted(f.name)
            for f in df.schema
        ]
    )


def blank_to_null(df: DataFrame, tokens: tuple[str, ...] = NA_TOKENS) -> DataFrame:
    """Missing-value words in text columns become null."""
    return df.select(
        *[
            F.when(~F.trim(quoted(f.name)).isin(*tokens), quoted(f.name)).alias(f.name)
            if is_text(f.dataType)
            else quoted(f.name)
            for f in df.schema
        ]
    )


def text_key(c: Column) -> Column:
    """A short stand-in for text in grouping keys.

    Long text is replaced by its SHA-256 and length, so that grouping on a
    column of documents shuffles some 70 bytes per value and not the document.
    A stand-in is always longer than the text that is kept as it is, so the two
    can never be equal.
    """
    digest = F.concat_ws(":", F.sha2(c, 256), F.length(c).cast("string"))
    return F.when(F.octet_length(c) > DIGEST_ABOVE_BYTES, digest).otherwise(c)


def row_keys(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Grouping keys that are equal exactly when the named columns are equal."""
    wanted = set(columns) if columns is not None else set(df.columns)
    return [
        (text_key(quoted(f.name)) if is_text(f.dataType) else quoted(f.name)).alias(f"_k{i}")
        for i, f in enumerate(df.schema)
        if f.name in wanted
    ]


def correlation(a: Column, b: Column) -> Column:
    """Correlation over rows where both are present; null where one is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
