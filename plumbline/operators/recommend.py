"""What a table looks like and which cleaning steps would help it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import names as rules
from ..functions.schema import (
    datetime_names, is_boolean, is_datetime, is_integral, is_numeric, is_text, normalize, numeric_names,
    quoted, text_names, type_class,
)
from ..functions.dates import epoch_micros, parse_timestamp, read_shapes
from ..functions.values import BOOLEAN_WORDS, is_number_text
from ..plans.ordered import ordered, slide
from ..plans.profile import column_profile, measured, row_repeats
from ..plans.sums import pair_correlations
from .rows import sample_values


def column_info(df: DataFrame) -> DataFrame:
    return column_profile(normalize(df)).select(
        "position", F.col("column_name").alias("name"), F.col("data_type").alias("type"), "null_count", "unique_count"
    )


def suggest_types(df: DataFrame, order_by: list[str]) -> DataFrame:
    """A plain type name per column, with completeness, uniqueness and samples."""
    df = normalize(df)
    groups = {"integer": is_integral, "decimal": lambda t: is_numeric(t) and not is_integral(t), "datetime": is_datetime}
    suggested = F.when(F.col("unique_count") == 2, "boolean").otherwise("text")
    for name, test in groups.items():
        members = [f.name for f in df.schema if test(f.dataType)]
        suggested = F.when(F.col("column_name").isin(members), name).otherwise(suggested)
    facts = column_profile(df).select(
        "position", "column_name", F.col("data_type").alias("current_type"), suggested.alias("suggested_type"),
        F.try_divide(F.col("non_null") * 100.0, F.col("row_count")).alias("completeness"),
        F.try_divide(F.col("unique_count") * 100.0, F.col("row_count")).alias("uniqueness"),
        "null_count", "unique_count",
    )
    return facts.join(F.broadcast(sample_values(df, order_by).select("position", "samples")), "position")


def duplicate_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return row_repeats(normalize(df), columns)


def cleaning_preview(df: DataFrame, preview_columns: int | None = None) -> DataFrame:
    """Per column: class, nulls, outliers of numeric ones (all, or the first ``preview_columns``), usable steps."""
    df = normalize(df)
    numeric = numeric_names(df)
    previewed = numeric[:preview_columns]
    facts, _ = measured(df, keep_flat=True, columns=previewed)
    beyond = {r.column_name: r.outliers for r in facts.collect()}  # one row a column
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(quoted(f.name).isNull()).alias(f"n{i}") for i, f in enumerate(df.schema)],
    )
    parts = []
    for i, f in enumerate(df.schema):
        kind = type_class(f.dataType)
        nulls = F.col(f"n{i}")
        outliers = F.lit(beyond.get(f.name)).cast("long")
        fill = {"numeric": "mean|median|interpolate|constant", "categorical": "mode|constant|forward_fill|backward_fill"}
        parts.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(kind).alias("class"),
                nulls.alias("null_count"),
                F.round(F.try_divide(nulls * 100.0, F.col("rows")), 2).alias("null_percentage"),
                outliers.alias("outliers"),
                F.when(nulls > 0, F.lit(fill.get(kind))).alias("fill_methods"),
                F.lit(kind == "numeric").alias("can_remove_outliers"),
                F.lit(kind == "numeric").alias("can_standardize"),
            )
        )
    return counts.select(F.inline(F.array(*parts)))


def cleaning_preview_table(df: DataFrame) -> DataFrame:
    """One row: shape, column classes, duplicates, and what is recommended."""
    df = normalize(df)
    kinds = [type_class(f.dataType) for f in df.schema]
    nulls = df.agg(
        sum((F.count_if(quoted(c).isNull()) for c in df.columns), F.lit(0)).alias("null_cells")
    ).select(F.lit(1).alias("j"), "null_cells")
    repeats = row_repeats(df).select(F.lit(1).alias("j"), "row_count", "duplicate_rows")
    return repeats.join(F.broadcast(nulls), "j").select(
        F.col("row_count").alias("total_rows"),
        F.lit(len(kinds)).alias("total_columns"),
        *[F.lit(kinds.count(k)).alias(f"{k}_columns") for k in ("numeric", "categorical", "datetime")],
        "null_cells",
        "duplicate_rows",
        F.round(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("row_count")), 2).alias("duplicate_percentage"),
        F.when(F.col("null_cells") > 0, "threshold").alias("drop_nulls_recommendation"),
        (F.col("duplicate_rows") > 0).alias("drop_duplicates_recommended"),
    )


def type_conversion_suggestions(df: DataFrame, category_below: float = 0.05) -> DataFrame:
    """Text columns that hold numbers, dates, or few enough values for a category."""
    df = normalize(df)
    names = text_names(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, current string, suggested string, reason string")
    readings = read_shapes(df, names)
    tests = df.agg(
        *[F.bool_and(is_number_text(quoted(c))).alias(f"n{i}") for i, c in enumerate(names)],
        *[
            F.count_if(quoted(c).isNotNull() & parse_timestamp(quoted(c), readings[c]).isNull()).alias(f"t{i}")
            for i, c in enumerate(names)
        ],
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.coalesce(F.col(f"n{i}"), F.lit(True)).alias("numbers"),
                        (F.col(f"t{i}") == 0).alias("dates"),
                    )
                    for i, c in enumerate(names)
                ]
            )
        )
    )
    facts = column_profile(df, columns=names).select(
        "column_name", "data_type", F.try_divide(F.col("unique_count"), F.col("row_count")).alias("share")
    )
    reasons = {
        "numeric": "Column contains numeric values stored as text",
        "datetime": "Column contains date/time values",
        "category": "Column has few distinct values",
    }
    suggested = (
        F.when(F.col("numbers"), "numeric").when(F.col("dates"), "datetime").when(F.col("share") < category_below, "category")
    )
    reason = F.create_map(*[x for k, v in reasons.items() for x in (F.lit(k), F.lit(v))])
    return (
        facts.join(F.broadcast(tests), "column_name")
        .select("column_name", F.col("data_type").alias("current"), suggested.alias("suggested"))
        .where("suggested IS NOT NULL")
        .withColumn("reason", F.element_at(reason, F.col("suggested")))
    )


def boolean_columns(df: DataFrame) -> DataFrame:
    """Per column: is it boolean, or at most two values that all mean true or false?"""
    df = normalize(df)
    tests = []
    for i, f in enumerate(df.schema):
        c = quoted(f.name)
        if is_boolean(f.dataType):
            test = F.lit(True)
        elif is_text(f.dataType) or is_numeric(f.dataType):
            ok = c.isin(*BOOLEAN_WORDS) if is_text(f.dataType) else c.isin(0, 1)
            distinct = F.size(F.collect_set(F.when(ok, c)))
            test = F.coalesce(F.bool_and(ok), F.lit(True)) & (distinct <= 2)
        else:
            test = F.count(c) == 0
        tests.append(test.alias(f"b{i}"))
    return df.agg(*tests).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f.name).alias("column_name"), F.col(f"b{i}").alias("is_boolean"))
                    for i, f in enumerate(df.schema)
                ]
            )
        )
    )


def id_columns(df: DataFrame, rule: str = "letters") -> DataFrame:
    """Per column: does its name or its data look like an identifier?

    Data rule: all values differ and there are more than ten rows, or the values
    are consecutive whole numbers.
    """
    df = normalize(df)
    named = [c for c in df.columns if rules.looks_like_id(c, rule)]
    numeric = numeric_names(df)
    present, unique = F.col("non_null"), F.col("unique_count")
    all_differ = F.coalesce(unique == present, F.lit(False))
    consecutive = (
        F.col("column_name").isin(numeric) & all_differ & (present > 1)
        & (F.col("max_value") - F.col("min_value") == present - 1)
    )
    by_name = F.col("column_name").isin(named)
    by_data = (all_differ & (F.col("row_count") > 10)) | consecutive
    return column_profile(df).select(
        "position", "column_name", by_name.alias("by_name"), F.coalesce(by_data, F.lit(False)).alias("by_data"),
        F.coalesce((F.col("row_count") > 0) & (by_name | by_data), F.lit(False)).alias("is_id"),
    )


def numeric_columns(df: DataFrame, rule: str = "letters") -> DataFrame:
    """Names of measures: numeric, not a timestamp, boolean or identifier."""
    numeric = [c for c in numeric_names(df) if not rules.is_timestamp_name(c)]
    measures = df.select(*[quoted(c) for c in numeric])
    ids = id_columns(measures, rule)
    flags = boolean_columns(measures)
    return ids.join(F.broadcast(flags), "column_name").where("NOT is_id AND NOT is_boolean").select("position", "column_name")


def measure_names(df: DataFrame, rule: str = "letters") -> list[str]:
    return [r.column_name for r in numeric_columns(df, rule).orderBy("position").collect()]


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairwise correlation of numeric columns over the rows where both have a value; null where one does not vary."""
    df = normalize(df)
    names = columns or numeric_names(df)
    r = pair_correlations(df, names) if len(names) > 1 else None
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    rows = [(names[i], names[j], None if np.isnan(r[i, j]) else float(r[i, j])) for i, j in pairs]
    return df.sparkSession.createDataFrame(rows, "left_column string, right_column string, r double")


def date_columns_by_variance(df: DataFrame, order_by: list[str], **sizes) -> DataFrame:
    """Variance of the steps, in seconds, of every date column in row order.

    The column with the largest variance is the time axis (``chosen``).
    """
    names = datetime_names(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, variance double, chosen boolean")
    seconds = lambda c: epoch_micros(quoted(c), df.schema[c].dataType) / 1e6
    rows = ordered(df.select(*dict.fromkeys([*order_by, *names])), order_by, **sizes)
    steps = slide(rows, {f"_d{i}": lambda w, c=c: seconds(c) - F.lag(seconds(c)).over(w) for i, c in enumerate(names)}, back=1)
    found = steps.df.agg(*[F.var_samp(f"_d{i}").alias(f"v{i}") for i in range(len(names))])
    best = F.greatest(*[F.col(f"v{i}") for i in range(len(names))]) if len(names) > 1 else F.col("v0")
    flags, taken = [], F.lit(False)
    for i in range(len(names)):
        hit = F.coalesce(F.col(f"v{i}") == best, F.lit(False)) & ~taken
        flags.append(hit)
        taken = taken | hit
    return found.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("variance"), flags[i].alias("chosen"))
                    for i, c in enumerate(names)
                ]
            )
        )
    )


# Key names and the longest name that may hold ``id`` anywhere.
STRICT_KEY_NAMES = ("index", "idx", "key", "pk", "primary_key")
STRICT_NAME_LENGTH = 10


def _strict_name(name: str) -> bool:
    low = name.lower()
    return (
        low == "id" or low.startswith("id_") or low.endswith("id") or low in STRICT_KEY_NAMES
        or ("id" in low and len(low) <= STRICT_NAME_LENGTH)
    )


def id_columns_strict(df: DataFrame, order_by: list[str], **sizes) -> DataFrame:
    """Numeric columns only: name rule, order, uniqueness, whole numbers, correlations."""
    df = normalize(df)
    names = numeric_names(df)
    value = lambda c: quoted(c).cast("double")
    facts = column_profile(df, columns=names)
    rows = ordered(df.select(*dict.fromkeys([*order_by, *names])), order_by, **sizes)
    falls = slide(rows, {f"_f{i}": lambda w, c=c: value(c) < F.lag(value(c)).over(w) for i, c in enumerate(names)}, back=1)
    tests = falls.df.agg(
        *[F.count_if(F.col(f"_f{i}")).alias(f"f{i}") for i in range(len(names))],
        *[F.count_if(value(c) != F.floor(value(c))).alias(f"w{i}") for i, c in enumerate(names)],
    ).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"), (F.col(f"f{i}") == 0).alias("increasing"),
                        (F.col(f"w{i}") == 0).alias("whole_numbers"),
                    )
                    for i, c in enumerate(names)
                ]
            )
        )
    )
    r = correlations(df, names).where("r IS NOT NULL")
    both = r.select(F.col("left_column").alias("column_name"), F.abs("r").alias("r")).union(
        r.select("right_column", F.abs("r"))
    )
    related = both.groupBy("column_name").agg(F.avg("r").alias("mean_abs_corr"), F.max("r").alias("max_abs_corr"))
    unique = F.col("unique_count") == F.col("non_null")
    low = F.col("min_value").isin(0.0, 1.0)
    by_name = F.col("column_name").isin([c for c in names if _strict_name(c)])
    by_data = unique & (F.col("increasing") | (F.col("whole_numbers") & low) | (F.col("row_count") > 10))
    return (
        facts.join(F.broadcast(tests), "column_name")
        .join(F.broadcast(related), "column_name", "left")
        .select(
            "column_name", by_name.alias("by_name"), "increasing", unique.alias("all_differ"), "whole_numbers",
            F.coalesce(low, F.lit(False)).alias("starts_low"), "mean_abs_corr", "max_abs_corr",
            F.coalesce(by_name | by_data, F.lit(False)).alias("is_id"),
        )
    )
