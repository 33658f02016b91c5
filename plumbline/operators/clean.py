"""Cleaning: nulls, duplicates, fills, outliers, scaling, types, and the pipeline."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import epoch_seconds, parse_timestamp, read_shapes
from ..functions.names import is_date_name
from ..functions.schema import (
    is_datetime, is_nested, is_numeric, is_text, normalize, numeric_names, quoted,
)
from ..functions.values import parse_number, row_keys
from ..plans.materialize import materialize
from ..plans.ordered import POSITION, OrderedRows, carry, ordered
from ..plans.profile import iqr_bounds, outside
from ..plans.quantiles import exact_quantiles, union_all

DEFAULT_OUTLIER_FACTOR = 1.5


def _replace(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


# --- nulls and duplicates -------------------------------------------------


def null_ratios(df: DataFrame) -> dict[str, float]:
    """Share of nulls per column; one aggregation, one row to the driver."""
    row = df.agg(
        F.count(F.lit(1)), *[F.count_if(quoted(c).isNull()) for c in df.columns]
    ).first()
    return {c: (row[i + 1] / row[0] if row[0] else 0.0) for i, c in enumerate(df.columns)}


def drop_sparse_columns(df: DataFrame, threshold: float) -> DataFrame:
    ratios = null_ratios(df)
    return df.select(*[quoted(c) for c in df.columns if ratios[c] <= threshold])


def drop_nulls(df: DataFrame, method: str = "any", threshold: float | None = None) -> DataFrame:
    """``any``, ``all``, or ``threshold``: sparse columns first, then sparse rows."""
    df = normalize(df)
    if method in ("any", "all"):
        return df.dropna(method)
    if method != "threshold" or threshold is None:
        raise ValueError("method is any, all, or threshold with a value")
    kept = drop_sparse_columns(df, threshold)
    if not kept.columns:
        return kept
    nulls = sum((quoted(c).isNull().cast("int") for c in kept.columns), F.lit(0))
    return kept.where(nulls / len(kept.columns) <= threshold)


def drop_duplicates(
    df: DataFrame,
    subset: list[str] | None = None,
    keep: str | None = "first",
    order_by: list[str] | None = None,
) -> DataFrame:
    """Keep the first, the last, or none of the rows that agree on ``subset``.

    Copies are folded before the shuffle, so a row that makes up a third of the
    table reaches its task once per input split.
    """
    df = normalize(df)
    if keep is not None and subset is None:
        return df.dropDuplicates()
    if keep is None:
        whole = F.any_value(F.struct(*[quoted(c) for c in df.columns]))
    else:
        if not order_by:
            raise ValueError("first and last need order_by")
        pick = F.min_by if keep == "first" else F.max_by
        order = F.struct(*[quoted(c) for c in order_by])
        whole = pick(F.struct(*[quoted(c) for c in df.columns]), order)
    groups = df.groupBy(*row_keys(df, subset)).agg(whole.alias("_r"), F.count(F.lit(1)).alias("_n"))
    if keep is None:
        groups = groups.where("_n = 1")
    return groups.select("_r.*")


# --- fills ----------------------------------------------------------------


def fill_mean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    df = normalize(df)
    names = columns or numeric_names(df)
    if not names:
        return df
    row = df.agg(*[F.avg(quoted(c)).cast("double") for c in names]).first()
    return _replace(df, {c: F.coalesce(quoted(c), F.lit(row[i])) for i, c in enumerate(names)})


def fill_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    df = normalize(df)
    names = columns or numeric_names(df)
    found = exact_quantiles(df, names, (0.5,))
    return _replace(df, {c: F.coalesce(quoted(c), F.lit(found[c][0])) for c in names})


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value per column, the smallest of equals, as text; null for nested columns."""
    parts = [
        df.where(quoted(c).isNotNull())
        .groupBy(quoted(c).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "v")
        .limit(1)
        .select(F.lit(c).alias("name"), F.col("v").cast("string").alias("value"))
        for c in columns
        if not is_nested(df.schema[c].dataType)
    ]
    found = {r.name: r.value for r in union_all(parts).collect()} if parts else {}
    return {c: found.get(c) for c in columns}


def fill_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    df = normalize(df)
    names = columns or df.columns
    found = modes(df, names)
    return _replace(
        df,
        {c: F.coalesce(quoted(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in found.items() if v is not None},
    )


def fill_constant(df: DataFrame, columns: list[str] | None = None, value=None) -> DataFrame:
    """Zero for numbers and ``Unknown`` for text, or the given value."""
    df = normalize(df)
    new = {}
    for c in columns or df.columns:
        dt = df.schema[c].dataType
        if value is not None:
            new[c] = F.coalesce(quoted(c), F.lit(value).cast(dt))
        elif is_numeric(dt):
            new[c] = F.coalesce(quoted(c), F.lit(0).cast(dt))
        elif is_text(dt):
            new[c] = F.coalesce(quoted(c), F.lit("Unknown"))
    return _replace(df, new)


def fill_ordered(rows: OrderedRows, columns: list[str], method: str) -> OrderedRows:
    """Forward, backward or linear fill of rows that have positions."""
    names = rows.df.columns
    if method in ("forward", "backward"):
        out = carry(rows, {f"_f_{c}": quoted(c) for c in columns}, backward=method == "backward")
        new = {c: F.col(f"`_f_{c}`") for c in columns}
    else:
        point = lambda c: F.when(
            quoted(c).isNotNull(), F.struct(quoted(c).cast("double").alias("v"), F.col(POSITION).alias("p"))
        )
        out = carry(rows, {f"_p_{c}": point(c) for c in columns})
        out = carry(out, {f"_n_{c}": point(c) for c in columns}, backward=True)
        new = {}
        for c in columns:
            before, after = F.col(f"`_p_{c}`"), F.col(f"`_n_{c}`")
            step = (F.col(POSITION) - before["p"]) / (after["p"] - before["p"])
            between = F.when(after["p"] > before["p"], before["v"] + (after["v"] - before["v"]) * step)
            new[c] = F.coalesce(quoted(c).cast("double"), between, before["v"])
    return rows.with_df(out.df.select(*[new[c].alias(c) if c in new else quoted(c) for c in names]))


def fill_in_order(
    df: DataFrame, method: str, order_by: list[str], columns: list[str], keys: list[str] | None = None, **sizes
) -> DataFrame:
    """Fill along ``order_by``, within ``keys`` when given."""
    return fill_ordered(ordered(normalize(df), order_by, keys, **sizes), columns, method).rows()


def fill_missing(
    df: DataFrame,
    method: str,
    columns: list[str] | None = None,
    order_by: list[str] | None = None,
    keys: list[str] | None = None,
    value=None,
) -> DataFrame:
    plain = {"mean": fill_mean, "median": fill_median, "mode": fill_mode}
    if method in plain:
        return plain[method](df, columns)
    if method == "constant":
        return fill_constant(df, columns, value)
    if not order_by:
        raise ValueError(f"{method} needs order_by")
    along = {"forward_fill": "forward", "backward_fill": "backward"}.get(method, method)
    return fill_in_order(df, along, order_by, columns or numeric_names(df), keys)


# --- outliers and scaling -------------------------------------------------


def zscore_limits(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float] | None]:
    """Mean and sample deviation per column; null where there is no spread."""
    row = df.agg(
        *[f(quoted(c).cast("double")) for c in columns for f in (F.avg, F.stddev_samp)]
    ).first()
    pairs = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}
    return {c: (m, s) if s else None for c, (m, s) in pairs.items()}


def _far(c: str, limit: tuple[float, float] | None, threshold: float) -> Column:
    if limit is None:
        return F.lit(False)
    return F.abs((quoted(c).cast("double") - limit[0]) / limit[1]) > threshold


def _outlier(df: DataFrame, names: list[str], method: str, threshold: float) -> dict[str, Column]:
    if method == "iqr":
        fences = iqr_bounds(df, names, threshold, keep_flat=True)
        return {c: outside(quoted(c).cast("double"), fences[c]) for c in names}
    if method == "zscore":
        limits = zscore_limits(df, names)
        return {c: _far(c, limits[c], threshold) for c in names}
    raise ValueError(f"unknown method {method}")


def remove_outliers(
    df: DataFrame,
    method: str = "iqr",
    columns: list[str] | None = None,
    threshold: float = DEFAULT_OUTLIER_FACTOR,
    mode: str = "sequential",
    drop_null: bool = False,
) -> DataFrame:
    """Drop rows with outlying values; a null is kept unless ``drop_null``.

    ``sequential``: limits of a column come from the rows that earlier columns
    left over.  They are numbers in the plan, so each pass is a filtered scan of
    one column and nothing has to be stored between passes.  ``joint``: limits
    of all columns from the whole table, in one pass.
    """
    df = normalize(df)
    names = [c for c in (columns or numeric_names(df)) if c in df.columns and is_numeric(df.schema[c].dataType)]
    keep = lambda bad: ~F.coalesce(bad, F.lit(drop_null))
    if mode == "joint":
        for bad in _outlier(df, names, method, threshold).values():
            df = df.where(keep(bad))
        return df
    for c in names:
        df = df.where(keep(_outlier(df, [c], method, threshold)[c]))
    return df


def flag_outliers(df: DataFrame, method: str, columns: list[str] | None = None, threshold: float | None = None) -> DataFrame:
    """The same rules as flags: ``<column>_outlier`` and ``anomaly``."""
    df = normalize(df)
    names = columns or numeric_names(df)
    limit = threshold if threshold is not None else DEFAULT_OUTLIER_FACTOR
    bad = {c: F.coalesce(x, F.lit(False)) for c, x in _outlier(df, names, method, limit).items()}
    some = F.lit(False)
    for x in bad.values():
        some = some | x
    return df.select("*", *[x.alias(f"{c}_outlier") for c, x in bad.items()], some.alias("anomaly"))


def standardize(df: DataFrame, method: str = "zscore", columns: list[str] | None = None) -> DataFrame:
    df = normalize(df)
    names = columns or numeric_names(df)
    value = lambda c: quoted(c).cast("double")
    if not names:
        return df
    if method == "zscore":
        new = {c: (value(c) - p[0]) / p[1] for c, p in zscore_limits(df, names).items() if p}
    elif method == "minmax":
        row = df.agg(*[f(value(c)) for c in names for f in (F.min, F.max)]).first()
        spans = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(names)}
        new = {c: (value(c) - lo) / (hi - lo) for c, (lo, hi) in spans.items() if lo is not None and hi != lo}
    else:
        raise ValueError(f"unknown method {method}")
    return _replace(df, new)


# --- types ----------------------------------------------------------------


def convert_types(df: DataFrame, targets: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Convert columns; returns the table and one log row per column.

    A column with a fractional number does not become ``int`` and stays as it is; text that does not parse becomes null,
    and ``lost_values`` counts what was there before and is not after. Dates are read as the column's shapes tell.
    """
    df = normalize(df)
    targets = {c: t for c, t in targets.items() if c in df.columns}
    number = {
        c: parse_number(quoted(c)) if is_text(df.schema[c].dataType) else quoted(c).try_cast("double") for c in targets
    }
    readings = read_shapes(df, [c for c, t in targets.items() if t == "datetime" and not is_datetime(df.schema[c].dataType)])
    new = {}
    for c, target in targets.items():
        if target == "int":
            new[c] = number[c].try_cast("long")
        elif target == "float":
            new[c] = number[c]
        elif target in ("string", "category"):
            new[c] = quoted(c).cast("string")
        elif target == "datetime":
            new[c] = parse_timestamp(quoted(c).cast("string"), readings[c]) if c in readings else quoted(c)
    fraction = lambda c: F.count_if(number[c] != F.floor(number[c])) if targets[c] == "int" else F.lit(0)
    lost = lambda c: F.count_if(quoted(c).isNotNull() & new[c].isNull())
    facts = [f(c) for c in new for f in (fraction, lost)]
    row = df.agg(F.count(F.lit(1)), *facts).first()[1:] if facts else ()
    counts = dict(zip(new, zip(row[::2], row[1::2])))
    log = []
    for c, target in targets.items():
        problem = None if c in new else f"unknown type {target}"
        if c in new and counts[c][0]:
            problem = f"{counts[c][0]} values are not whole numbers"
            del new[c]
        gone = counts[c][1] if c in new else 0
        log.append((c, df.schema[c].dataType.simpleString(), target, problem is None, gone, problem))
    schema = "column_name string, from_type string, to_type string, success boolean, lost_values bigint, error string"
    return _replace(df, new), df.sparkSession.createDataFrame(log, schema)


def clean_frame(df: DataFrame, null_threshold: float = 0.5) -> DataFrame:
    """Drop sparse columns and copies, read dates, add their epoch seconds (of wall-clock times as if UTC)."""
    df = drop_sparse_columns(normalize(df), null_threshold).dropDuplicates()
    candidates = [f.name for f in df.schema if is_text(f.dataType) and is_date_name(f.name)]
    if candidates:
        readings = read_shapes(df, candidates)
        read = {c: parse_timestamp(quoted(c), readings[c]) for c in candidates}
        row = df.agg(F.count(F.lit(1)), *[F.count(read[c]) for c in candidates]).first()
        df = _replace(df, {c: read[c] for i, c in enumerate(candidates) if row[i + 1] > row[0] * 0.5})
    seconds = [epoch_seconds(quoted(f.name), f.dataType).alias(f"{f.name}_timestamp") for f in df.schema if is_datetime(f.dataType)]
    return df.select("*", *seconds)


# --- the pipeline ---------------------------------------------------------


@dataclass
class Cleaner:
    """A chain of cleaning steps that remembers what each step was given."""

    df: DataFrame
    steps: list[tuple[str, DataFrame, DataFrame, dict[str, str]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.df = normalize(self.df)
        self.original = self.df

    def apply(self, action: str, step, **options) -> "Cleaner":
        after = step(self.df, **options)
        details = {k: str(v) for k, v in options.items() if v is not None}
        self.steps.append((action, self.df, after, details))
        self.df = after
        return self

    def log(self) -> DataFrame:
        """One row per step with its shapes before and after."""
        frames = [self.original, *[after for _, _, after, _ in self.steps]]
        steps = []
        for i, (action, before, after, details) in enumerate(self.steps):
            entries = [F.lit(x) for kv in details.items() for x in kv]
            steps.append(
                (F.lit(action), F.lit(len(before.columns)), F.lit(len(after.columns)),
                 F.create_map(*entries).cast("map<string,string>"))
            )
        # Every frame is counted once; the last one only ends the last step.
        names = ("action", "cols_before", "cols_after", "details")
        steps.append((F.lit(None).cast("string"), F.lit(0), F.lit(0), F.create_map().cast("map<string,string>")))
        sizes = union_all(
            [
                frame.agg(F.lit(i).alias("step"), F.count(F.lit(1)).alias("rows_before"), *[c.alias(n) for n, c in zip(names, row)])
                for i, (frame, row) in enumerate(zip(frames, steps))
            ]
        )
        after = F.lead("rows_before").over(Window.partitionBy(F.lit(0)).orderBy("step"))
        return sizes.withColumn("rows_after", after).where("action IS NOT NULL").select(
            "step", "action", "rows_before", "rows_after", "cols_before", "cols_after", "details"
        )

    def summary(self) -> DataFrame:
        return cleaning_summary(self.original, self.df)


def clean_pipeline(df: DataFrame, options: Mapping[str, dict]) -> Cleaner:
    """Run the named steps in their fixed order with the given options.

    After copies are dropped the rows are written once, because the later steps
    that measure columns would repeat that shuffle for every column.
    """
    measuring = {"fill_missing", "remove_outliers", "standardize", "convert_types"} & set(options)
    without_copies = lambda d, **o: materialize(drop_duplicates(d, **o), "unique") if measuring else drop_duplicates(d, **o)
    steps = {
        "drop_nulls": drop_nulls,
        "drop_duplicates": without_copies,
        "fill_missing": fill_missing,
        "remove_outliers": remove_outliers,
        "standardize": standardize,
        "convert_types": lambda d, **o: convert_types(d, **o)[0],
    }
    unknown = set(options) - set(steps)
    if unknown:
        raise ValueError(f"unknown steps: {', '.join(sorted(unknown))}")
    cleaner = Cleaner(df)
    for name, step in steps.items():
        if name in options:
            cleaner.apply(name, step, **options[name])
    return cleaner


def _shape(df: DataFrame, prefix: str) -> DataFrame:
    groups = df.groupBy(*row_keys(df)).agg(
        F.count(F.lit(1)).alias("_n"),
        # Equal rows have equal nulls, so any copy stands for all of them.
        F.max(sum((quoted(c).isNull().cast("int") for c in df.columns), F.lit(0))).alias("_nulls"),
    )
    return groups.agg(
        F.lit(1).alias("j"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias(f"{prefix}_rows"),
        F.lit(len(df.columns)).alias(f"{prefix}_columns"),
        F.coalesce(F.sum(F.col("_nulls") * F.col("_n")), F.lit(0)).alias(f"{prefix}_nulls"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(f"{prefix}_duplicates"),
    )


def cleaning_summary(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: shape, nulls and duplicates before and after, and the changes."""
    both = _shape(normalize(original), "original").join(F.broadcast(_shape(normalize(cleaned), "final")), "j")
    return both.drop("j").select(
        "*",
        (F.col("original_rows") - F.col("final_rows")).alias("rows_removed"),
        (F.col("original_columns") - F.col("final_columns")).alias("columns_removed"),
        (F.col("original_nulls") - F.col("final_nulls")).alias("nulls_removed"),
        (F.col("original_duplicates") - F.col("final_duplicates")).alias("duplicates_removed"),
    )


def clean_for_export(df: DataFrame) -> DataFrame:
    """Empty rows and copies out, then outliers column by column, then dates.

    A null in a numeric column fails the range test here, so its row goes.
    """
    # Written once: every outlier pass reads it, and would shuffle it again.
    unique = materialize(drop_nulls(df, "all").dropDuplicates(), "unique")
    cleaned = remove_outliers(unique, "iqr", drop_null=True)
    if len(numeric_names(cleaned)) >= 2 and len(cleaned.take(10)) >= 10:
        cleaned = clean_frame(cleaned)
    return cleaned


def export_report(tables: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows before and after per table, and the share that was removed."""
    parts = [
        before.agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("original_records")).join(
            F.broadcast(after.agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("cleaned_records"))), "table_name"
        )
        for t, (before, after) in tables.items()
    ]
    original, cleaned = F.col("original_records"), F.col("cleaned_records")
    return union_all(parts).select(
        "*",
        (original - cleaned).alias("removed_records"),
        F.round(F.coalesce(F.try_divide((original - cleaned) * 100.0, original), F.lit(0.0)), 2).alias("cleaning_efficiency"),
    )
