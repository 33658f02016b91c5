"""Anomalies of a multivariate series, their severity, and roll-ups over tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.schema import normalize, numeric_names, quoted
from ..plans.materialize import materialize
from ..plans.ordered import POSITION, ordered
from . import series as s
from .clean import clean_frame
from .keyed import detect_by_key
from .quality import each_table

DEFAULT_THRESHOLD = 2.0
MIN_ROWS = 10
MIN_ROWS_AFTER_DIFFERENCING = 5


@dataclass(frozen=True)
class Detection:
    """Flagged rows, and how they came about."""

    rows: DataFrame
    status: str
    columns: list[str] = field(default_factory=list)
    ratios: list[float] = field(default_factory=list)
    differenced: list[str] = field(default_factory=list)


def _nothing(df: DataFrame, status: str, columns: list[str] | None = None) -> Detection:
    rows = df.select("*", F.lit(None).cast("double").alias("score"), F.lit(False).alias("anomaly"))
    return Detection(rows, status, columns or [])


def detect(
    df: DataFrame,
    order_by: list[str],
    columns: list[str] | None = None,
    threshold: float = DEFAULT_THRESHOLD,
    max_components: int = s.MAX_COMPONENTS,
    lags: int | None = None,
    **sizes,
) -> Detection:
    """Flag rows whose step is unlike the series: fill, scale, components,
    differencing where needed, VAR(1), residual z.

    Rows keep their columns and get ``score`` and ``anomaly``; a row without a
    predecessor has no score.  The filled components are written once, because
    the tests and fits read them several times.
    """
    df = normalize(df)
    wanted = columns if columns is not None else s.series_columns(df)
    if not wanted:
        return _nothing(df, "no numeric column")
    names = s.valid_series_columns(df, wanted)
    if not names:
        return _nothing(df, "no valid column")
    rows = ordered(df, order_by, **sizes)
    if rows.largest < MIN_ROWS:
        return _nothing(df, "too few rows", names)
    work = {f"_w{i}": c for i, c in enumerate(names)}
    copies = rows.with_df(rows.df.withColumns({w: s.value(c) for w, c in work.items()}))
    filled = s.impute_rows(copies, list(work))
    stored = filled.with_df(materialize(filled.df, "series"))
    limits = s.scale_limits(stored.df, list(work))
    fitted = s.fit_components(stored.df, list(work), limits, max_components)
    scores = {f"_{k}": c for k, c in s.component_scores(list(work), limits, fitted).items()}
    parts = list(scores)
    projected = stored.with_df(stored.df.withColumns(scores).drop(*work))
    moving = [c for c in parts if not s.unit_root_test(projected, c, rows.largest, lags).stationary]
    if moving:
        if rows.largest - 1 < MIN_ROWS_AFTER_DIFFERENCING:
            return _nothing(df, "too few rows after differencing", names)
        projected = s.difference_rows(projected, moving)
        first = F.col(POSITION) > 0
        projected = projected.with_df(
            projected.df.withColumns({c: F.when(first, F.col(c)) for c in parts if c not in moving})
        )
    lagged = s.with_previous(projected, parts)
    coefficients = s.fit_var1(lagged.df, parts)
    if coefficients is None:
        return _nothing(df, "no fit", names)
    scored = s.residual_scores(lagged.df, parts, coefficients)
    flagged = scored.select(
        *[quoted(c) for c in df.columns], "score", F.coalesce(F.col("score") > threshold, F.lit(False)).alias("anomaly")
    )
    return Detection(flagged, "ok", names, fitted.ratios, [c.lstrip("_") for c in moving])


def detect_anomalies(df: DataFrame, order_by: list[str], keys: list[str] | None = None, **options) -> DataFrame:
    """Rows with ``score`` and ``anomaly``; with ``keys`` every key is a series and has a model of its own."""
    if keys:
        return detect_by_key(df, order_by, keys, **options).drop("status")
    return detect(df, order_by, **options).rows


def run_detection(
    df: DataFrame, order_by: list[str], columns: list[str] | None = None, time: str | None = None, id_rule: str = "strict", **options
) -> Detection:
    """Prepare a table as a series and detect: all rows of ``df`` with ``score`` and ``anomaly``, and how they came about.

    Preparation drops sparse columns and copies, reads dates from text, takes the time column (of several the one whose
    steps vary most) and sorts by it and ``order_by``; rows without a time are no part of the series. Copies share the
    flag of the row that stayed. A table that is no series keeps its rows without scores, and ``status`` says why;
    other errors are raised.
    """
    df = normalize(df)
    order = [f"_order{i}" for i in range(len(order_by))]
    marked = df.withColumns({o: quoted(c) for o, c in zip(order, order_by)})
    cleaned = materialize(clean_frame(marked), "cleaned")
    try:
        missing = [o for o in order if o not in cleaned.columns]
        if missing:
            raise s.NoSeries("the order has too many missing values")
        names = columns if columns is not None else s.series_columns(cleaned.drop(*order), id_rule)
        if not names:
            raise s.NoSeries("no numeric column for a series")
        axis = time or s.time_axis(cleaned, order)
    except s.NoSeries as problem:
        return _nothing(df, str(problem))
    timed = cleaned.where(quoted(axis).isNotNull()).select(*order, quoted(axis), *[quoted(c) for c in names if c != axis])
    found = detect(timed, [axis, *order], columns=names, **options)
    # As many rows as distinct orders; rows of one order are copies of each other.
    flags = found.rows.groupBy(*[F.col(o).alias(f"_f{o}") for o in order]).agg(F.max("score").alias("score"), F.max("anomaly").alias("_a"))
    same = F.lit(True)
    for o, c in zip(order, order_by):
        same = same & F.col(f"_f{o}").eqNullSafe(quoted(c))
    rows = df.join(flags, same, "left").select(*[quoted(c) for c in df.columns], "score", F.coalesce("_a", F.lit(False)).alias("anomaly"))
    return replace(found, rows=rows)


def run_anomalies(df: DataFrame, order_by: list[str], **options) -> DataFrame:
    """Clean and detect; ``anomaly_varima`` per row and the reason in ``status``."""
    found = run_detection(df, order_by, **options)
    return found.rows.withColumnRenamed("anomaly", "anomaly_varima").withColumn("status", F.lit(found.status))


def anomaly_summary(flagged: DataFrame, table_name: str, columns: int, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One row: how many rows, columns and anomalies, their share, and the model."""
    total, found = F.count(F.lit(1)), F.count_if(F.col("anomaly"))
    return flagged.agg(
        F.lit(table_name).alias("table_name"), total.alias("total_observations"),
        F.lit(columns).alias("numeric_columns"), found.alias("anomalies_detected"),
        F.coalesce(F.try_divide(found * 100.0, total), F.lit(0.0)).alias("anomaly_percentage"),
        F.max("score").alias("max_score"), F.lit(threshold).alias("threshold"),
        F.lit("PCA + VAR(1)").alias("model_type"),
    )


def detection_summary(found: Detection, table_name: str, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """``anomaly_summary`` of a run, with what it used: columns, shares of the components, which were differenced."""
    list_of = lambda values, kind: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
    return anomaly_summary(found.rows, table_name, len(found.columns), threshold).select(
        "*", list_of(found.columns, "string").alias("columns_analyzed"), list_of(found.ratios, "double").alias("component_shares"),
        list_of(found.differenced, "string").alias("differenced"), F.lit(found.status).alias("status"),
    )


def anomaly_keys(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """The flagged rows themselves, by key: a table, however many there are."""
    return flagged.where("anomaly").select(*[quoted(k) for k in keys], "score")


def severity(score: Column, scheme: str = "report") -> Column:
    """``report``: above 3.5 high, above 2.5 medium; ``ui``: above 3 and 2."""
    high, medium = (3.5, 2.5) if scheme == "report" else (3.0, 2.0)
    return F.when(score > high, "high").when(score > medium, "medium").otherwise("low")


def confidence(score: Column) -> Column:
    return F.least(F.lit(95.0), F.round(score * 30))


def with_severity(flagged: DataFrame) -> DataFrame:
    score = F.col("score")
    return flagged.where("anomaly").select(
        "*", severity(score).alias("severity"), severity(score, "ui").alias("ui_severity"),
        confidence(score).alias("confidence"),
    )


def top_anomalies(flagged: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    return flagged.where("anomaly").orderBy(F.desc("score"), *[quoted(k) for k in keys]).limit(n)


SUMMARY_SCHEMA = (
    "table_name string, total_observations long, numeric_columns int, anomalies_detected long, anomaly_percentage double, max_score double, "
    "threshold double, model_type string, columns_analyzed array<string>, component_shares array<double>, differenced array<string>, "
    "status string, error string"
)


def summarize_tables(
    spark: SparkSession,
    tables: Mapping[str, tuple[DataFrame | Callable[[], DataFrame], list[str]]],
    parallel: int = 4,
    **options,
) -> DataFrame:
    """Prepare and detect on every table; one row each, with the error's name where a table fails.

    A table is a DataFrame, or a function that reads one, and the order of its rows. Tables with fewer than two numeric
    columns fail, and so do those that are no series.
    """
    threshold = options.get("threshold", DEFAULT_THRESHOLD)

    def one(df: DataFrame, name: str):
        if len(numeric_names(df)) < 2:
            raise s.NoSeries("fewer than two numeric columns")
        found = run_detection(df, tables[name][1], **options)
        if found.status != "ok":
            raise s.NoSeries(found.status)
        return *detection_summary(found, name, threshold).first(), None

    failed = lambda name, problem: (name, *[None] * 10, str(problem) if isinstance(problem, s.NoSeries) else "failed", type(problem).__name__)
    rows = each_table({t: df for t, (df, _) in tables.items()}, one, failed, parallel)
    return spark.createDataFrame(rows, SUMMARY_SCHEMA)


def _totals(summaries: DataFrame) -> DataFrame:
    found, seen = F.col("anomalies_detected"), F.col("total_observations")
    return summaries.agg(
        F.coalesce(F.sum(found), F.lit(0)).alias("total_anomalies"),
        F.coalesce(F.sum(seen), F.lit(0)).alias("total_records"),
        F.count(F.lit(1)).alias("tables_analyzed"),
        F.count_if(F.col("error").isNotNull()).alias("tables_failed"),
        F.count_if(found > 0).alias("tables_with_anomalies"),
    )


def anomaly_rollup(summaries: DataFrame) -> DataFrame:
    """Totals over tables; risk low at no anomaly, medium below 5%, else high."""
    rate = F.coalesce(F.try_divide(F.col("total_anomalies") * 100.0, F.col("total_records")), F.lit(0.0))
    return _totals(summaries).select(
        rate.alias("anomaly_rate"),
        F.when(rate == 0, "low").when(rate < 5, "medium").otherwise("high").alias("risk_level"),
        "total_anomalies", "total_records", "tables_analyzed", "tables_failed", "tables_with_anomalies",
    )


def anomaly_rollup_legacy(flagged: Mapping[str, DataFrame]) -> DataFrame:
    """Rate to two digits, risk at 2% and 5% of rows, and counts by severity."""
    from ..plans.quantiles import union_all

    level = severity(F.col("score"))
    count = lambda name: F.count_if(F.col("anomaly") & (level == name))
    parts = [
        df.agg(
            F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n"), F.count_if("anomaly").alias("a"),
            *[count(x).alias(x) for x in ("high", "medium", "low")],
        )
        for t, df in flagged.items()
    ]
    total = union_all(parts).agg(
        F.sum("a").alias("total_anomalies"), F.sum("n").alias("total_records"), F.count(F.lit(1)).alias("tables_analyzed"),
        *[F.sum(x).alias(f"{x}_severity") for x in ("high", "medium", "low")],
    )
    found, seen = F.col("total_anomalies"), F.col("total_records")
    return total.select(
        F.coalesce(F.round(F.try_divide(found * 100.0, seen), 2), F.lit(0.0)).alias("anomaly_rate"),
        F.when(found > seen * 0.05, "High").when(found > seen * 0.02, "Medium").otherwise("Low").alias("risk_level"),
        "*",
    )


def detect_selected_tables(
    union: DataFrame, selected: Mapping[str, tuple[list[str], list[str]]], tag: str = "_source_table", **options
) -> DataFrame:
    """Detect per selected table of a tagged union; (order, columns) are given per table.

    Rows of different tables make no common series, so each table is its own.
    """
    from ..plans.quantiles import union_all

    parts = []
    for table, (order_by, columns) in selected.items():
        part = union.where(F.col(tag) == table)
        parts.append(detect_anomalies(part, order_by, columns=columns, **options))
    return union_all(parts)
