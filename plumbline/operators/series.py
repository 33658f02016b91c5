"""Time series: preparation, scaling, components, stationarity, autoregression."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import is_age_name
from ..functions.schema import datetime_names, normalize, numeric_names, quoted
from ..plans.materialize import materialize
from ..plans.ordered import POSITION, OrderedRows, carry, ordered, slide
from ..plans.sums import lag_products, nested_fits, vector_products
from .clean import clean_frame
from .recommend import date_columns_by_variance, measure_names

MAX_COMPONENTS = 5
MIN_SPREAD = 1e-6
# Fixed value: 5% point of the unit-root test with constant (MacKinnon).
UNIT_ROOT_5_PERCENT = -2.8615
# Above this many columns products are summed with numpy inside the tasks.
PAIR_COLUMNS = 16


class NoSeries(ValueError):
    """A table that is no series: without a time, a measure, or enough rows."""


def value(c: str) -> Column:
    return quoted(c).cast("double")


def valid_series_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Columns with under half of their values missing and some spread."""
    df = normalize(df)
    names = columns if columns is not None else numeric_names(df)
    if not names:
        return []
    row = df.agg(
        F.count(F.lit(1)), *[f(value(c)) for c in names for f in (F.count, F.stddev_samp)]
    ).first()
    keep = []
    for i, c in enumerate(names):
        present, spread = row[1 + 2 * i], row[2 + 2 * i]
        if row[0] and (row[0] - present) / row[0] < 0.5 and spread is not None and spread > MIN_SPREAD:
            keep.append(c)
    return keep


def impute_rows(rows: OrderedRows, columns: list[str]) -> OrderedRows:
    """Linear between neighbours, nearest value before the first and after the last."""
    names = rows.df.columns
    point = lambda c: F.when(quoted(c).isNotNull(), F.struct(value(c).alias("v"), F.col(POSITION).alias("p")))
    out = carry(rows, {f"_p_{c}": point(c) for c in columns})
    out = carry(out, {f"_n_{c}": point(c) for c in columns}, backward=True)
    new = {}
    for c in columns:
        before, after = F.col(f"`_p_{c}`"), F.col(f"`_n_{c}`")
        step = (F.col(POSITION) - before["p"]) / (after["p"] - before["p"])
        between = F.when(after["p"] > before["p"], before["v"] + (after["v"] - before["v"]) * step)
        new[c] = F.coalesce(value(c), between, before["v"], after["v"])
    return rows.with_df(out.df.select(*[new[c].alias(c) if c in new else quoted(c) for c in names]))


def impute_series(df: DataFrame, order_by: list[str], columns: list[str], keys: list[str] | None = None, **sizes) -> DataFrame:
    """Fill every gap along the order; rows of an all-null column are dropped."""
    return impute_rows(ordered(normalize(df), order_by, keys, **sizes), columns).rows().dropna(subset=columns)


def series_columns(df: DataFrame, id_rule: str = "strict", drop_age: bool = False) -> list[str]:
    """Measures of a table: numeric, and not an identifier, flag or timestamp.

    ``strict`` goes by name alone, so that a measure whose values all differ is
    kept; ``letters`` also drops those, and ``drop_age`` names with ``age``.
    """
    from ..functions.names import is_timestamp_name, looks_like_id

    if id_rule == "letters":
        names = measure_names(df, "letters")
    else:
        names = [c for c in numeric_names(df) if not is_timestamp_name(c) and not looks_like_id(c)]
    return [c for c in names if not (drop_age and is_age_name(c))]


def time_axis(cleaned: DataFrame, order_by: list[str], **sizes) -> str:
    """The time column of a table; of several the one whose steps vary most, the first if none does."""
    dates = datetime_names(cleaned)
    if not dates:
        raise NoSeries("no date column for a series")
    if len(dates) == 1:
        return dates[0]
    chosen = date_columns_by_variance(cleaned, order_by, **sizes).where("chosen").first()
    return chosen.column_name if chosen else dates[0]


def series_prepare(
    df: DataFrame,
    order_by: list[str],
    columns: list[str] | None = None,
    time: str | None = None,
    id_rule: str = "strict",
    drop_age: bool = False,
    **sizes,
) -> DataFrame:
    """Cleaned table as a series: time column, imputed measures, position."""
    cleaned = materialize(clean_frame(df), "cleaned")  # measured several times
    names = columns or series_columns(cleaned, id_rule, drop_age)
    if not names:
        raise NoSeries("no numeric column for a series")
    time = time or time_axis(cleaned, order_by, **sizes)
    order = list(dict.fromkeys([time, *order_by]))
    rows = ordered(cleaned.select(*dict.fromkeys([*order, *names])), order, **sizes)
    filled = impute_rows(rows, names).df.dropna(subset=[time, *names])
    return filled.select(POSITION, quoted(time), *[quoted(c) for c in names])


def scale_limits(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a deviation of zero becomes one."""
    row = df.agg(*[f(value(c)) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    return {c: (row[2 * i] or 0.0, row[2 * i + 1] or 1.0) for i, c in enumerate(columns)}


def scaled(c: str, limits: dict[str, tuple[float, float]]) -> Column:
    mean, spread = limits[c]
    return (value(c) - mean) / spread


def scale_series(df: DataFrame, columns: list[str]) -> DataFrame:
    df = normalize(df)
    limits = scale_limits(df, columns)
    return df.select(*[scaled(c, limits).alias(c) if c in limits else quoted(c) for c in df.columns])


# --- principal components -------------------------------------------------


@dataclass(frozen=True)
class Components:
    """Loadings, one row per component, and the share of variance of each."""

    loadings: np.ndarray
    ratios: list[float]


def _components(covariance: np.ndarray, count: int) -> Components:
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:count]
    loadings = vectors[:, order].T
    for row in loadings:
        size = np.abs(row)
        if row[np.flatnonzero(size >= size.max() - 1e-9)[0]] < 0:
            row *= -1
    total = values.sum()
    return Components(loadings, [float(v / total) if total > 0 else 0.0 for v in values[order]])


def component_count(columns: int, rows: int, max_components: int = MAX_COMPONENTS) -> int:
    return max(0, min(max_components, columns, rows - 1))


def fit_components(
    df: DataFrame, columns: list[str], limits: dict[str, tuple[float, float]], max_components: int = MAX_COMPONENTS
) -> Components:
    """Components of scaled columns from one aggregation over all rows in which every column has a value."""
    p = len(columns)
    z = {c: scaled(c, limits) for c in columns}
    if p > PAIR_COLUMNS:
        n, total, cross = vector_products(df.select(F.array(*z.values()).alias("v")), "v")
        mean = total / n
        return _components(cross / n - np.outer(mean, mean), component_count(p, int(n), max_components))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    complete = df.where(reduce(and_, [z[c].isNotNull() & ~F.isnan(z[c]) for c in columns], F.lit(True)))
    row = complete.agg(
        F.count(F.lit(1)), *[F.covar_pop(z[columns[i]], z[columns[j]]) for i, j in pairs]
    ).first()
    covariance = np.zeros((p, p))
    for x, (i, j) in enumerate(pairs):
        covariance[i, j] = covariance[j, i] = row[x + 1] or 0.0
    return _components(covariance, component_count(p, row[0], max_components))


def component_scores(columns: list[str], limits, fitted: Components) -> dict[str, Column]:
    return {
        f"PC_{k + 1}": sum((scaled(c, limits) * float(w) for c, w in zip(columns, load)), F.lit(0.0))
        for k, load in enumerate(fitted.loadings)
    }


def pca_project(df: DataFrame, columns: list[str], max_components: int = MAX_COMPONENTS) -> tuple[DataFrame, Components]:
    """Scores ``PC_1 ..`` next to the input columns, and the fitted components."""
    df = normalize(df)
    limits = scale_limits(df, columns)
    fitted = fit_components(df, columns, limits, max_components)
    return df.withColumns(component_scores(columns, limits, fitted)), fitted


def pca_vectors(df: DataFrame, column: str, max_components: int = MAX_COMPONENTS) -> tuple[DataFrame, Components]:
    """The same for an array column; products are summed with numpy in the tasks."""
    n, total, _ = vector_products(df, column)
    mean = total / n
    n, _, cross = vector_products(df, column, mean)
    spread = np.sqrt(np.diag(cross) / n)
    spread[spread == 0] = 1.0
    fitted = _components(cross / n / np.outer(spread, spread), component_count(len(mean), int(n), max_components))
    x = F.col(column).cast("array<double>")
    out = {}
    for k, load in enumerate(fitted.loadings):
        weights = load / spread
        w = F.array(*[F.lit(float(v)) for v in weights])
        products = F.zip_with(x, w, lambda a, b: a * b)
        out[f"PC_{k + 1}"] = F.aggregate(products, F.lit(float(-(weights @ mean))), lambda acc, v: acc + v)
    return df.withColumns(out), fitted


def explained_variance(spark, fitted: Components) -> DataFrame:
    rows = [(f"PC_{i + 1}", r) for i, r in enumerate(fitted.ratios)]
    return spark.createDataFrame(rows, "component string, ratio double")


# --- stationarity ---------------------------------------------------------


def max_lag(n: int) -> int:
    """Longest lag tried for a series of ``n`` values."""
    return max(0, min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25)))


@dataclass(frozen=True)
class UnitRoot:
    tau: float | None
    lag: int
    rows: int

    @property
    def stationary(self) -> bool:
        return self.tau is not None and self.tau <= UNIT_ROOT_5_PERCENT


def _tau(cross: np.ndarray, lag: int) -> float | None:
    """t value of the level in the regression with ``lag`` lags; null without more rows than unknowns."""
    x = [*range(2 + lag), cross.shape[0] - 1]
    n = int(round(cross[0, 0]))
    if n < len(x):
        return None
    spread = np.sqrt(np.diag(cross)[x])
    spread[spread == 0] = 1.0
    unit = cross[np.ix_(x, x)] / np.outer(spread, spread)
    normal, target = unit[:-1, :-1], unit[:-1, -1]
    beta = np.linalg.lstsq(normal, target, rcond=None)[0]
    ssr = max(float(unit[-1, -1] - beta @ target), 1e-300)
    error = math.sqrt(ssr / max(1, n - len(normal)) * max(0.0, np.linalg.pinv(normal, hermitian=True)[1, 1]))
    return float(beta[1] / error) if error > 0 else -math.inf


def unit_root_test(rows: OrderedRows, column: str, n: int, lags: int | None = None, center: float = 0.0) -> UnitRoot:
    """Augmented Dickey-Fuller test with constant, lag chosen by AIC.

    One pass over the series sums the products with each lag; all models are
    fitted in one elimination, the chosen one again with the rows that only the
    longest lag had to leave out.  A series of fewer rows than unknowns has no
    statistic.
    """
    top = max_lag(n) if lags is None else lags
    cross = lag_products(rows, column, top, center)
    used = int(round(cross[0, 0]))
    best = 0
    if used:
        fits = np.maximum(nested_fits(cross)[2:], 1e-300)
        best = int(np.argmin(used * np.log(fits / used) + 2.0 * (np.arange(top + 1) + 2)))
    if best < top:
        head = rows.df.where(F.col(POSITION) <= top).select(POSITION, value(column).alias("y")).collect()
        y = np.array([np.nan if r.y is None else r.y for r in sorted(head, key=lambda r: r[0])]) - center
        cross = cross.copy()
        for t in range(best + 1, top + 1):
            if t < len(y):
                step = lambda k: y[t - k] - y[t - k - 1] if t - k - 1 >= 0 else 0.0
                x = np.array([1.0, y[t - 1], *[step(k) for k in range(1, top + 1)], step(0)])
                if not np.isnan(x).any():
                    cross += np.outer(x, x)
    return UnitRoot(_tau(cross, best), best, int(round(cross[0, 0])))


def adf_stationarity(df: DataFrame, order_by: list[str], columns: list[str], lags: int | None = None, **sizes) -> DataFrame:
    """One row per column: test statistic, lag, and the verdict at 5%."""
    df = normalize(df)
    rows = ordered(df.select(*dict.fromkeys([*order_by, *columns])), order_by, **sizes)
    means = df.agg(*[F.avg(value(c)) for c in columns]).first()
    out = []
    for i, c in enumerate(columns):
        found = unit_root_test(rows, c, rows.largest, lags, means[i] or 0.0)
        out.append((c, found.tau, found.lag, found.rows, found.stationary))
    return df.sparkSession.createDataFrame(out, "column_name string, tau double, lag int, rows_used int, stationary boolean")


def difference_rows(rows: OrderedRows, columns: list[str]) -> OrderedRows:
    names = rows.df.columns
    out = slide(rows, {f"_d_{c}": lambda w, c=c: value(c) - F.lag(value(c)).over(w) for c in columns}, back=1)
    return rows.with_df(out.df.select(*[F.col(f"`_d_{c}`").alias(c) if c in columns else quoted(c) for c in names]))


def difference_series(df: DataFrame, order_by: list[str], columns: list[str], keys: list[str] | None = None, **sizes) -> DataFrame:
    """First differences in row order; rows without a predecessor are dropped."""
    return difference_rows(ordered(normalize(df), order_by, keys, **sizes), columns).rows().dropna(subset=columns)


# --- autoregression -------------------------------------------------------


def with_previous(rows: OrderedRows, columns: list[str]) -> OrderedRows:
    return slide(rows, {f"_l_{c}": lambda w, c=c: F.lag(value(c)).over(w) for c in columns}, back=1)


def fit_var1(lagged: DataFrame, columns: list[str]) -> np.ndarray | None:
    """Least-squares ``y(t) = a + B y(t-1)``; rows of (a, B), null if unsolvable.

    Expects ``_l_<column>`` beside each column.  A first aggregation tells the
    means, a second sums all products of what is left without them, so that a
    level far from zero costs no digits; the driver solves one system of k + 1
    unknowns.
    """
    k = len(columns)
    complete = lagged.dropna(subset=[*columns, *[f"_l_{c}" for c in columns]])
    means = complete.agg(*[F.avg(c) for c in [*[value(c) for c in columns], *[F.col(f"`_l_{c}`") for c in columns]]]).first()
    if means[0] is None:
        return None
    level, level_before = np.array(means[:k]), np.array(means[k:])
    x = [F.lit(1.0)] + [F.col(f"`_l_{c}`") - float(level_before[i]) for i, c in enumerate(columns)]
    y = [value(c) - float(level[i]) for i, c in enumerate(columns)]
    left = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    right = [(i, j) for i in range(k + 1) for j in range(k)]
    row = complete.agg(*[F.sum(x[i] * x[j]) for i, j in left], *[F.sum(x[i] * y[j]) for i, j in right]).first()
    if row[0] is None or row[0] < k + 2:
        return None
    normal, target = np.zeros((k + 1, k + 1)), np.zeros((k + 1, k))
    for n, (i, j) in enumerate(left):
        normal[i, j] = normal[j, i] = row[n]
    for n, (i, j) in enumerate(right):
        target[i, j] = row[len(left) + n]
    try:
        found = np.linalg.solve(normal, target).T
    except np.linalg.LinAlgError:
        found = np.linalg.lstsq(normal, target, rcond=None)[0].T
    found[:, 0] += level - found[:, 1:] @ level_before
    return found


def residuals(columns: list[str], coefficients: np.ndarray) -> dict[str, Column]:
    out = {}
    for i, c in enumerate(columns):
        fitted = F.lit(float(coefficients[i, 0]))
        for j, b in enumerate(columns):
            fitted = fitted + F.col(f"`_l_{b}`") * float(coefficients[i, j + 1])
        out[f"_r_{c}"] = value(c) - fitted
    return out


def residual_scores(lagged: DataFrame, columns: list[str], coefficients: np.ndarray) -> DataFrame:
    """Adds ``score``: the largest absolute z of any component's residual."""
    with_r = lagged.withColumns(residuals(columns, coefficients))
    names = [f"`_r_{c}`" for c in columns]
    row = with_r.agg(*[f(F.col(n)) for n in names for f in (F.avg, F.stddev_samp)]).first()
    z = [F.abs((F.col(n) - row[2 * i]) / (row[2 * i + 1] or 1e-6)) for i, n in enumerate(names)]
    score = F.greatest(*z) if len(z) > 1 else z[0]
    return with_r.withColumn("score", score).drop(*[f"_r_{c}" for c in columns], *[f"_l_{c}" for c in columns])


def var1_coefficients(df: DataFrame, order_by: list[str], columns: list[str], **sizes) -> DataFrame:
    """Coefficients in long form: equation, term, value."""
    lagged = with_previous(ordered(normalize(df), order_by, **sizes), columns).df
    found = fit_var1(lagged, columns)
    rows = []
    if found is not None:
        rows = [
            (c, term, float(found[i, j]))
            for i, c in enumerate(columns)
            for j, term in enumerate(["const", *columns])
        ]
    return df.sparkSession.createDataFrame(rows, "equation string, term string, value double")


def var1_residual_anomalies(df: DataFrame, order_by: list[str], columns: list[str], threshold: float = 2.0, **sizes) -> DataFrame:
    """Input rows with ``score`` and ``anomaly`` from a VAR(1) on the columns."""
    lagged = with_previous(ordered(normalize(df), order_by, **sizes), columns).df
    found = fit_var1(lagged, columns)
    if found is None:
        return lagged.select(*[quoted(c) for c in df.columns], F.lit(None).cast("double").alias("score"), F.lit(False).alias("anomaly"))
    scored = residual_scores(lagged, columns, found)
    return scored.select(
        *[quoted(c) for c in df.columns], "score", F.coalesce(F.col("score") > threshold, F.lit(False)).alias("anomaly")
    )
