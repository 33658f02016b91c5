"""Preprocessing of series and features: rolling values, decomposition, lags, checks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import epoch_micros
from ..functions.schema import normalize, quoted
from ..functions.values import correlation
from ..plans.distances import distribution_distances
from ..plans.materialize import discard, fresh_path
from ..plans.ordered import BUCKET, POSITION, OrderedRows, carry, ordered, slide
from ..plans.profile import column_profile
from ..plans.quantiles import exact_quantiles
from ..plans.sums import lag_covariances, lag_products, nested_fits, pair_correlations
from . import series as s
from .clean import drop_duplicates, zscore_limits
from .detail import detail_metrics
from .quality import table_metrics

#: Weight over which one block of values is summed; a double holds no value of less weight beside another.
EWMA_SPAN = 1e-100
# Fixed value: 5% point of the residual test for two series with constant.
COINTEGRATION_5_PERCENT = -3.3377


def rolling_stats(df: DataFrame, order_by: list[str], column: str, size: int, keys: list[str] | None = None, **sizes) -> DataFrame:
    """Mean, sample deviation, min and max of the last ``size`` rows."""
    rows = ordered(normalize(df), order_by, keys, **sizes)
    over = lambda f: lambda w: f(s.value(column)).over(w.rowsBetween(-(size - 1), 0))
    kinds = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return slide(rows, {f"{column}_rolling_{k}": over(f) for k, f in kinds.items()}, back=size - 1).rows()


def _beside(rows: DataFrame, found: DataFrame, keys: tuple[str, ...], place: str) -> DataFrame:
    """``rows`` with the columns of ``found`` for the same keys and place."""
    found = found.select(
        *[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(place).alias("_place"),
        *[c for c in found.columns if c not in (*keys, place)],
    )
    same = F.col(place) == F.col("_place")
    for i, k in enumerate(keys):
        same = same & quoted(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(found, same, "left").drop("_place", *[f"_k{i}" for i in range(len(keys))])


def ewma(df: DataFrame, order_by: list[str], column: str, alpha: float, keys: list[str] | None = None, **sizes) -> DataFrame:
    """Exponentially weighted mean of all values up to a row; nulls are skipped and repeat the mean before them.

    Values are numbered and cut into blocks. A weighted sum grows inside its block, and the sum of the block before is
    added with its weight. ``alpha`` is above 0 and at most 1; at 1 each row has the last value.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    rows = ordered(normalize(df), order_by, keys, **sizes)
    name = f"{column}_ewma"
    if alpha == 1:
        return carry(rows, {name: s.value(column)}).rows()
    rate = math.log1p(-alpha)
    block = max(1, math.floor(math.log(EWMA_SPAN) / rate))
    weight = lambda age: F.exp(age * rate)
    x, number, by = F.col("_x"), F.col("_number"), [quoted(k) for k in rows.keys]
    upto = (Window.unboundedPreceding, Window.currentRow)

    placed = rows.df.withColumn("_x", s.value(column)).withColumn(BUCKET, F.floor(F.col(POSITION) / rows.bucket_rows).cast("long"))
    placed = placed.withColumn("_number", F.count(x).over(Window.partitionBy(*by, BUCKET).orderBy(POSITION).rowsBetween(*upto)))
    if not rows.one_bucket:
        counts = placed.groupBy(*by, BUCKET).agg(F.count(x).alias("_n"))
        earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
        placed = _beside(placed, counts, rows.keys, BUCKET).withColumn("_number", number + F.col("_before"))
    placed = placed.withColumn("_block", F.floor((number - 1) / block).cast("long"))
    age = F.pmod(number - 1, F.lit(block))
    ends = placed.where(x.isNotNull()).groupBy(*by, "_block").agg(F.sum(x * weight(block - 1 - age)).alias("_end"))
    placed = _beside(placed, ends.withColumn("_block", F.col("_block") + 1), rows.keys, "_block")
    # Rows without a value take no part, so a long run of them need not share the task of its block.
    own = Window.partitionBy(*by, "_block", F.when(x.isNull(), F.col(BUCKET))).orderBy(POSITION).rowsBetween(*upto)
    total = F.sum(x * weight(-age)).over(own) * weight(age) + F.coalesce("_end", F.lit(0.0)) * weight(age + 1)
    mean = F.when(x.isNotNull(), total * alpha / -F.expm1(number * rate))
    found = placed.select(*[quoted(c) for c in rows.df.columns], mean.alias("_mean"))
    return carry(rows.with_df(found), {name: F.col("_mean")}).rows().drop("_mean")


def seasonal_decompose(df: DataFrame, order_by: list[str], column: str, period: int, **sizes) -> DataFrame:
    """Additive: centred moving average, mean by phase, and what is left."""
    half = period // 2
    rows = ordered(normalize(df), order_by, **sizes)

    def trend(w):
        x = s.value(column)
        total = F.sum(x).over(w.rowsBetween(-half, half))
        if period % 2 == 0:
            total = total - (F.lag(x, half).over(w) + F.lead(x, half).over(w)) / 2
        return F.when(F.count(x).over(w.rowsBetween(-half, half)) == 2 * half + 1, total / period)

    parts = slide(rows, {"trend": trend}, back=half, ahead=half).df.withColumn("_phase", F.col(POSITION) % period)
    loose = s.value(column) - F.col("trend")
    phases = parts.groupBy("_phase").agg(F.avg(loose).alias("_mean"))
    level = phases.agg(F.avg("_mean")).first()[0] or 0.0
    # One row per phase: as many as the period is long.
    joined = parts.join(F.broadcast(phases), "_phase", "left").withColumn("seasonal", F.col("_mean") - level)
    return joined.withColumn("residual", loose - F.col("seasonal")).drop("_phase", "_mean", POSITION)


def _lagged(df: DataFrame, order_by: list[str], columns: dict[str, tuple[str, int]], **sizes) -> OrderedRows:
    reach = max((k for _, k in columns.values()), default=0)
    names = dict.fromkeys([*order_by, *[c for c, _ in columns.values()]])
    rows = ordered(normalize(df).select(*[quoted(c) for c in names]), order_by, **sizes)
    return slide(rows, {n: lambda w, c=c, k=k: F.lag(s.value(c), k).over(w) for n, (c, k) in columns.items()}, back=reach)


def _acf_values(df: DataFrame, order_by: list[str], column: str, lags: int, **sizes) -> list[float]:
    df = normalize(df)
    mean = df.agg(F.avg(s.value(column))).first()[0] or 0.0
    rows = ordered(df.select(*[quoted(c) for c in dict.fromkeys([*order_by, column])]), order_by, **sizes)
    sums = lag_covariances(rows, column, lags, mean)
    return [1.0] + [float(x / sums[0]) if sums[0] else 0.0 for x in sums[1:]]


def acf(df: DataFrame, order_by: list[str], column: str, lags: int = 20, **sizes) -> DataFrame:
    """Autocorrelation up to ``lags``; a pair of rows with a null adds nothing."""
    values = _acf_values(df, order_by, column, lags, **sizes)
    return df.sparkSession.createDataFrame(list(enumerate(values)), "lag int, acf double")


def _partial(r: list[float]) -> list[float]:
    out, phi = [1.0], np.zeros(0)
    error = 1.0
    for k in range(1, len(r)):
        top = r[k] - float(phi @ np.array(r[k - 1 : 0 : -1])) if k > 1 else r[1]
        last = top / error if error else 0.0
        phi = np.concatenate([phi - last * phi[::-1], [last]])
        error *= 1.0 - last * last
        out.append(float(last))
    return out


def pacf(df: DataFrame, order_by: list[str], column: str, lags: int = 20, **sizes) -> DataFrame:
    """Partial autocorrelation, from the autocorrelations by recursion."""
    values = _partial(_acf_values(df, order_by, column, lags, **sizes))
    return df.sparkSession.createDataFrame(list(enumerate(values)), "lag int, pacf double")


def cross_correlation(df: DataFrame, order_by: list[str], left: str, right: str, lags: int = 10, **sizes) -> DataFrame:
    """Correlation of ``left`` with ``right`` 0 to ``lags`` rows earlier."""
    shifted = {f"_l{k}": (right, k) for k in range(lags + 1)}
    rows = _lagged(df.select(*dict.fromkeys([*order_by, left, right])), order_by, shifted | {"_left": (left, 0)}, **sizes)
    wide = rows.df.agg(*[correlation(F.col("_left"), F.col(f"_l{k}")).alias(f"r{k}") for k in range(lags + 1)])
    pairs = [F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("correlation")) for k in range(lags + 1)]
    return wide.select(F.inline(F.array(*pairs)))


def trend(df: DataFrame, order_by: list[str], column: str, **sizes) -> DataFrame:
    """Linear trend by row position: rows with fitted line and what remains."""
    rows = ordered(normalize(df), order_by, **sizes)
    x = F.col(POSITION).cast("double")
    slope, level = rows.df.agg(F.regr_slope(s.value(column), x), F.regr_intercept(s.value(column), x)).first()
    line = F.lit(level) + x * F.lit(slope)
    return rows.df.select(
        *[quoted(c) for c in df.columns], line.alias("trend"), (s.value(column) - line).alias("detrended"), F.lit(slope).alias("slope")
    )


def _steps(df: DataFrame, time: str, keys: list[str] | None, **sizes) -> DataFrame:
    rows = ordered(df.select(*[quoted(c) for c in dict.fromkeys([*(keys or []), time])]).distinct(), [time], keys, **sizes)
    after = lambda w: F.lead(quoted(time)).over(w)
    kind = df.schema[time].dataType
    step = epoch_micros(F.col("_next"), kind) - epoch_micros(quoted(time), kind)
    return slide(rows, {"_next": after}, ahead=1).rows().withColumn("_step", step)


def frequency(df: DataFrame, time: str, keys: list[str] | None = None, **sizes) -> DataFrame:
    """The most common step between times, in seconds, and its share."""
    steps = _steps(df, time, keys, **sizes).where("_step IS NOT NULL")
    counts = steps.groupBy("_step").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.lit(1).alias("j"), F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), "_step").limit(1).withColumn("j", F.lit(1))
    return top.join(F.broadcast(total), "j").select(
        (F.col("_step") / 1e6).alias("step_seconds"), F.col("n").alias("steps"), (F.col("n") / F.col("total")).alias("share")
    )


def gaps(df: DataFrame, time: str, step: str, keys: list[str] | None = None, **sizes) -> DataFrame:
    """Times that a regular step would have and the table has not.

    Each gap is filled from its own left edge, so the calendar of the whole
    range is never built in one place.
    """
    found = _steps(df, time, keys, **sizes).where("_next IS NOT NULL")
    every = F.expr(f"INTERVAL {step}")
    missing = F.when(quoted(time) + every < F.col("_next"), F.sequence(quoted(time) + every, F.col("_next"), every))
    return found.select(*[quoted(k) for k in keys or []], "_next", F.explode(missing).alias(time)).where(
        quoted(time) < F.col("_next")
    ).drop("_next")


LAG_ORDERS = "lag_order int, aic double, bic double, best_aic boolean, best_bic boolean"


def lag_selection(df: DataFrame, order_by: list[str], column: str, max_order: int = 8, **sizes) -> DataFrame:
    """AIC and BIC of autoregressions of order 0 to ``max_order`` on one sample: rows with all lags present.

    The residual sums are those of the scaled series. Without a complete row there is no result.
    """
    df = normalize(df)
    rows = ordered(df.select(*[quoted(c) for c in dict.fromkeys([*order_by, column])]), order_by, **sizes)
    mean, spread = s.scale_limits(df, [column])[column]
    cross = lag_products(rows, column, max_order, mean or 0.0, spread or 1.0, steps=False)
    n, out = cross[0, 0], []
    for p, ssr in enumerate(nested_fits(cross)[1:] if n else ()):
        fit = n * math.log(max(float(ssr), 1e-300) / n)
        out.append((p, float(fit + 2 * (p + 1)), float(fit + math.log(n) * (p + 1))))
    if not out:
        return df.sparkSession.createDataFrame([], LAG_ORDERS)
    best = [min(range(len(out)), key=lambda i: out[i][k]) for k in (1, 2)]
    rows_out = [(p, a, b, p == best[0], p == best[1]) for p, a, b in out]
    return df.sparkSession.createDataFrame(rows_out, LAG_ORDERS)


def cointegration(df: DataFrame, order_by: list[str], left: str, right: str, lags: int | None = None, **sizes) -> DataFrame:
    """Regress one series on the other and test the residual for a unit root; too few rows give null and false."""
    df = normalize(df)
    slope, level = df.agg(F.regr_slope(s.value(left), s.value(right)), F.regr_intercept(s.value(left), s.value(right))).first()
    fitted = F.lit(level).cast("double") + s.value(right) * F.lit(slope).cast("double")
    residual = df.select(*[quoted(c) for c in order_by], (s.value(left) - fitted).alias("_residual"))
    rows = ordered(residual, order_by, **sizes)
    found = s.unit_root_test(rows, "_residual", rows.largest, lags)
    out = [(left, right, slope, level, found.tau, found.lag, found.tau is not None and found.tau <= COINTEGRATION_5_PERCENT)]
    return df.sparkSession.createDataFrame(
        out, "left_column string, right_column string, slope double, level double, tau double, lag int, cointegrated boolean"
    )


# --- transforms -----------------------------------------------------------


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def log_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    return _replace(normalize(df), {c: F.when(s.value(c) > -1, F.log1p(s.value(c))) for c in columns})


#: First bracket of the power, powers tried per pass, and how far the bracket may be widened.
POWERS, TRIED, WIDEST = (-2.0, 2.0), 17, 64.0


def _power(log: Column, lam: float) -> Column:
    """Box-Cox value from a logarithm; exact near a power of zero, too."""
    return log if lam == 0 else F.expm1(log * F.lit(float(lam))) / F.lit(float(lam))


def _fits(logs: DataFrame, powers: np.ndarray, n: int, mean: float) -> np.ndarray:
    """Likelihood of each power but for a constant; logarithms less their mean, so that no power outgrows a double."""
    x = F.col("x") - F.lit(mean)
    row = logs.agg(*[F.var_pop(_power(x, lam)) for lam in powers]).first()
    return np.array([-n / 2 * math.log(v) if v and 0 < v < math.inf else -math.inf for v in row])


def box_cox_lambda(df: DataFrame, column: str) -> float | None:
    """The power with the largest likelihood, to some six digits.

    Logarithms of the positive values are written once. Each pass over them tries all powers of a bracket; a best power
    at its edge moves the bracket out, one inside narrows it to its neighbours, and a parabola through the last three
    gives the place between. Without positive values there is none; values that do not differ keep the power 1.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "logs")
    normalize(df).where(s.value(column) > 0).select(F.log(s.value(column)).alias("x")).write.parquet(path)
    logs = spark.read.schema("x double").parquet(path)
    n, mean, low_log, high_log = logs.agg(F.count("x"), F.avg("x"), F.min("x"), F.max("x")).first()
    if not n or low_log == high_log or not math.isfinite(mean):
        discard(spark, path)
        return 1.0 if n else None
    low, high = POWERS
    while True:
        powers = np.linspace(low, high, TRIED)
        fits = _fits(logs, powers, n, mean)
        best, step = int(np.argmax(fits)), powers[1] - powers[0]
        if best in (0, TRIED - 1) and abs(powers[best]) < WIDEST:
            low, high = powers[best] - (high - low), powers[best] + (high - low)
        elif step < 1e-3 or best in (0, TRIED - 1):
            break
        else:
            low, high = powers[best] - step, powers[best] + step
    discard(spark, path)
    if best in (0, TRIED - 1):
        return float(powers[best])
    a, b, c = fits[best - 1 : best + 2]
    bend = a - 2 * b + c
    return float(powers[best] + (0.5 * step * (a - c) / bend if bend < 0 else 0.0))


def box_cox(df: DataFrame, column: str, power: float | None = None) -> tuple[DataFrame, float | None]:
    """Positive values transformed with ``power``, or the fitted one; others become null."""
    df = normalize(df)
    lam = box_cox_lambda(df, column) if power is None else power
    log = F.log(F.when(s.value(column) > 0, s.value(column)))
    return _replace(df, {column: F.lit(None).cast("double") if lam is None else _power(log, lam)}), lam


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distance from the median in units of the quartile range."""
    df = normalize(df)
    found = exact_quantiles(df, columns)
    new = {}
    for c, (q1, median, q3) in found.items():
        if median is not None:
            new[c] = (s.value(c) - median) / ((q3 - q1) or 1.0)
    return _replace(df, new)


# --- variables ------------------------------------------------------------


def variable_importance(df: DataFrame, columns: list[str], max_components: int = s.MAX_COMPONENTS) -> DataFrame:
    """Absolute loadings of each variable, weighted by the variance explained."""
    df = normalize(df)
    fitted = s.fit_components(df, columns, s.scale_limits(df, columns), max_components)
    weights = np.abs(fitted.loadings).T @ np.array(fitted.ratios)
    total = weights.sum() or 1.0
    rows = [(c, float(w), float(w / total)) for c, w in zip(columns, weights)]
    return df.sparkSession.createDataFrame(rows, "column_name string, importance double, share double")


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Correlations with ones on the diagonal and zeros where a column does not vary."""
    out = np.nan_to_num(pair_correlations(df, columns)) if columns else np.zeros((0, 0))
    np.fill_diagonal(out, 1.0)
    return out


def multicollinearity(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation: the diagonal of the inverse correlation matrix."""
    vif = np.diag(np.linalg.pinv(correlation_matrix(normalize(df), columns)))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, vif)], "column_name string, vif double")


def feature_selection(df: DataFrame, columns: list[str], min_variance: float = 1e-12, max_correlation: float = 0.95) -> DataFrame:
    """Per column whether to keep it: enough variance, and unlike those kept before."""
    df = normalize(df)
    row = df.agg(*[F.var_samp(s.value(c)) for c in columns]).first()
    r, kept, out = np.abs(correlation_matrix(df, columns)), [], []
    for i, c in enumerate(columns):
        like = [columns[k] for k in kept if r[i, k] > max_correlation]
        if row[i] is None or row[i] <= min_variance:
            out.append((c, False, "low variance"))
        elif like:
            out.append((c, False, f"correlated with {like[0]}"))
        else:
            kept.append(i)
            out.append((c, True, None))
    return df.sparkSession.createDataFrame(out, "column_name string, kept boolean, reason string")


def latest_per_key(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The newest row of every key."""
    return drop_duplicates(df, keys, "last", order_by)


# --- checks before and after ----------------------------------------------


def critical_columns(df: DataFrame) -> DataFrame:
    """Rows lost per column if rows with a null there, or only there, were dropped."""
    df = normalize(df)
    nulls = sum((quoted(c).isNull().cast("int") for c in df.columns), F.lit(0))
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(quoted(c).isNull()).alias(f"a{i}") for i, c in enumerate(df.columns)],
        *[F.count_if(quoted(c).isNull() & (nulls == 1)).alias(f"o{i}") for i, c in enumerate(df.columns)],
    )
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"), F.col(f"a{i}").alias("rows_lost"), F.col(f"o{i}").alias("rows_lost_only_here"),
                        F.round(F.try_divide(F.col(f"a{i}") * 100.0, F.col("n")), 4).alias("percent_lost"),
                    )
                    for i, c in enumerate(df.columns)
                ]
            )
        )
    )


def imputation_check(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, deviation and median before and after, the largest quartile shift, and two distances of the distributions.

    ``ks_distance`` is the largest difference of the distribution functions, ``wasserstein_distance`` the area between
    them in the column's unit; both are exact.
    """
    apart = distribution_distances(normalize(before), normalize(after), columns)
    sides = []
    for df in (normalize(before), normalize(after)):
        sides.append((zscore_limits(df, columns), exact_quantiles(df, columns)))
    out = []
    for c in columns:
        (m0, s0), (m1, s1) = (side[0][c] or (None, None) for side in sides)
        q0, q1 = sides[0][1][c], sides[1][1][c]
        spread = q0[2] - q0[0] if q0[0] is not None else 0.0
        shift = max(abs(x - y) for x, y in zip(q0, q1)) / spread if spread else None
        out.append((c, m0, m1, s0, s1, q0[1], q1[1], shift, *apart[c]))
    return before.sparkSession.createDataFrame(
        out,
        "column_name string, mean_before double, mean_after double, std_before double, std_after double, "
        "median_before double, median_after double, quartile_shift double, ks_distance double, wasserstein_distance double",
    )


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two profiles side by side; a column that is gone has nulls on its side."""
    facts = ("row_count", "null_count", "unique_count", "mean_value")
    side = lambda df, tag: column_profile(normalize(df)).select("column_name", *[F.col(f).alias(f"{f}_{tag}") for f in facts])
    return side(before, "before").join(side(after, "after"), "column_name", "full")


# Weights and limits of the readiness score are this library's own.
READINESS_WEIGHTS = {"completeness": 0.4, "row_uniqueness": 0.3, "accuracy": 0.3}


def readiness(df: DataFrame, table_name: str) -> DataFrame:
    """One weighted score of a table, and what it is ready for."""
    scores = table_metrics(df, table_name).select("table_name", "completeness", "accuracy")
    rows = detail_metrics(df, table_name).select("table_name", F.col("uniqueness").alias("row_uniqueness"))
    both = scores.join(F.broadcast(rows), "table_name")
    score = sum((F.col(c) * w for c, w in READINESS_WEIGHTS.items()), F.lit(0.0))
    return both.select(
        "*", score.alias("readiness"), F.when(score >= 95, "ready").when(score >= 80, "needs review").otherwise("not ready").alias("verdict")
    )
