"""Score a stream against limits that were fitted on history."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.schema import normalize, quoted
from ..operators import series as s
from ..plans.ordered import ordered
from .quality import with_event_time


@dataclass(frozen=True)
class StepModel:
    """First-order model of one value and the spread of its residual."""

    constant: float
    slope: float
    mean: float
    spread: float


def fit_steps(history: DataFrame, key: str, order_by: list[str], column: str, **sizes) -> StepModel:
    """One model over all keys; the step before a row is of the same key."""
    lagged = s.with_previous(ordered(normalize(history), order_by, [key], **sizes), [column]).df
    found = s.fit_var1(lagged, [column])
    if found is None:
        raise ValueError("not enough rows to fit a model")
    constant, slope = float(found[0, 0]), float(found[0, 1])
    residual = s.residuals([column], found)[f"_r_{column}"]
    row = lagged.agg(F.avg(residual), F.stddev_samp(residual)).first()
    return StepModel(constant, slope, row[0], row[1] or 1e-6)


def score_stream(
    df: DataFrame, key: str, time: str, tiebreak: str, column: str, model: StepModel, threshold: float = 2.0,
    delay: str = "1 hour", idle: str = "30 days",
) -> DataFrame:
    """Each row with the value before it of the same key, ``score`` and ``anomaly``.

    State is one number per key, and is dropped once the watermark has moved
    ``idle`` past the key's last row.  Rows of a key are put in order within a micro-batch, whose size the source
    bounds; between batches the order of arrival counts.
    """
    timed = with_event_time(df, time, delay)
    fields = [f for f in timed.schema if f.name in (key, time, tiebreak, column)]
    output = T.StructType(
        [*fields, T.StructField("previous", T.DoubleType()), T.StructField("score", T.DoubleType()),
         T.StructField("anomaly", T.BooleanType())]
    )
    names = [f.name for f in output]
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def score(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values([time, tiebreak]).reset_index(drop=True)
        before = state.get[0] if state.exists else None
        rows["previous"] = rows[column].shift(1)
        if before is not None:
            rows.iloc[0, rows.columns.get_loc("previous")] = before
        residual = rows[column] - model.constant - model.slope * rows["previous"]
        rows["score"] = ((residual - model.mean) / model.spread).abs()
        rows["anomaly"] = rows["score"] > threshold
        state.update((float(rows[column].iloc[-1]),))
        last_ms = int(rows[time].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last_ms, state.getCurrentWatermarkMs()) + idle_ms)
        yield rows[names]

    present = timed.where(quoted(column).isNotNull()).select(*[quoted(f.name) for f in fields])
    return present.groupBy(quoted(key)).applyInPandasWithState(
        score, output, "last double", "append", GroupStateTimeout.EventTimeTimeout
    )
