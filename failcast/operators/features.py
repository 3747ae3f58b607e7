"""Features of past rows only, per machine.

All windows share one partitioning and order, so one shuffle and one sort (the
ones the labels already need) carry every column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failcast.schema import SENSORS


def _order(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("DATE")


def _past_mean(column: str, past, min_periods: int) -> Column:
    return F.when(F.count(column).over(past) >= min_periods, F.avg(column).over(past))


def lag_roll_features(
    df: DataFrame,
    sensors: Sequence[str] = SENSORS,
    window: int = 7,
    min_periods: int = 2,
    keys: Sequence[str] = ("ID",),
) -> DataFrame:
    """Previous reading and mean of the previous ``window`` rows of each sensor.

    ``keys=("ID", "split")`` starts the history anew in every split.
    """
    order = _order(keys)
    past = order.rowsBetween(-window, -1)
    new = {f"{s}_lag1": F.lag(s).over(order) for s in sensors}
    new |= {f"{s}_roll{window}_mean": _past_mean(s, past, min_periods) for s in sensors}
    return df.withColumns(new)


def rolling_features(
    df: DataFrame,
    sensors: Sequence[str] = SENSORS,
    windows: Sequence[int] = (7, 14, 30),
    keys: Sequence[str] = ("ID",),
) -> DataFrame:
    """Lag, one-step change, and past mean, deviation and slope per window.

    The slope is over the non-null readings of the window at positions 0, 1, 2...;
    it does not change when all positions move, so the running count of non-null
    readings serves as the position.
    """
    order = _order(keys)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = df.withColumns({f"_at_{s}": F.count(s).over(so_far).cast("double") for s in sensors})

    # Each sliding aggregate is computed once; the features follow by arithmetic.
    parts, new = {}, {}
    for s in sensors:
        parts[f"{s}_lag1"] = F.lag(s).over(order)
        new[f"{s}_delta1"] = F.col(s) - F.col(f"{s}_lag1")
        for w in windows:
            past = order.rowsBetween(-w, -1)
            k = F.col(f"_k_{s}_{w}")
            parts[f"_k_{s}_{w}"] = F.count(s).over(past)
            parts[f"_sum_{s}_{w}"] = F.sum(s).over(past)
            parts[f"_std_{s}_{w}"] = F.stddev_samp(s).over(past)
            parts[f"_cov_{s}_{w}"] = F.covar_pop(s, f"_at_{s}").over(past)
            enough = k >= max(2, w // 3)
            new[f"{s}_roll{w}_mean"] = F.when(enough, F.col(f"_sum_{s}_{w}") / k)
            new[f"{s}_roll{w}_std"] = F.when(enough, F.col(f"_std_{s}_{w}"))
            # k successive positions have the variance (k * k - 1) / 12.
            new[f"{s}_roll{w}_slope"] = F.when(enough, F.col(f"_cov_{s}_{w}") / ((k * k - 1) / 12))
    spare = [c for c in (*parts, *[f"_at_{s}" for s in sensors]) if c.startswith("_")]
    return placed.withColumns(parts).withColumns(new).drop(*spare)


def rolling_feature_names(
    sensors: Sequence[str] = SENSORS, windows: Sequence[int] = (7, 14, 30)
) -> list[str]:
    names = []
    for s in sensors:
        names += [f"{s}_lag1", f"{s}_delta1"]
        names += [f"{s}_roll{w}_{k}" for w in windows for k in ("mean", "std", "slope")]
    return names


def sequence_windows(
    df: DataFrame,
    value: str,
    length: int,
    keys: Sequence[str] = ("ID",),
    out: str = "sequence",
) -> DataFrame:
    """Array of the last ``length`` values of a machine, oldest first.

    Rows without ``length`` rows of history are left out; the other columns are
    those of the last row.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    past = _order(keys).rowsBetween(1 - length, 0)
    return df.withColumn(out, F.collect_list(F.struct(F.col(value).alias("v"))).over(past)).filter(
        F.size(out) == length
    ).withColumn(out, F.col(f"{out}.v"))
