"""Scalar column expressions; all of them stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats accepted when the format is not given, tried in order.
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yy", "M/d/yyyy", "yyyy-MM-dd HH:mm:ss")


def parse_date(text: Column, fmt: str = "M/d/yy") -> Column:
    """Date from text, null when it does not fit ``fmt``.

    Two-digit years 69..99 mean 1969..1999; Spark alone would read 2069..2099.
    """
    day = F.to_date(F.try_to_timestamp(text, F.lit(fmt)))
    if "yy" in fmt and "yyyy" not in fmt:
        day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
    return day


def parse_date_any(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Date from text in the first format that fits."""
    return F.coalesce(*[parse_date(text, f) for f in formats])


def to_flag(value: Column) -> Column:
    """Integer flag; anything that is not a number counts as 0."""
    return F.coalesce(value.try_cast("double").try_cast("int"), F.lit(0))


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        value = F.greatest(value, F.lit(low))
    if high is not None:
        value = F.least(value, F.lit(high))
    return value


def horizon_class(rul_days: Column) -> Column:
    """0 on the failure day, 1 up to a week, 2 up to 30 days, 3 otherwise."""
    return (
        F.when(rul_days == 0, 0)
        .when(rul_days.between(1, 7), 1)
        .when(rul_days.between(8, 30), 2)
        .otherwise(3)
    )


def within(rul_days: Column, days: int) -> Column:
    return (rul_days <= days).cast("int")


def alert(score: Column, threshold: Column | float) -> Column:
    return (score >= threshold).cast("int")


def first_argmax(values: Sequence[Column]) -> Column:
    """Position of the largest value, the first one on ties."""
    arr = F.array(*values)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def f_score(precision: Column, recall: Column, beta: Column | float = 1.0) -> Column:
    """F-beta, 0 where precision and recall are both 0."""
    b2 = beta * beta
    return ratio((1 + b2) * precision * recall, b2 * precision + recall)


def row_hash(keys: Sequence[str], seed: int) -> Column:
    """Repeatable 60-bit pseudo-random number of a row, the same on any cluster."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def unit_hash(keys: Sequence[str], seed: int) -> Column:
    """Repeatable pseudo-random number in [0, 1)."""
    return row_hash(keys, seed) / F.lit(float(1 << 60))
