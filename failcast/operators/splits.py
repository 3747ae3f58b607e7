"""Splits by date and by repeatable random order."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failcast.functions.columns import row_hash
from failcast.functions.order import order_statistics
from failcast.schema import KEYS, SEED, TRAIN_FRACTION, VAL_FRACTION


def check_fractions(*fractions: float) -> None:
    if any(f <= 0 for f in fractions) or sum(fractions) >= 1:
        raise ValueError("Fractions must be positive and add up to less than 1")


def date_quantiles(df: DataFrame, probs: Sequence[float]) -> DataFrame:
    """One row with the exact interpolated quantiles of DATE in days since 1970.

    Rows are counted per day first, so the quantile sees one row per calendar day.
    """
    days = df.groupBy(F.unix_date("DATE").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.agg(F.percentile("day", list(probs), F.col("n")).alias("cutoffs"))


def _at_or_before(cutoffs: Column, i: int) -> Column:
    return F.unix_date("DATE") <= F.get(cutoffs, F.lit(i))


def time_split(
    df: DataFrame, train: float = TRAIN_FRACTION, val: float = VAL_FRACTION, of: DataFrame | None = None
) -> DataFrame:
    """Add ``split``: train, val or test by date quantiles of ``of`` (default ``df``).

    The cut-offs are a scalar subquery over the label columns only, not a join.
    """
    check_fractions(train, val)
    return _split_at(df, date_quantiles(df if of is None else of, [train, train + val]).scalar())


def stored_time_split(df: DataFrame, train: float = TRAIN_FRACTION, val: float = VAL_FRACTION) -> DataFrame:
    """``time_split`` of a stored table: the cut-offs are read at once, from its dates alone."""
    check_fractions(train, val)
    ends = date_quantiles(df, [train, train + val]).first()[0]
    # A table without rows has no cut-offs.
    cutoffs = F.array(*map(F.lit, ends)) if ends else F.lit(None).cast("array<double>")
    return _split_at(df, cutoffs)


def _split_at(df: DataFrame, cutoffs: Column) -> DataFrame:
    return df.withColumn(
        "split",
        F.when(_at_or_before(cutoffs, 0), "train").when(_at_or_before(cutoffs, 1), "val").otherwise("test"),
    )


def time_split_2way(df: DataFrame, test: float = 0.2) -> DataFrame:
    """Add ``split``: train up to the date quantile ``1 - test``, test after it."""
    check_fractions(test)
    cutoffs = date_quantiles(df, [1 - test]).scalar()
    return df.withColumn("split", F.when(_at_or_before(cutoffs, 0), "train").otherwise("test"))


def _hash_interval(lowest: int, highest: int, n: int) -> tuple[int, int]:
    """Where the given ranks of ``n`` evenly spread 60-bit hashes nearly surely lie."""
    spread = 6 * math.sqrt(n) + 6
    top = 1 << 60
    low = int(top * max(0.0, (lowest - spread) / n))
    high = int(top * min(1.0, (highest + spread) / n))
    return low, high


def cap_rows(df: DataFrame, n: int, keys: Sequence[str] = KEYS, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows in repeatable random order, or all rows if there are fewer.

    Finds the n-th smallest row hash and filters by it: no row is sorted or moved.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    h = row_hash(keys, seed)
    _, found = order_statistics(
        df, {"h": h}, lambda _, size: [[n - 1]] if size > n else [], "long", guess=_hash_interval
    )
    return df.filter(h <= F.lit(found["h"][n - 1])) if found["h"] else df


def _part_ends(n: int, fractions: Sequence[float]) -> list[int]:
    """Rows before each inner boundary, rounded half up."""
    return [math.floor(n * sum(fractions[: i + 1]) + 0.5) for i in range(len(fractions) - 1)]


def stratified_split(
    df: DataFrame,
    label: str,
    fractions: Sequence[float] = (0.70, 0.15, 0.15),
    names: Sequence[str] = ("train", "val", "test"),
    keys: Sequence[str] = KEYS,
    seed: int = SEED,
    out: str = "split",
    hashed: str | None = None,
) -> DataFrame:
    """Random split with exact counts in every class.

    Each class is cut at exact ranks of its row hashes; a class that holds nearly
    all rows is neither sorted nor gathered. ``hashed`` names a stored column of
    ``row_hash(keys, seed)``, which saves hashing the rows in every pass; it is dropped.
    """
    classes = sorted(r[0] for r in df.select(label).distinct().collect())
    h = F.col(hashed) if hashed else row_hash(keys, seed)
    slots = {str(c): F.when(F.col(label) == F.lit(c), h) for c in classes}
    ends: dict[str, list[int]] = {}

    def wanted(name: str, n: int):
        ends[name] = _part_ends(n, fractions)
        return [[e - 1] for e in ends[name] if e > 0]

    _, found = order_statistics(df, slots, wanted, "long", guess=_hash_interval)
    part = F.lit(names[-1])
    for c in classes:
        inner = F.lit(names[-1])
        for i in reversed(range(len(fractions) - 1)):
            end = ends.get(str(c), [0] * len(fractions))[i]
            if end > 0:
                inner = F.when(h <= F.lit(found[str(c)][end - 1]), names[i]).otherwise(inner)
        part = F.when(F.col(label) == F.lit(c), inner).otherwise(part)
    split = df.withColumn(out, part)
    return split.drop(hashed) if hashed else split
