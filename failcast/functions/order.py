"""Exact ranks and running totals without a one-task sort.

``running_totals`` gives prefix sums over a globally ordered column. Rows go to
value ranges taken from a quantile sketch, every range is summed by its own
task, and the ranges' totals (a few numbers each) are added in front.

``order_statistics`` finds exact values at given ranks by narrowing: a sketch
gives an interval around each rank, one counting pass proves that the rank is
inside, and only the few values of that interval are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = 32
SKETCH_ACCURACY = 10_000
# Sketches that only bracket ranks may be coarse: narrowing makes up for it, and they are small where they meet.
BRACKET_ACCURACY = 1_000
# Values per interval that one task may sort in the last narrowing step.
RANK_LIMIT = 20_000


def _range_count(df: DataFrame) -> int:
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(1024, shuffles))


def _range_of(value: Column, chunks: Column) -> Column:
    """Number of boundaries below ``value``; two short scans instead of one long one."""
    chunk = F.size(F.filter(chunks, lambda c: F.element_at(c, 1) < value))
    inner = F.size(F.filter(F.get(chunks, chunk - 1), lambda b: b < value))
    return F.when(chunk == 0, F.lit(0)).otherwise((chunk - 1) * _CHUNK + inner)


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    prefix: str = "run_",
    total_prefix: str = "all_",
    ranges: int | None = None,
) -> DataFrame:
    """Add ``run_<c>``, the inclusive running sum, and ``all_<c>``, the group total.

    ``df`` holds one row per (``by``, ``order``) with non-negative ``sums``, so a
    value that fills a third of the data is one row here. ``by`` must not be null
    and have few values (tasks, models, repeats).
    """
    n = max(2, ranges or _range_count(df))
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))

    # The condition holds for every row. It makes this branch read all sums, so
    # that Spark sees the same exchange in each branch and runs it only once.
    whole = F.lit(True)
    for c in sums:
        whole = whole & (F.col(c) >= 0)
    steps = [i / n for i in range(1, n)]
    bounds = rows.groupBy(*keys).agg(
        F.percentile_approx(F.when(whole, F.col(order)), steps, SKETCH_ACCURACY).alias("_bounds")
    )
    chunked = [F.slice("_bounds", i + 1, _CHUNK) for i in range(0, len(steps), _CHUNK)]
    bounds = bounds.select(*keys, F.array(*chunked).alias("_chunks"))

    # One row of boundaries per group: small whatever the size of the data.
    placed = rows.join(F.broadcast(bounds), keys).withColumn(
        "_range", _range_of(F.col(order), F.col("_chunks"))
    ).drop("_chunks")

    group = Window.partitionBy(*keys)
    earlier = group.orderBy(F.col("_range").desc() if descending else F.col("_range").asc())
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    offsets = totals.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(group).alias(f"{total_prefix}{c}") for c in sums],
    )

    inside = Window.partitionBy(*keys, "_range").orderBy(
        F.col(order).desc() if descending else F.col(order).asc()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # At most 1024 ranges per group.
    out = placed.join(F.broadcast(offsets), [*keys, "_range"])
    return out.select(
        *df.columns,
        *[(F.col(f"_off_{c}") + F.sum(c).over(inside)).alias(f"{prefix}{c}") for c in sums],
        *[F.col(f"{total_prefix}{c}") for c in sums],
    )


class _Search:
    """Ranks sought in one column, and the value interval known to hold them."""

    def __init__(self, column: int, ranks: Sequence[int], held: int):
        self.column = column
        self.ranks = list(ranks)
        self.low = self.high = None
        self.below = 0
        self.held = held

    def inside(self) -> Column:
        v = F.col(f"v{self.column}")
        if self.low is None:
            return v
        return F.when((v >= F.lit(self.low)) & (v <= F.lit(self.high)), v)


def order_statistics(
    df: DataFrame,
    columns: dict[str, Column],
    wanted: Callable[[str, int], Sequence[Sequence[int]]],
    dtype: str = "double",
    limit: int = RANK_LIMIT,
    accuracy: int = BRACKET_ACCURACY,
    guess: Callable[[int, int, int], tuple[float, float]] | None = None,
) -> tuple[dict[str, int], dict[str, dict[int, float | int]]]:
    """Non-null counts and exact values at 0-based ranks.

    ``wanted(name, n)`` lists groups of neighbouring ranks for a column with ``n``
    non-null values. ``guess(lowest, highest, n)`` may give an interval likely to
    hold the ranks, which saves the sketch. ``df`` is read two to four times, so
    pass a stored table. Only counts, interval ends and answers reach the driver.
    """
    names = list(columns)
    data = df.select(*[columns[c].cast(dtype).alias(f"v{i}") for i, c in enumerate(names)])
    head = data.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))]).first()
    sizes = {c: head[i] for i, c in enumerate(names)}

    done, wide, rest = [], [], []
    for i, c in enumerate(names):
        groups = [list(g) for g in wanted(c, sizes[c]) if len(g)] if sizes[c] else []
        if groups and sizes[c] <= limit:
            done.append(_Search(i, sorted({r for g in groups for r in g}), sizes[c]))
        else:
            wide += [_Search(i, g, sizes[c]) for g in groups]

    answers: dict[str, dict[int, float | int]] = {c: {} for c in names}

    def settle(searches: list[_Search], trials: list[tuple]) -> tuple[list, list]:
        """Prove the trial intervals; returns searches to narrow further and hopeless ones."""
        open_, stuck = [], []
        for s, t in _prove(data, searches, trials):
            if t is None or (t.held >= s.held and t.low != t.high):
                stuck.append(s)
            elif t.low == t.high:
                answers[names[t.column]].update({r: t.low for r in t.ranks})
            elif t.held <= limit:
                done.append(t)
            else:
                open_.append(t)
        return open_, stuck

    if wide and guess is not None:
        open_, stuck = settle(wide, [guess(min(s.ranks), max(s.ranks), s.held) for s in wide])
        wide = open_ + stuck
    while wide:
        # Where a sketch cannot shrink the interval, all of it is ranked: exact at any width.
        wide, stuck = settle(wide, _sketch(data, wide, accuracy))
        rest += stuck

    for search, values in zip(done, _picked(data, done) if done else ()):
        answers[names[search.column]].update(dict(zip(search.ranks, values)))
    for search in rest:
        answers[names[search.column]].update(_ranked(data, search))
    return sizes, answers


def _sketch(data: DataFrame, searches: Sequence[_Search], accuracy: int) -> list[tuple]:
    """One pass: approximate interval ends around the ranks of every search."""
    parts = []
    for s in searches:
        low = max(0.0, (min(s.ranks) - s.below) / s.held - 2.0 / accuracy)
        high = min(1.0, (max(s.ranks) + 1 - s.below) / s.held + 2.0 / accuracy)
        parts.append(F.percentile_approx(s.inside(), [low, high], accuracy))
    row = data.agg(*[p.alias(f"s{j}") for j, p in enumerate(parts)]).first()
    return [(row[j][0], row[j][1]) for j in range(len(searches))]


def _prove(data: DataFrame, searches: Sequence[_Search], trials: Sequence[tuple]):
    """One pass: each search with its trial interval, or with None if that misses a rank."""
    tried = []
    for s, (low, high) in zip(searches, trials):
        t = _Search(s.column, s.ranks, 0)
        t.low, t.high = low, high
        tried.append(t)
    row = data.agg(
        *[F.count_if(F.col(f"v{t.column}") < F.lit(t.low)).alias(f"b{j}") for j, t in enumerate(tried)],
        *[F.count(t.inside()).alias(f"c{j}") for j, t in enumerate(tried)],
    ).first()
    for j, (s, t) in enumerate(zip(searches, tried)):
        t.below, t.held = row[f"b{j}"], row[f"c{j}"]
        holds = t.below <= min(t.ranks) and max(t.ranks) < t.below + t.held
        yield s, (t if holds else None)


def _picked(data: DataFrame, searches: Sequence[_Search]) -> list[list]:
    """Values at the ranks of searches whose intervals were counted to be small."""
    sorted_ = data.agg(
        *[F.sort_array(F.collect_list(s.inside())).alias(f"a{j}") for j, s in enumerate(searches)]
    )
    row = sorted_.select(
        *[
            F.array(*[F.get(f"a{j}", F.lit(r - s.below)) for r in s.ranks]).alias(f"p{j}")
            for j, s in enumerate(searches)
        ]
    ).first()
    return [row[j] for j in range(len(searches))]


def _ranked(data: DataFrame, search: _Search) -> dict[int, float | int]:
    """Values at the ranks of a search of any width."""
    counted = (
        data.select(search.inside().alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    run = running_totals(counted, "value", ["n"]).select(
        "value", (F.col("run_n") - F.col("n") + search.below).alias("first"), (F.col("run_n") + search.below).alias("last")
    )
    hit = F.lit(False)
    for r in search.ranks:
        hit = hit | ((F.col("first") <= r) & (F.col("last") > r))
    rows = run.filter(hit).collect()
    return {r: x["value"] for r in search.ranks for x in rows if x["first"] <= r < x["last"]}


def _interpolated(ranks: dict[int, float], n: int, p: float) -> float:
    position = (n - 1) * p
    low, high = math.floor(position), math.ceil(position)
    if low == high:
        return ranks[low]
    return ranks[low] + (ranks[high] - ranks[low]) * (position - low)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], **options
) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles; None for a column without values."""

    def wanted(_: str, n: int):
        return [
            sorted({math.floor((n - 1) * p), math.ceil((n - 1) * p)}) for p in probs
        ]

    sizes, found = order_statistics(df, {c: F.col(c) for c in columns}, wanted, **options)
    return {
        c: [_interpolated(found[c], sizes[c], p) if sizes[c] else None for p in probs]
        for c in columns
    }
