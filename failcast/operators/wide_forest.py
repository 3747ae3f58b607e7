"""Random forests on rows with very many features that are mostly 0, such as a feature per machine.

Spark's tree learner keeps a number per row and feature. Here rows stay sparse and are stored once with their bags;
a level of all trees takes one pass that counts, for the features that a node has drawn, only values other than 0.
What a node has at 0 is the rest of its rows. Counts are summed by a shuffle and splits are chosen in groups of nodes, so
a task holds a batch of rows and the counts of its nodes, and the driver the trees.

The forest is that of Spark's learner otherwise: Poisson bags, features drawn per node, Gini impurity, up to 32 bins a
feature whose limits come from a bounded sample (a feature of one value besides 0 needs none), class weights.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.operators.bagging import bag_counts, bag_sizes
from failcast.operators.components import Rows, vector_parts
from failcast.schema import KEYS, SEED
from failcast.sources.storage import stored

#: Features from which on rows are counted sparsely.
WIDE = 4096
BINS = 32
#: Rows, about, that limits of bins are taken from.
SAMPLE_ROWS = 20_000
#: Drawn features of the nodes of one pass.
DRAWN_AT_ONCE = 1 << 22
_ROWS_AT_ONCE = 2048
_CODES_AT_ONCE = 1 << 20
_NODES_A_GROUP = 16


@dataclass
class _Trees:
    """A row per node of all trees; a leaf is its own child."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    #: Rows of the bag by class.
    counts: np.ndarray

    def place(self, chunk: _Chunk, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Nodes in which ``rows`` end that start at nodes ``at``."""
        while len(at):
            value = chunk.x[rows, chunk.column[self.feature[at]]]
            down = np.where(value <= self.limit[at], self.left[at], self.right[at])
            if (down == at).all():
                break
            at = down
        return at


class _Chunk:
    """Some rows as a matrix of the features that any of them has; column 0 stands for all others."""

    def __init__(self, vectors: pa.StructArray, width: int) -> None:
        rows = Rows(vectors)
        owners, places, values = rows.owners, rows.places, rows.values
        if len(rows.dense):
            r, c = np.nonzero(rows.matrix)
            owners, places = np.concatenate([owners, rows.dense[r]]), np.concatenate([places, c])
            values = np.concatenate([values, rows.matrix[r, c]])
        self.features = np.unique(places)
        self.column = np.zeros(width, np.int64)
        self.column[self.features] = np.arange(1, len(self.features) + 1)
        self.x = np.zeros((rows.count, len(self.features) + 1))
        self.x[owners, self.column[places]] = values


def _chunks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, _Chunk]]:
    for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
        # A copy: parts of a slice would start at the batch's first row.
        part = batch.take(pa.array(range(at, min(at + _ROWS_AT_ONCE, batch.num_rows))))
        yield part, _Chunk(part.column("features"), width)


# --- limits of bins ------------------------------------------------------------


def _cuts(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Up to ``BINS`` - 1 limits between distinct sorted values, near equal shares of the rows."""
    if len(values) > BINS:
        upto = np.cumsum(counts)
        wanted = upto[-1] * np.arange(1, BINS) / BINS
        after = np.searchsorted(upto, wanted)
        lower = np.maximum(after - 1, 0)
        near = np.where(wanted - upto[lower] < upto[after] - wanted, lower, after)
        ends = np.unique(np.minimum(near, len(values) - 2))
    else:
        ends = np.arange(len(values) - 1)
    return (values[ends] + values[ends + 1]) / 2


def _bounds(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Limits of all features' bins: where each feature's limits start, and the limits."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, n = np.full(width, np.inf), np.full(width, -np.inf), np.zeros(width, np.int64)
        for batch in batches:
            for _, chunk in _chunks(batch, width):
                x, f = chunk.x[:, 1:], chunk.features
                low[f] = np.minimum(low[f], np.where(x != 0, x, np.inf).min(0))
                high[f] = np.maximum(high[f], np.where(x != 0, x, -np.inf).max(0))
                n[f] += (x != 0).sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(low[some]), pa.array(high[some]), pa.array(n[some])], ["feature", "low", "high", "n"]
        )

    vectors = rows.select(vector_parts("features").alias("features"))
    found = vectors.mapInArrow(extremes, "feature long, low double, high double, n long").groupBy("feature").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")
    ).toArrow()
    total = rows.count()
    at, low, high, n = (found.column(c).to_numpy() for c in ("feature", "low", "high", "n"))
    low, high = np.where(n < total, np.minimum(low, 0), low), np.where(n < total, np.maximum(high, 0), high)
    # Limits between two values; features of more are looked up in the sample.
    plain = (low == 0) | (high == 0)
    one = found.column("low").to_numpy() == found.column("high").to_numpy()
    middle = {int(f): [(a + b) / 2] if a < b else [] for f, a, b in zip(at, low, high, strict=True)}
    more = at[~(one & plain) & (low < high)]

    def cuts(sampled: DataFrame) -> Mapping[int, Sequence[float]]:
        wanted = np.zeros(width, bool)
        wanted[more] = True

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, chunk in _chunks(batch, width):
                    r, c = np.nonzero(chunk.x[:, 1:])
                    some = wanted[chunk.features[c]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(chunk.features[c[some]]), pa.array(chunk.x[r[some], c[some] + 1])], ["feature", "value"]
                    )

        size = sampled.count()

        def limits(table: pa.Table) -> pa.Table:
            values, counts = np.unique(table.column("value").to_numpy(), return_counts=True)
            zeros = size - counts.sum()
            if zeros:
                place = np.searchsorted(values, 0.0)
                values, counts = np.insert(values, place, 0.0), np.insert(counts, place, zeros)
            return pa.table({"feature": table.column("feature")[:1], "limits": pa.array([_cuts(values, counts).tolist()])})

        pairs = sampled.mapInArrow(entries, "feature long, value double")
        rows = pairs.groupBy("feature").applyInArrow(limits, "feature long, limits array<double>").collect()
        return {r["feature"]: r["limits"] for r in rows if r["limits"]}

    if len(more):
        sampled = vectors.sample(False, min(1.0, SAMPLE_ROWS / total), SEED) if total > SAMPLE_ROWS else vectors
        middle |= cuts(sampled)
    lists = [middle.get(f, []) for f in range(width)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return starts, np.array([v for x in lists for v in x], dtype=float)


# --- counting ------------------------------------------------------------------


def _bins(features: np.ndarray, values: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Bin of each value: the number of its feature's limits below it."""
    sizes = starts[features + 1] - starts[features]
    out = np.zeros(len(features), np.int64)
    one = sizes == 1
    out[one] = values[one] > limits[starts[features[one]]]
    for f in np.unique(features[sizes > 1]):
        mine = features == f
        out[mine] = np.searchsorted(limits[starts[f] : starts[f + 1]], values[mine], side="left")
    return out


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)


def _count(rows: DataFrame, trees: _Trees, roots: np.ndarray, active: np.ndarray, drawn: np.ndarray, bounds, classes: int) -> DataFrame:
    """Rows of each active node by drawn feature, bin and class, values of 0 left out: ``code`` and ``n``."""
    width = len(bounds[0]) - 1
    number = np.full(len(trees.feature), -1, np.int64)
    number[active] = np.arange(len(active))
    order = np.argsort(drawn, axis=None, kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast(
        (trees, roots, number, drawn.ravel()[order], order // drawn.shape[1], bounds)
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, roots, number, features, owners, (starts, limits) = shared.value
        codes, counts, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            for part, chunk in _chunks(batch, width):
                times = part.column("_bags").flatten().to_numpy().reshape(part.num_rows, -1)
                label = part.column("_label").to_numpy()
                row, tree = np.nonzero(times)
                node = number[trees.place(chunk, row, roots[tree])]
                row, tree, node = (v[node >= 0] for v in (row, tree, node))
                # Features of the chunk that each node has drawn, in a run per node.
                low, high = (np.searchsorted(features, chunk.features, side=s) for s in ("left", "right"))
                taken = high - low
                inside = np.repeat(low - np.cumsum(taken) + taken, taken) + np.arange(taken.sum())
                column, by = np.repeat(np.arange(1, len(taken) + 1), taken), owners[inside]
                runs = np.argsort(by, kind="stable")
                column, by = column[runs], by[runs]
                first, last = (np.searchsorted(by, node, side=s) for s in ("left", "right"))
                many = last - first
                pair = np.repeat(np.arange(len(node)), many)
                seen = column[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
                value = chunk.x[row[pair], seen]
                pair, seen, value = (v[value != 0] for v in (pair, seen, value))
                feature = chunk.features[seen - 1]
                cell = (node[pair] * width + feature) * BINS + _bins(feature, value, starts, limits)
                codes.append(cell * classes + label[row[pair]])
                counts.append(times[row[pair], tree[pair]].astype(np.int64))
                size += len(pair)
                if size > _CODES_AT_ONCE:
                    code, n = _merged(codes, counts)
                    codes, counts, size = [code], [n], 0
                    if len(code) > _CODES_AT_ONCE // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])
                        codes, counts = [code[:0]], [n[:0]]
        code, n = _merged(codes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    return rows.mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _gini(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Impurity and weight of weighted class counts along the last axis."""
    weight = counts.sum(-1)
    share = np.divide(counts, weight[..., None], out=np.zeros_like(counts), where=weight[..., None] > 0)
    return 1 - (share**2).sum(-1), weight


def _best_splits(counted: DataFrame, totals: np.ndarray, class_weights: np.ndarray, bounds, least: int) -> pa.Table:
    """Best split of each active node that has one that gains: node, feature, bin, and the rows that go left."""
    width, classes = len(bounds[0]) - 1, totals.shape[1]
    shared = counted.sparkSession.sparkContext.broadcast((totals, bounds))
    schema = "node long, feature long, bin long, lefts array<long>"

    def best(table: pa.Table) -> pa.Table:
        totals, (starts, limits) = shared.value
        cell, label = np.divmod(table.column("code").to_numpy(), classes)
        pair, place = np.divmod(cell, BINS)
        pairs, at = np.unique(pair, return_inverse=True)
        node, feature = np.divmod(pairs, width)
        found = np.zeros((len(pairs), BINS, classes), np.int64)
        found[at, place, label] = table.column("n").to_numpy()
        zero = _bins(feature, np.zeros(len(feature)), starts, limits)
        found[np.arange(len(pairs)), zero] += totals[node] - found.sum(1)
        left = np.cumsum(found, axis=1)[:, :-1]
        right = totals[node][:, None] - left
        (a, wa), (b, wb) = _gini(left * class_weights), _gini(right * class_weights)
        whole, w = _gini(totals[node] * class_weights)
        gain = whole[:, None] - (wa * a + wb * b) / np.maximum(w, np.finfo(float).tiny)[:, None]
        open_ = np.arange(BINS - 1) < (starts[feature + 1] - starts[feature])[:, None]
        gain[~open_ | (left.sum(-1) < least) | (right.sum(-1) < least)] = -np.inf
        cut = gain.argmax(1)
        gain = gain[np.arange(len(pairs)), cut]
        # The first of equal gains, in the order of features.
        order = np.lexsort((feature, -gain, node))
        heads = order[np.flatnonzero(np.diff(node[order], prepend=-1))]
        heads = heads[gain[heads] > 1e-15]
        lefts = left[heads, cut[heads]]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(heads) + 1, dtype=np.int32) * classes), pa.array(lefts.ravel()))
        return pa.table([pa.array(node[heads]), pa.array(feature[heads]), pa.array(cut[heads]), lists], ["node", "feature", "bin", "lefts"])

    group = F.expr(f"code div {_NODES_A_GROUP * width * BINS * classes}").alias("part")
    return counted.groupBy(group).applyInArrow(best, schema).toArrow().sort_by("node")


# --- fit -----------------------------------------------------------------------


def _drawn_share(share: str | float, width: int) -> int:
    """Features that a node draws."""
    if share in ("sqrt", "auto"):
        return max(1, int(np.ceil(np.sqrt(width))))
    if share == "log2":
        return max(1, int(np.ceil(np.log2(width))))
    return width if share == "all" else max(1, int(np.ceil(float(share) * width)))


def fit_wide_forest(
    train: DataFrame,
    trees: int,
    depth: int,
    least: int = 1,
    share: str | float = "sqrt",
    label: str = "label",
    class_weights: Mapping[int, float] | None = None,
    keys: Sequence[str] = KEYS,
    seed: int = SEED,
) -> WideForestModel:
    """Forest on the vectors ``features``; bags are drawn by ``keys``, or by label and features without these columns."""
    if not set(keys) <= set(train.columns):
        train, keys = train.withColumn("_row", F.xxhash64(label, vector_parts("features"))), ["_row"]
    width = len(train.select("features").first()[0])
    # Bags of all trees, drawn once.
    rows = stored(
        train.select(F.col(label).cast("long").alias("_label"), "features", bag_counts(trees, keys, seed).alias("_bags"))
    )
    sizes = bag_sizes(rows, "_label", trees, counts="_bags")
    classes = max(2, int(max(c for _, c in sizes)) + 1)
    factors = np.array([float((class_weights or {}).get(c, 1.0)) for c in range(classes)])
    bounds = _bounds(rows, width)
    shipped = rows.select("_label", vector_parts("features").alias("features"), "_bags")
    counts = np.array([[sizes.get((t, c), 0) or 0 for c in range(classes)] for t in range(trees)], np.int64)
    roots = np.arange(trees)
    forest = _Trees(np.zeros(trees, np.int64), np.full(trees, np.inf), roots.copy(), roots.copy(), counts)
    draw, rng = _drawn_share(share, width), np.random.default_rng(seed)
    active = roots
    for _ in range(depth):
        impure = _gini(forest.counts[active] * factors)[0] > 1e-15
        active = active[impure & (forest.counts[active].sum(1) >= 2 * least)]
        step, made = max(1, DRAWN_AT_ONCE // draw), []
        grown = forest
        for at in range(0, len(active), step):
            some = active[at : at + step]
            drawn = np.stack([rng.choice(width, draw, replace=False, shuffle=False) for _ in some])
            counted = _count(shipped, forest, roots, some, drawn, bounds, classes)
            best = _best_splits(counted, forest.counts[some], factors, bounds, least)
            grown, new = _grow(grown, some, best, bounds)
            made.append(new)
        forest, active = grown, np.concatenate(made) if made else active[:0]
        if not len(active):
            break
    return WideForestModel.of(forest, trees, width, factors)


def _grow(forest: _Trees, active: np.ndarray, best: pa.Table, bounds) -> tuple[_Trees, np.ndarray]:
    """The forest with the best splits made, and the new nodes."""
    starts, limits = bounds
    n, size = best.num_rows, len(forest.feature)
    new = np.arange(size, size + 2 * n)
    if not n:
        return forest, new
    node, feature = active[best.column("node").to_numpy()], best.column("feature").to_numpy()
    lefts = best.column("lefts").combine_chunks().flatten().to_numpy().reshape(n, -1)
    out = _Trees(
        np.concatenate([forest.feature, np.zeros(2 * n, np.int64)]),
        np.concatenate([forest.limit, np.full(2 * n, np.inf)]),
        np.concatenate([forest.left, new]),
        np.concatenate([forest.right, new]),
        np.concatenate([forest.counts, lefts, forest.counts[node] - lefts]),
    )
    out.feature[node] = feature
    out.limit[node] = limits[starts[feature] + best.column("bin").to_numpy()]
    out.left[node], out.right[node] = new[:n], new[n:]
    return out, new


class WideForestModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Forest by ``fit_wide_forest``; adds the columns that Spark's classifiers add."""

    trees = Param(Params._dummy(), "trees", "number of trees; their roots are the first nodes", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "entries of a vector", TypeConverters.toInt)
    feature = Param(Params._dummy(), "feature", "feature that a node splits on", TypeConverters.toListInt)
    limit = Param(Params._dummy(), "limit", "largest value that goes left", TypeConverters.toListFloat)
    left = Param(Params._dummy(), "left", "left child; a leaf is its own", TypeConverters.toListInt)
    right = Param(Params._dummy(), "right", "right child; a leaf is its own", TypeConverters.toListInt)
    votes = Param(Params._dummy(), "votes", "class shares of all nodes, node by node", TypeConverters.toListFloat)

    @classmethod
    def of(cls, forest: _Trees, trees: int, width: int, factors: np.ndarray) -> WideForestModel:
        weighted = forest.counts * factors
        total = weighted.sum(1, keepdims=True)
        votes = np.divide(weighted, total, out=np.zeros_like(weighted), where=total > 0)
        leaf = forest.left == np.arange(len(forest.left))
        # Nothing goes beyond a leaf, so its limit has no effect; JSON has no infinity.
        limit = np.where(leaf, 0.0, forest.limit)
        return cls()._set(
            trees=trees, width=width, feature=forest.feature.tolist(), limit=limit.tolist(),
            left=forest.left.tolist(), right=forest.right.tolist(), votes=votes.ravel().tolist(),
        )

    def _transform(self, df: DataFrame) -> DataFrame:
        feature, left, right = (np.array(self.getOrDefault(p), np.int64) for p in (self.feature, self.left, self.right))
        votes = np.array(self.getOrDefault(self.votes)).reshape(len(feature), -1)
        trees, width = self.getOrDefault(self.trees), self.getOrDefault(self.width)
        forest = _Trees(feature, np.array(self.getOrDefault(self.limit)), left, right, votes)
        shared = df.sparkSession.sparkContext.broadcast(forest)

        @F.arrow_udf("array<double>")
        def voted(vectors: pa.Array) -> pa.Array:
            forest, out = shared.value, []
            for part, chunk in _chunks(pa.RecordBatch.from_arrays([vectors], ["features"]), width):
                n = part.num_rows
                ends = forest.place(chunk, np.repeat(np.arange(n), trees), np.tile(np.arange(trees), n)).reshape(n, trees)
                out.append(functools.reduce(np.add, [forest.counts[ends[:, t]] for t in range(trees)]))
            sums = np.concatenate(out) if out else np.zeros((0, forest.counts.shape[1]))
            offsets = np.arange(len(sums) + 1, dtype=np.int32) * forest.counts.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))

        sums = F.col("_votes")
        total = F.greatest(F.aggregate(sums, F.lit(0.0), lambda a, v: a + v), F.lit(1e-300))
        return df.withColumn("_votes", voted(vector_parts("features"))).withColumns({
            "rawPrediction": array_to_vector(sums),
            "probability": array_to_vector(F.transform(sums, lambda v: v / total)),
            "prediction": (F.array_position(sums, F.array_max(sums)) - 1).cast("double"),
        }).drop("_votes")
