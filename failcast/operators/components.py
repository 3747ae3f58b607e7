"""Principal components of vectors of any width by a randomized range finder.

A block of directions is multiplied by the data's covariance, without forming it: each task adds up
``x (x - mean)'Q`` over its rows, and the sums meet per feature. Orthonormalised again and again, the block turns
to the leading components; it is widened until the components without the last ``EXTRA`` hold the wanted share
of variance. Then the rows' coordinates are decomposed by a tree of QR factorisations, a few rows per task,
which gives the components exactly within the block. Vectors up to ``NARROW`` wide need no search: the
block is all directions.

Nothing grows with the square of the width. Sparse vectors stay sparse.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.schema import SEED

#: Directions at first, and those kept beyond the components in use.
FIRST, EXTRA = 32, 8
NARROW = 96
#: Numbers in a block of directions: it goes to every task and comes back to the driver.
NUMBERS = 1 << 25
#: Passes over the data to settle a block, and the angle between two passes at which it has settled.
PASSES, ANGLE = 40, 1e-8
#: Numbers worked on at once.
_AT_ONCE = 1 << 20
_TREE = 32


class Rows:
    """Vectors of an Arrow batch: dense ones as a matrix, sparse ones as entries."""

    def __init__(self, vectors: pa.StructArray) -> None:
        kind = vectors.field("type").to_numpy(zero_copy_only=False)
        lists = vectors.field("values")
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        values, first = lists.flatten().to_numpy(), np.cumsum(sizes) - sizes
        self.count = len(kind)
        self.dense = np.flatnonzero(kind == 1)
        if len(self.dense) == self.count:
            self.matrix = values.reshape(self.count, -1) if self.count else np.zeros((0, 0))
        else:
            width = int(sizes[self.dense[0]]) if len(self.dense) else 0
            self.matrix = values[first[self.dense][:, None] + np.arange(width)]
        self.sparse = np.flatnonzero((kind == 0) & (sizes > 0))
        inside = np.repeat(first[self.sparse], sizes[self.sparse])
        own = np.cumsum(sizes[self.sparse]) - sizes[self.sparse]
        inside += np.arange(len(inside)) - np.repeat(own, sizes[self.sparse])
        self.values = values[inside]
        # Only sparse vectors have indices, in the same order.
        self.places = vectors.field("indices").flatten().to_numpy().astype(np.int64)
        self.owners = np.repeat(self.sparse, sizes[self.sparse])

    def pieces(self, width: int) -> Iterator[slice]:
        step = max(1, _AT_ONCE // max(1, width))
        for at in range(0, len(self.values), step):
            yield slice(at, at + step)

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """Products of all rows with ``matrix``."""
        out = np.zeros((self.count, matrix.shape[1]))
        if len(self.dense):
            out[self.dense] = self.matrix @ matrix
        for s in self.pieces(matrix.shape[1]):
            _add_runs(out, self.owners[s], self.values[s, None] * matrix[self.places[s]])
        return out

    def add_transposed(self, out: np.ndarray, factors: np.ndarray) -> None:
        """Adds the transposed rows' product with ``factors``, a row per vector, to ``out``."""
        if len(self.dense):
            out += self.matrix.T @ factors[self.dense]
        for s in self.pieces(factors.shape[1]):
            order = np.argsort(self.places[s], kind="stable")
            terms = self.values[s, None] * factors[self.owners[s]]
            _add_runs(out, self.places[s][order], terms[order])


def _add_runs(out: np.ndarray, places: np.ndarray, terms: np.ndarray) -> None:
    """Adds terms of equal places, which stand together, to their rows of ``out``."""
    heads = np.flatnonzero(np.diff(places, prepend=-1))
    out[places[heads]] += np.add.reduceat(terms, heads, axis=0)


def vector_parts(column: str):
    """A vector column as the struct that Arrow carries: type, size, indices, values."""
    return F.unwrap_udt(F.col(column)).alias("v")


def _few_tasks(df: DataFrame) -> DataFrame:
    """No more tasks than run at once, so that no more partial sums than that are moved."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def covariance_times(df: DataFrame, column: str, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Sum over all rows of (x - mean)(x - mean)'block, without the covariance."""
    shared = df.sparkSession.sparkContext.broadcast((block, mean @ block))
    width, size = block.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, level = shared.value
        total, rest = np.zeros((width + 1, size)), np.zeros(size)
        for batch in batches:
            rows = Rows(batch.column(0))
            own = rows.times(block) - level
            rows.add_transposed(total[:-1], own)
            rest += own.sum(0)
        # The last row holds the sums of the coordinates themselves.
        total[-1] = rest
        some = np.flatnonzero(total.any(1))
        for at in range(0, len(some), 1024):
            part = some[at : at + 1024]
            offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * size)
            sums = pa.ListArray.from_arrays(offsets, pa.array(total[part].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), sums], names=["feature", "s"])

    parts = _few_tasks(df.select(vector_parts(column))).mapInArrow(add, "feature int, s array<double>")
    summed = parts.groupBy("feature").agg(Summarizer.sum(array_to_vector("s")).alias("s"))
    found = summed.select("feature", F.unwrap_udt("s")["values"].alias("s")).toArrow().combine_chunks()
    out = np.zeros((width + 1, size))
    if len(found):
        sums = pa.concat_arrays(found.column("s").chunks)
        out[found.column("feature").to_numpy()] = sums.flatten().to_numpy().reshape(-1, size)
    return out[:-1] - np.outer(mean, out[-1])


def components_for(shares: Sequence[float], target: float) -> int:
    """Fewest components whose cumulative share of variance exceeds ``target``."""
    total = np.cumsum(np.asarray(shares, dtype=float))
    return int(min(len(total), np.searchsorted(total, target, side="right") + 1))


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def qr_triangle(df: DataFrame, column: str, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of the rows' coordinates (x - mean)'block, by a tree."""
    shared = df.sparkSession.sparkContext.broadcast((block, mean @ block))
    size = block.shape[1]

    def rows_of(r: np.ndarray, group: int) -> pa.RecordBatch:
        offsets = pa.array(np.arange(len(r) + 1, dtype=np.int32) * size)
        lists = pa.ListArray.from_arrays(offsets, pa.array(r.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(r), group, np.int32)), lists], names=["g", "r"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, level = shared.value
        r = np.zeros((0, size))
        for batch in batches:
            own = Rows(batch.column(0)).times(block) - level
            r = _triangle(np.concatenate([r, own])) if len(own) else r
        if len(r):
            yield rows_of(r, TaskContext.get().partitionId() % _TREE)

    def join(rows: pa.Table) -> pa.Table:
        lists = pa.concat_arrays(rows.column("r").chunks)
        r = _triangle(lists.flatten().to_numpy().reshape(-1, size))
        return pa.Table.from_batches([rows_of(r, 0)])

    first = _few_tasks(df.select(vector_parts(column))).mapInArrow(reduce, "g int, r array<double>")
    met = first.groupBy("g").applyInArrow(join, "g int, r array<double>").toArrow()
    lists = pa.concat_arrays(met.column("r").chunks) if met.num_rows else pa.array([], pa.list_(pa.float64()))
    return _triangle(lists.flatten().to_numpy().reshape(-1, size)) if met.num_rows else np.zeros((1, size))


def _angle(before: np.ndarray, now: np.ndarray) -> float:
    """Sine of the largest angle from the directions ``before`` to the space of ``now``."""
    return float(np.linalg.norm(before - now @ (now.T @ before), 2)) if before.size else 0.0


def principal_components(
    df: DataFrame, column: str, variance: float, seed: int = SEED, narrow: int = NARROW, first: int = FIRST, numbers: int = NUMBERS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions (a column each), the rows' mean, and shares of variance, largest first.

    As many components as hold more than ``variance`` of it; all where none can be left out. ``df`` is
    read several times, so pass a stored table. Raises an error if so many would be needed that the
    block of directions has more than ``numbers`` numbers.
    """
    summary = df.select(Summarizer.metrics("count", "mean", "variance").summary(F.col(column)).alias("s"))
    row = summary.select("s.count", "s.mean", "s.variance").first()
    count, mean, each = row[0], row[1].toArray(), row[2].toArray()
    width, total = len(mean), float(each.sum())
    if not total or count < 2:
        return np.eye(width, 1), mean, np.ones(1)
    rng = np.random.default_rng(seed)
    block = np.eye(width) if width <= narrow else _widened(np.zeros((width, 0)), first + EXTRA, rng, numbers)
    passes = 0
    before = np.zeros((width, 0))
    while block.shape[1] < width:
        product = covariance_times(df, column, mean, block) / (count - 1)
        # Variance along the block's own leading directions.
        values, turn = np.linalg.eigh(block.T @ product)
        held = np.cumsum(values[::-1]) / total
        now = np.linalg.qr(product @ turn[:, ::-1])[0]
        passes += 1
        use = int(np.searchsorted(held, variance, side="right") + 1)
        if use > block.shape[1] - EXTRA:
            if passes >= 3:
                block = _widened(now, min(width, 2 * block.shape[1]), rng, numbers)
                before, passes = np.zeros((width, 0)), 0
                continue
        elif before.shape[1] >= use and _angle(before[:, :use], now) < ANGLE or passes >= PASSES:
            block = now
            break
        block = before = now
    r = qr_triangle(df, column, mean, block)
    _, scale, turned = np.linalg.svd(r, full_matrices=False)
    shares = scale**2 / (count - 1) / total
    k = components_for(shares, variance)
    directions = block @ turned[:k].T
    # The largest loading of each is positive.
    signs = np.sign(directions[np.abs(directions).argmax(0), np.arange(k)])
    return directions * np.where(signs == 0, 1, signs), mean, shares[:k]


def _widened(block: np.ndarray, size: int, rng: np.random.Generator, numbers: int) -> np.ndarray:
    """``size`` orthonormal directions that begin with those of ``block``; all axes if that is every one."""
    width = len(block)
    if size * width > numbers:
        raise ValueError(f"More than {block.shape[1]} components of {width} features are needed; ask for less variance")
    if size >= width:
        return np.eye(width)
    return np.linalg.qr(np.concatenate([block, rng.normal(size=(width, size - block.shape[1]))], axis=1))[0]


class Projection(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Multiply a vector column by a fixed matrix and take an offset away, in Arrow batches."""

    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "projected column", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "number of components", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "matrix by rows", TypeConverters.toListFloat)
    offset = Param(Params._dummy(), "offset", "taken from each component", TypeConverters.toListFloat)

    def __init__(self, inputCol=None, outputCol=None, matrix=None, offset=None):
        super().__init__()
        if matrix is not None:
            self._set(
                inputCol=inputCol,
                outputCol=outputCol,
                width=matrix.shape[1],
                weights=matrix.ravel().tolist(),
                offset=[0.0] * matrix.shape[1] if offset is None else np.asarray(offset).tolist(),
            )

    def _transform(self, df: DataFrame) -> DataFrame:
        width = self.getOrDefault(self.width)
        matrix = np.asarray(self.getOrDefault(self.weights)).reshape(-1, width)
        offset = np.asarray(self.getOrDefault(self.offset))
        shared = df.sparkSession.sparkContext.broadcast((matrix, offset))

        @F.arrow_udf("array<double>")
        def project(vectors: pa.Array) -> pa.Array:
            matrix, offset = shared.value
            found = Rows(vectors).times(matrix) - offset
            return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * width), pa.array(found.ravel()))

        source = F.unwrap_udt(F.col(self.getOrDefault(self.inputCol)))
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(project(source)))
