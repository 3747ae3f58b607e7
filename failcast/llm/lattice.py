"""Embedding near-duplicates by E8 lattice hashing.

A table projects a unit vector onto ``blocks`` random spaces of eight dimensions and decodes each
projection to the nearest point of the lattice E8; the points together are its cell. A vector is
also put into the cells that differ in one block, where the point is one of the ``probes`` nearest
minimal neighbours. Vectors that share a cell of any table are compared by cosine in double
precision; only pairs at or above the threshold are linked.

A pair can share several cells. It counts in the smallest of them only, so no list of pairs has to
be made distinct, and none leaves a task: what leaves is each vector's number of links and a
spanning forest. Equal vectors are one row with a multiplicity; a large cell is compared in blocks.

Null and zero vectors and those with null or non-finite components link with nothing and stand
for themselves. Vectors of different length never link. Rows with the same id and vector are one
vector (each row gets its result). Of vectors at one cosine all are linked. An empty table gives no rows;
other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.llm.common import (
    BLOCK,
    components,
    deal,
    run_starts,
    sorted_runs,
    spanning_links,
    split_buckets,
)
from failcast.llm.winnow import mix
from failcast.sources.storage import stored


@dataclass(frozen=True)
class LatticeSettings:
    tables: int = 8
    blocks: int = 2
    probes: int = 6
    #: Length of a projected unit vector, in units of the lattice (minimal distance: root of 2).
    scale: float = 2.0
    threshold: float = 0.9
    block_rows: int = BLOCK


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled to be whole."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-2, 2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            found.append(v)
    found += [v for v in product((-1, 1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(found, np.int64)


MINIMAL = minimal_vectors()


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum."""
    near = np.rint(y)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    miss = (y - near)[odd]
    worst = np.abs(miss).argmax(1)
    step = np.where(miss[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    near[odd, worst] += step
    return near


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8, doubled: whole or half coordinates with an even sum."""
    whole = _nearest_even(y)
    half = _nearest_even(y - 0.5) + 0.5
    closer = ((y - half) ** 2).sum(1) < ((y - whole) ** 2).sum(1)
    return np.rint(2 * np.where(closer[:, None], half, whole)).astype(np.int64)


def _hash(points: np.ndarray, salt: int) -> np.ndarray:
    out = np.full(len(points), salt, np.uint64)
    for k in range(8):
        out = mix(out + points[:, k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


@functools.lru_cache(maxsize=16)
def _spaces(dims: int, settings: LatticeSettings) -> list[np.ndarray]:
    """Random projections of ``dims`` to eight dimensions, the same in every task."""
    rng = np.random.default_rng(dims)
    n = settings.tables * settings.blocks
    return [rng.normal(size=(dims, 8)) * (settings.scale / np.sqrt(8)) for _ in range(n)]


def cells(vectors: np.ndarray, settings: LatticeSettings) -> np.ndarray:
    """Cells of unit vectors, a row each: per table the home cell and the probed ones."""
    dims = vectors.shape[1]
    spaces = _spaces(dims, settings)
    out = []
    for t in range(settings.tables):
        homes, near = [], []
        for b in range(settings.blocks):
            y = vectors @ spaces[t * settings.blocks + b]
            point = decode(y)
            salt = (t * settings.blocks + b + 1) * 0x100000 + dims
            homes.append(_hash(point, salt))
            rest = (y - point / 2) @ MINIMAL.T
            best = np.argpartition(-rest, settings.probes, axis=1)[:, : settings.probes]
            near.append([_hash(point + MINIMAL[best[:, k]], salt) for k in range(settings.probes)])
        all_homes = np.sum(homes, axis=0, dtype=np.uint64)
        out.append(mix(all_homes))
        out += [mix(all_homes - homes[b] + p) for b in range(settings.blocks) for p in near[b]]
    return np.stack(out, axis=1).view(np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length of a list column, and their vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows][:, None] + np.arange(size)]


def _first_shared(of_a: np.ndarray, of_b: np.ndarray, cell: int) -> np.ndarray:
    """True where members with cells ``of_a`` and ``of_b`` (rows) share none smaller than ``cell``."""
    if len(of_a) == 1 or len(of_b) == 1:
        one, rest = (of_a, of_b) if len(of_a) == 1 else (of_b, of_a)
        shared = np.isin(rest, one[0][one[0] < cell]).any(1)
        return ~shared[None, :] if len(of_a) == 1 else ~shared[:, None]
    smaller, column = np.unique(np.concatenate([of_a, of_b]), return_inverse=True)
    column = column.reshape(-1, of_a.shape[1])
    marks = np.zeros((len(column), len(smaller)), np.float32)
    np.put_along_axis(marks, column, 1, axis=1)
    marks = marks[:, (smaller < cell) & (marks.sum(0) > 1)]
    return marks[: len(of_a)] @ marks[len(of_a) :].T == 0


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _compare(rows: pa.Table, settings: LatticeSettings) -> pa.RecordBatch:
    """Links of whole tasks of cells: rows ``a, null, number of links`` and ``a, b, null``."""
    cell, left, right, mine, ids, mult = (
        rows.column(k).to_numpy() for k in ("cell", "_left", "_right", "_mine", "rep", "mult")
    )
    edges = np.append(run_starts([cell, left, right]), len(cell))
    vectors = rows.column("embedding").combine_chunks()
    links: list[tuple[int, int]] = []
    met: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    # Cells of linked vectors, worked out once for all the cells that they meet in.
    linked: dict[int, dict[int, np.ndarray]] = {}
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for at, x in _matrices(vectors.slice(s, e - s)):
            unit = _unit(x)
            part = mine[s:e][at]
            a, b = np.flatnonzero(part == left[s]), np.flatnonzero(part == right[s])
            close = unit[a] @ unit[b].T >= settings.threshold
            if left[s] == right[s]:
                np.fill_diagonal(close, False)
            if not close.any():
                continue
            a_in, b_in = close.any(1), close.any(0)
            a, b, close = a[a_in], b[b_in], close[a_in][:, b_in]
            linked.setdefault(x.shape[1], {}).update(
                (int(ids[s + at[i]]), unit[i]) for i in {*a.tolist(), *b.tolist()}
            )
            met.append((s, s + at[a], s + at[b], close))
            links += spanning_links(close, ids[s + at[a]], ids[s + at[b]])
    known: dict[int, np.ndarray] = {}
    for of_size in linked.values():
        known.update(zip(of_size, cells(np.stack(list(of_size.values())), settings), strict=True))
    counts: list[np.ndarray] = []
    for s, a, b, close in met:
        of_a, of_b = (np.stack([known[i] for i in ids[x].tolist()]) for x in (a, b))
        close = close & _first_shared(of_a, of_b, int(cell[s]))
        counts.append(np.stack([ids[a], close @ mult[b]]))
        if left[s] != right[s]:
            counts.append(np.stack([ids[b], close.T @ mult[a]]))
    found = np.concatenate([np.zeros((2, 0), np.int64), *counts], axis=1).astype(np.int64)
    pairs = np.array(links, np.int64).reshape(-1, 2)
    n, m = found.shape[1], len(pairs)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([found[0], pairs[:, 0]])),
            pa.array(np.concatenate([np.zeros(n, np.int64), pairs[:, 1]]), mask=np.arange(n + m) < n),
            pa.array(np.concatenate([found[1], np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
        ],
        schema=_OUT,
    )


def near_vectors(
    vectors: DataFrame, settings: LatticeSettings = LatticeSettings(), vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    none = F.lit(0).cast("long")
    alone = rows.where("not usable").select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id"))
    valid = rows.where("usable").select("vec_id", "embedding")
    known = F.coalesce(F.col("vec_id"), F.lit(-(1 << 63)))
    classes = stored(
        valid.groupBy("embedding").agg(F.min(known).alias("rep"), F.count_distinct(known).alias("mult"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row in range(0, batch.num_rows, 2048):
                part = batch.slice(row, 2048)
                for at, x in _matrices(part.column(1)):
                    found = cells(_unit(x), settings)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.ravel()), pa.array(np.repeat(ids[row : row + 2048][at], found.shape[1]))],
                        names=["cell", "rep"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_runs(batches, ["cell", "_left", "_right"]):
            yield _compare(part, settings)

    placed = classes.select("rep", "embedding").mapInArrow(place, "cell long, rep long").distinct()
    tasks = split_buckets(placed, "cell", "rep", settings.block_rows).join(classes, "rep")
    tasks = tasks.select("cell", "_left", "_right", "_mine", "rep", "mult", "embedding")
    found = deal(tasks, ["cell", "_left", "_right"]).mapInArrow(compare, "a long, b long, links long")
    found = stored(found)
    counts = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(found.where("links is null").select("a", "b"))
    per_class = (
        classes.join(counts, classes.rep == counts.a, "left")
        .join(roots, classes.rep == roots.node, "left")
        .select(
            "embedding",
            (F.coalesce("links", none) + F.col("mult") - 1).alias("n_links"),
            F.nullif(F.coalesce("root", "rep"), F.lit(-(1 << 63))).alias("component_id"),
        )
    )
    linked = valid.join(per_class, "embedding").select("vec_id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
