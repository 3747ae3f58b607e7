"""What several text operators share: byte views of Arrow batches, runs of sorted rows,
split buckets and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failcast.sources.storage import stored

#: Rows of a bucket that are compared at once; larger buckets are split into blocks.
BLOCK = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Limits the bytes of texts that a Python worker gets at once, for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Memory that a worker's allocators keep from work that is done goes back to the system.

    A worker waits for further tasks of any stage; what it keeps adds to what the others need.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as the text ''."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch of texts in one vector, and the offsets of the texts in it.

    A null text has no bytes. The vector is a view of Arrow's buffer, not a copy.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of_bytes(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Cuts ``[0, offsets[-1])`` into pieces of ``size`` bytes, so that work arrays stay small."""
    for at in range(0, int(offsets[-1]), size):
        yield at, min(int(offsets[-1]), at + size)


def add_by_text(out: np.ndarray, values: np.ndarray, at: int, offsets: np.ndarray) -> None:
    """Adds ``values[i]``, which stands at byte ``at + i``, to the row of its text in ``out``."""
    end = at + len(values)
    first = int(np.searchsorted(offsets, at, "right")) - 1
    last = int(np.searchsorted(offsets, end, "left"))
    starts = np.maximum(offsets[first:last], at) - at
    full = np.flatnonzero(np.minimum(offsets[first + 1 : last + 1], end) - at > starts)
    if len(full):
        out[first + full] += np.add.reduceat(values, starts[full], axis=0)


def sorted_runs(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.Table]:
    """Groups of equal ``keys`` in rows sorted by them, many whole groups at a time.

    Each table holds whole groups only: a group cut by the end of a batch waits for the
    next batch. Groups are bounded by the caller (``split_buckets``).
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        rows = pa.Table.from_batches(waiting)
        change = run_starts([rows.column(k).to_numpy() for k in keys])
        cut = int(change[-1])
        if cut:
            yield rows.slice(0, cut)
            waiting = rows.slice(cut).combine_chunks().to_batches()
    if waiting:
        yield pa.Table.from_batches(waiting)


def run_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where a run of equal rows starts; the first is 0."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def id_filter(ids: DataFrame, column: str, bits_per_id: int = 16, most_bits: int = 1 << 28) -> Callable[[str], Column]:
    """A test that holds for every value of ``column`` in ``ids``, and for few others: a Bloom filter.

    To thin out rows before a join that decides. It has one hash and ``bits_per_id`` bits for each id, at most
    ``most_bits`` in all; with more ids than these allow it lets more rows pass. A null id does not pass.
    """
    size = 1 << max(15, min(most_bits.bit_length() - 1, (bits_per_id * max(1, ids.count())).bit_length()))

    def place(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.pmod(F.xxhash64(F.lit("filter"), name), F.lit(size)))

    at = (place(column) + 1).alias("at")
    parts = ids.where(F.col(column).isNotNull()).select(at)
    parts = parts.groupBy(F.bitmap_bucket_number("at").alias("part"))
    found = parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    bits = np.zeros(size // 8, np.uint8)
    for part, data in zip(found.column("part").to_pylist(), found.column("bits").to_pylist(), strict=True):
        bits[(part - 1) * len(data) : part * len(data)] = np.frombuffer(data, np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def passes(places: pa.Array) -> pa.Array:
        known = places.is_valid().to_numpy(zero_copy_only=False)
        at = places.fill_null(0).to_numpy()
        return pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & known)

    return lambda name: passes(place(name))


def split_buckets(rows: DataFrame, key: str, member: str, block: int = BLOCK) -> DataFrame:
    """Rows of buckets with two members or more, dealt into tasks of bounded size.

    A bucket of up to ``block`` rows is one task (``left = right = 0``). A larger one is
    cut into equal-hash blocks by ``member``, and a task meets each two blocks; a row goes to as many
    tasks as its bucket has blocks, so no task holds more than about two blocks. Returns the
    columns of ``rows`` with ``_left, _right`` (blocks of the task) and ``_mine`` (the row's own).
    The join is a merge at every size: Spark does not see how many rows a Python function makes of one.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    sized = rows.join(sizes.hint("merge"), key)
    blocks = F.ceil(F.col("_n") / block).cast("int")
    mine = F.pmod(F.xxhash64(F.lit("block"), F.col(member)), F.col("_blocks")).cast("int")
    sized = sized.withColumn("_blocks", blocks).withColumn("_mine", mine)
    met = sized.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return met.select(
        *rows.columns,
        F.least("_mine", "_other").alias("_left"),
        F.greatest("_mine", "_other").alias("_right"),
        "_mine",
    )


def deal(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal ``keys`` together and in order, for ``sorted_runs``."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def spanning_links(close: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what ``close[i, j]`` (between ``a[i]`` and ``b[j]``) connects: a forest."""
    out: list[tuple[int, int]] = []
    open_a, open_b = close.any(1), close.any(0)
    for seed in np.flatnonzero(open_a).tolist():
        if not open_a[seed]:
            continue
        open_a[seed] = False
        todo = [(True, seed)]
        while todo:
            of_a, i = todo.pop()
            new = np.flatnonzero(close[i] & open_b) if of_a else np.flatnonzero(close[:, i] & open_a)
            (open_b if of_a else open_a)[new] = False
            out += [(a[i], b[j]) if of_a else (a[j], b[i]) for j in new.tolist()]
            todo += [(not of_a, j) for j in new.tolist()]
    return [(x, y) for x, y in out if x != y]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node that has an edge: columns ``node, root``.

    Alternates large and small stars: each round links a node's larger, then its smaller
    neighbours to the smallest of them, until the edges are stars. Each round is written
    to the shared folder, so a lost executor costs one round at most. A hub's edges meet
    its one minimum in a join that Spark can split. Self-loops are dropped.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    now = stored(
        edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum, to see whether a round changed anything."""
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return int(row["n"]), int(row["s"] or 0)

