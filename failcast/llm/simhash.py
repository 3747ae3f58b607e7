"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into five segments on a ring. If two fingerprints differ in at most four
bits, some segment starts a chain whose first one, two, ... five segments together differ in at
most 0, 1, 2, 3, 4 bits (the budget 4/5 per segment, in proportion to the chain's length,
rounded down). So documents meet on one equal segment followed by one that is equal but for one
masked bit; a pair must then hold the budgets of every longer chain before all bits are counted.

Equal fingerprints are one row from the start, so copies cost nothing. Inside a bucket only a
spanning forest of the links leaves the task. Null and blank texts have the fingerprint zero
and are linked like others. Every row in gives one row out; ``component_id`` ignores null ids. An empty table gives no rows. Helper
columns take names that the table does not have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.llm.common import (
    BLOCK,
    components,
    deal,
    give_back,
    run_starts,
    sorted_runs,
    spanning_links,
    split_buckets,
)
from failcast.sources.storage import stored

#: First bit and width of each segment of 64 bits.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Shingles hashed at once.
CHUNK = 1 << 18


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority of the bits of all shingle hashes; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    stops = ends[width - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(stops), CHUNK):
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(stops), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id`` and the fingerprint ``fp`` as a signed 64-bit number."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(prints.view(np.int64))], schema=schema
            )
        give_back()

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, fp long")


def _segment(values: np.ndarray, i: int) -> np.ndarray:
    first, width = SEGMENTS[i % len(SEGMENTS)]
    return (values >> np.uint64(first)) & np.uint64((1 << width) - 1)


def chain_keys(values: np.ndarray) -> np.ndarray:
    """Keys (one row per fingerprint) under which all pairs with a valid chain of two meet."""
    keys = []
    for i in range(len(SEGMENTS)):
        head, follow = _segment(values, i), _segment(values, i + 1)
        for bit in range(SEGMENTS[(i + 1) % len(SEGMENTS)][1]):
            rest = follow & ~np.uint64(1 << bit)
            keys.append(((np.uint64(i * 16 + bit) << np.uint64(13)) | head) << np.uint64(13) | rest)
    return np.stack(keys, axis=1).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, start: int, bits: int) -> np.ndarray:
    """Pairs that hold the budget of each chain from ``start``, and then differ in at most ``bits``."""
    diff = a ^ b
    ok = np.ones(diff.shape, bool)
    spent = np.zeros(diff.shape, np.uint8)
    for step in range(len(SEGMENTS)):
        spent += np.bitwise_count(_segment(diff, start + step))
        ok &= spent <= (step + 1) * bits // len(SEGMENTS)
    return ok & (np.bitwise_count(diff) <= bits)


def _forest(members: np.ndarray, mine: np.ndarray, left: int, right: int, start: int, bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within one task of a bucket."""
    a = members if left == right else members[mine == left]
    b = members if left == right else members[mine == right]
    if len(members) == 2:
        return [(members[0], members[1])] if len(a) and linked(members[:1], members[1:], start, bits)[0] else []
    if not len(a) or not len(b):
        return []
    close = linked(a[:, None], b[None, :], start, bits)
    return spanning_links(close, a, b)


def fingerprint_links(distinct: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that connect all within ``bits``."""
    if not 0 <= bits < len(SEGMENTS):
        raise ValueError("the chains of two segments hold for distances below 5")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            keys = chain_keys(values.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(values, keys.shape[1]))], names=["key", "fp"]
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "_left", "_right"]
        for rows in sorted_runs(batches, names):
            key, left, right, mine, fp = (rows.column(n).to_numpy() for n in (*names, "_mine", "fp"))
            values = fp.view(np.uint64)
            starts = np.append(run_starts([key, left, right]), len(key))
            out: list[tuple[int, int]] = []
            sizes = np.diff(starts)
            two = starts[:-1][sizes == 2]
            if len(two):
                at = key[two] >> 30
                for i in range(len(SEGMENTS)):
                    rows_i = two[at == i]
                    hit = rows_i[linked(values[rows_i], values[rows_i + 1], i, bits)]
                    out += zip(values[hit], values[hit + 1], strict=True)
            for s, e in zip(starts[:-1][sizes > 2], starts[1:][sizes > 2], strict=True):
                out += _forest(values[s:e], mine[s:e], left[s], right[s], int(key[s] >> 30), bits)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    # Each fingerprint becomes 65 rows: spread them over the tasks of a shuffle first.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.select("fp").repartition(tasks, "fp").mapInArrow(keyed, "key long, fp long")
    met = split_buckets(rows, "key", "fp", block).select("key", "_left", "_right", "_mine", "fp")
    return deal(met, ["key", "_left", "_right"]).mapInArrow(compare, "a long, b long").distinct()


def simhash_components(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable."""
    prints = stored(fingerprints(docs, shingle))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(fingerprint_links(classes, bits))
    member = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    # A hot fingerprint is one row of these tables; the documents' side can be split.
    return prints.join(member.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; an id stays once.

    Rows without an id cannot be named by a group and all stay. All columns stay.
    """
    named = docs.where("doc_id is not null")
    found = simhash_components(named, shingle, bits)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    # The duplicates of an id meet where the join has brought them.
    one = named.join(kept, named["doc_id"] == kept["_kept"], "left_semi").dropDuplicates(["doc_id"])
    return one.union(docs.where("doc_id is null"))
