"""Ranked lexical search without random access (NRA).

Each item (a query) ranks all documents by a sum over its terms of an integer weight, larger for rarer
terms, times a saturating share of the term's occurrences, less for longer documents.

Items come in blocks of bounded size. For a block, one pass over the documents keeps the occurrences
of the block's terms and every document's length in a stored table; corpus counts are summed over all
of it. A second pass takes its rows in shards of bounded size. A shard sorts the entries of each term
by impact, and every item reads its lists from the top, in step: what is read raises a document's lower
score, the last value read in each list it was not yet met in bounds the rest from above. Reading goes
on until each document whose upper score reaches the k-th best lower score is fully known; so
membership, ties and final scores are settled when it stops. Later shards of a task start from the best
documents of earlier ones. A task returns its best k documents of each item; these are merged.

Rows count one by one: a row of documents without a term (null, empty) counts nowhere; repeated rows are
documents of their own, and both can be ranked. Equal scores go by id, a null id last; rows of one id and
one score are interchangeable. Rows of items that share an id (null is an id as well) are one item with the terms of
all. An item without terms, or whose terms no document has, gets no rows; so do empty tables. Other
columns are not looked at, whatever their names. Very long texts are read in slices, whole.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from failcast.llm.common import text_bytes
from failcast.sources.storage import stored

#: Characters of items in a block; an item counts as 64 more.
BLOCK_CHARS = 4_000_000
#: Documents, and entries of lists, in a shard.
SHARD_ROWS, SHARD_ENTRIES = 8192, 1_000_000
#: Bytes of a text whose terms are listed at once.
SLICE = 1 << 20
#: Entries that an item first reads from each of its lists; then four times as many.
FIRST_READ = 64

_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]


def _byte_table() -> bytes:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[_SEPARATORS] = 32
    return table.tobytes()


_BYTES = _byte_table()


def terms(data: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, some at a time: lower-cased runs of letters, digits and non-ASCII."""
    data, at = data.translate(_BYTES), 0
    while at < len(data):
        cut = data.find(b" ", at + SLICE)
        end = cut if cut >= 0 else len(data)
        yield data[at:end].split()
        at = end


@dataclass(frozen=True)
class Block:
    """Items searched together."""

    #: Place of each term in the block.
    vocabulary: dict[bytes, int]
    #: Ids of the items, and the places of their terms.
    ids: list
    wanted: list[np.ndarray]


def blocks(items: DataFrame, size: int = BLOCK_CHARS) -> Iterator[Block]:
    """Blocks of items in the order of their ids; rows of one id stay together."""
    vocabulary: dict[bytes, int] = {}
    ids: list = []
    wanted: list[set[int]] = []
    used = 0
    for row in items.select("item_id", "text").sort("item_id").toLocalIterator():
        if not ids or ids[-1] != row[0]:
            if used >= size:
                yield Block(vocabulary, ids, [np.array(sorted(w), np.int64) for w in wanted])
                vocabulary, ids, wanted, used = {}, [], [], 0
            ids.append(row[0])
            wanted.append(set())
        used += len(row[1] or "") + 64
        for some in terms((row[1] or "").encode()):
            wanted[-1].update(vocabulary.setdefault(t, len(vocabulary)) for t in some)
    if ids:
        yield Block(vocabulary, ids, [np.array(sorted(w), np.int64) for w in wanted])


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tf`` of each document with a term: its length, and the vocabulary's terms in it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            lengths = np.zeros(batch.num_rows, np.int64)
            keys: list[np.ndarray] = []
            counts: list[np.ndarray] = []
            for row in range(batch.num_rows):
                found: Counter[int] = Counter()
                for some in terms(data[offsets[row] : offsets[row + 1]].tobytes()):
                    lengths[row] += len(some)
                    found.update(map(place, some))
                found.pop(None, None)
                keys.append(np.fromiter(found.keys(), np.int32, len(found)))
                counts.append(np.fromiter(found.values(), np.int64, len(found)))
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
            columns = [
                batch.column(0),
                pa.array(lengths),
                pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.zeros(0, np.int32), *keys]))),
                pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))),
            ]
            found_rows = pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tf"])
            yield found_rows.filter(pa.array(lengths > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tf array<long>")


@dataclass(frozen=True)
class Corpus:
    """Counts over all documents, and the weight of each term of the block."""

    documents: int
    length: int
    weights: np.ndarray

    def norms(self, n: np.ndarray) -> np.ndarray:
        """Length part of documents of ``n`` terms, in whole numbers."""
        if len(n) and 90 * int(n.max()) * self.documents >= 1 << 63:
            return np.array([10 + 90 * int(x) * self.documents // self.length for x in n], np.int64)
        return 10 + 90 * n * self.documents // self.length


def corpus_counts(found: DataFrame, terms_in_block: int) -> Corpus:
    """Counts of a table of occurrences; only one row per term of the block reaches the driver."""
    documents, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(terms_in_block, np.int64)
    holding = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df[holding.column("term").to_numpy()] = holding.column("df").to_numpy()
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()]
    return Corpus(int(documents), int(length), np.array(weights, np.int64))


class Shard:
    """Lists of some documents, one per term, by falling impact."""

    def __init__(self, n: np.ndarray, rows: np.ndarray, places: np.ndarray, tf: np.ndarray, corpus: Corpus) -> None:
        impact = corpus.weights[places] * (1_000_000_000 * tf // (1000 * tf + 8 * corpus.norms(n)[rows]))
        some = np.flatnonzero(impact > 0)
        order = some[np.lexsort((rows[some], -impact[some], places[some]))]
        self.size = len(n)
        self.rows, self.impact = rows[order], impact[order]
        self.starts = np.searchsorted(places[order], np.arange(len(corpus.weights) + 1))

    def best(self, wanted: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the best ``k`` with scores above 0, and their scores.

        ``known``: the best scores from elsewhere, falling, ``k`` at most. All rows that reach the k-th best
        score of both are returned, ties included.
        """
        first = self.starts[wanted]
        size = self.starts[wanted + 1] - first
        first, size = first[size > 0], size[size > 0]
        lower = np.zeros(self.size, np.int64)
        read_rows: list[np.ndarray] = []
        read_lists: list[np.ndarray] = []
        depth, step = 0, FIRST_READ
        while True:
            ahead = np.clip(size - depth, 0, step)
            lists = np.repeat(np.arange(len(size)), ahead)
            within = np.arange(len(lists)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
            at = first[lists] + depth + within
            np.add.at(lower, self.rows[at], self.impact[at])
            read_rows.append(self.rows[at])
            read_lists.append(lists)
            depth, step = depth + step, step * 4
            # What a list may still give a document that it has not shown.
            rest = np.where(size > depth, self.impact[first + np.minimum(depth, size) - 1], 0) if len(size) else size
            bar = _kth(lower, known, k)
            total = int(rest.sum())
            if not total:
                break
            met = np.zeros(self.size, np.int64)
            for rows, of in zip(read_rows, read_lists, strict=True):
                np.add.at(met, rows, rest[of])
            if not np.any((total > met) & (lower + (total - met) >= bar)):
                # Everything that may reach the bar has been met in all lists that still go on.
                break
        rows = np.flatnonzero(lower >= bar)
        return rows, lower[rows]


def _kth(lower: np.ndarray, known: np.ndarray, k: int) -> int:
    """k-th best of the scores above 0, 1 if there are fewer."""
    top = lower if len(lower) <= k else np.partition(lower, len(lower) - k)[len(lower) - k :]
    scores = np.sort(np.concatenate([top, known]))
    return max(1, int(scores[-k])) if len(scores) >= k else 1


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    waiting: list[pa.RecordBatch] = []
    rows = entries = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            sizes = np.cumsum(pc.list_value_length(batch.column(2).slice(at)).to_numpy(zero_copy_only=False))
            take = max(1, min(int(np.searchsorted(sizes, SHARD_ENTRIES - entries)), SHARD_ROWS - rows))
            take = min(take, batch.num_rows - at)
            waiting.append(batch.slice(at, take))
            at, rows, entries = at + take, rows + take, entries + int(sizes[take - 1])
            if rows >= SHARD_ROWS or entries >= SHARD_ENTRIES:
                yield pa.Table.from_batches(waiting)
                waiting, rows, entries = [], 0, 0
    if waiting:
        yield pa.Table.from_batches(waiting)


class _Best:
    """The best ``k`` of an item so far: scores, ids, and which ids are null."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = (
            np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.null, null))
        )
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


_FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """``item`` (place in the block), ``rank, doc_id, score``."""
    found = stored(occurrences(docs, block.vocabulary))
    corpus = corpus_counts(found, len(block.vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast((corpus, block.wanted))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, wanted = shared.value
        best = [_Best(k) for _ in wanted]
        for table in _shards(batches):
            table = table.combine_chunks()
            ids = table.column("doc_id").combine_chunks()
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            lists = table.column("terms").combine_chunks()
            rows = np.repeat(np.arange(len(table)), lists.value_lengths().to_numpy())
            tf = table.column("tf").combine_chunks().flatten().to_numpy()
            shard = Shard(table.column("n").to_numpy(), rows, lists.flatten().to_numpy(), tf, corpus)
            for item, own in zip(wanted, best, strict=True):
                some, scores = shard.best(item, k, own.scores)
                if len(some):
                    own.add(scores, ids[some], null[some])
        for item, own in enumerate(best):
            doc_ids = pa.array(own.ids, mask=own.null)
            place = pa.array(np.full(len(own.ids), item, np.int32))
            yield pa.RecordBatch.from_arrays([place, doc_ids, pa.array(own.scores)], schema=_FOUND)

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = found.mapInArrow(search, "item int, doc_id long, score long")
    # Tasks give k rows an item each; parts of them are merged first, so no task sees all.
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(256))
    first = Window.partitionBy("item", "part").orderBy(*order)
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best ``k`` documents of each item with scores above 0."""
    spark = docs.sparkSession
    fields = StructType([StructField("item", IntegerType()), StructField("item_id", items.schema["item_id"].dataType)])
    out: list[DataFrame] = []
    for block in blocks(items, block_chars):
        # The block bounds the number of its items.
        names = spark.createDataFrame(list(enumerate(block.ids)), fields)
        ranked = _search_block(docs, block, k).join(F.broadcast(names), "item")
        out.append(ranked.select("item_id", "rank", "doc_id", "score"))
        if len(out) > 1:
            # Several blocks are searched one after the other.
            out[-2:] = [stored(df) if len(out) == 2 or df is out[-1] else df for df in out[-2:]]
    if not out:
        empty = StructType([fields["item_id"]])
        return spark.createDataFrame([], empty).selectExpr("item_id", "0 rank", "0L doc_id", "0L score")
    return functools.reduce(DataFrame.union, out)
