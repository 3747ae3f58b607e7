"""Winnowed anchors: which repeats can exist at all, found with one narrow shuffle.

A sequence (bytes or words) is read in windows of a fixed length. The anchor of a window is its
k-gram with the smallest hash (leftmost if equal), so equal windows have equal anchors at equal
places. Neighbouring windows mostly share their anchor; such a run is a segment, and there are
about ``2 / (window - k + 2)`` of them per element. Only segments travel, as numbers.

* Segments whose anchor stands nowhere else hold no repeat.
* Segments equal to another one in whole repeat in whole.
* What is left, different segments around the same anchor, is compared window by window by the
  operator (``extend`` in ``resolve``); this is where a copied passage begins, ends or was edited.

Equal segments of one Arrow batch are combined before the shuffle: one of them speaks for all,
the others are done and are dealt by their own place instead of by the anchor. So a passage that
a third of all documents share sends one row per batch to its task, which streams them.

An anchor with more than ``crowd`` different segments is crowded: its windows are not compared in
one task but counted by content, which Spark combines before the shuffle, and joined back.

Documents are told apart by id: rows with the same id are one document (each gets its result; if
their texts differ, a row may also lose what is repeated at the same place of the other's). Rows
without an id are told apart by text and come before all others. Texts of any length are read in
pieces of bounded size.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failcast.llm.common import run_starts
from failcast.sources.storage import stored

PIECE = 1 << 19
#: Keys of rows without an id: from the smallest number on, below all that ids may be.
NO_ID, LEAST_ID = -(1 << 63), -(1 << 62)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Results of the seed stage, as flags: repeated in whole, to be compared, around a crowded anchor.
WHOLE, COMPARE, CROWDED = 1, 2, 4
#: Different segments around one anchor that a task compares.
CROWD = 4096

Elements = Callable[[int, int], np.ndarray]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: neighbouring values land far apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` values (a power of two) from each place, by doubling."""
    size, base = 1, int(_BASE)
    while size < gram:
        values = values[:-size] * np.uint64(base) + values[size:] if len(values) > size else values[:0]
        size, base = size * 2, base * base & 0xFFFFFFFFFFFFFFFF
    return mix(values)


def smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of each ``width`` consecutive hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, place, size = hashes, np.arange(len(hashes)), 1

    def join(step: int) -> tuple[np.ndarray, np.ndarray]:
        later = low[step:] < low[:-step]
        return np.where(later, low[step:], low[:-step]), np.where(later, place[step:], place[:-step])

    while 2 * size <= width:
        low, place = join(size)
        size *= 2
    if size < width:
        low, place = join(width - size)
    return place[:n]


def segments(elements: Elements, offsets: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Segments of a batch of sequences that stand one after the other.

    ``elements(at, end)`` gives mixed 64-bit values. Columns: ``text`` (number in the batch),
    ``start`` of the first window, ``n`` windows, ``h`` of the anchor, ``c`` of the content.
    """
    total = int(offsets[-1])
    parts: list[tuple[np.ndarray, ...]] = []
    for at in range(0, total, PIECE):
        end = min(total, at + PIECE)
        values = elements(at, min(total, end + window - 1))
        starts = min(end - at, len(values) - window + 1)
        if starts <= 0:
            continue
        hashes = gram_hashes(values, gram)
        place = smallest(hashes, window - gram + 1)[:starts]
        # Windows across the end of a text are none.
        cut = np.zeros(starts + 1, np.int64)
        ends = offsets[1:][(offsets[1:] > at) & (offsets[1:] < at + starts + window)]
        np.add.at(cut, np.clip(ends - window + 1 - at, 0, starts), 1)
        np.add.at(cut, np.clip(ends - at, 0, starts), -1)
        place = np.where(np.cumsum(cut[:-1]) > 0, -1, place)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        n = np.diff(np.append(first, starts))
        kept = place[first] >= 0
        first, n = first[kept], n[kept]
        if not len(first):
            continue
        anchor = place[first]
        sums = np.concatenate([[np.uint64(0)], np.add.accumulate(hashes * _powers(_BASE, len(hashes)))])
        back = _powers(_BACK, len(hashes))
        content = (sums[first + n - 1 + window - gram + 1] - sums[first]) * back[first]
        content = mix(content + ((anchor - first).astype(np.uint64) << np.uint64(32)) + n.astype(np.uint64))
        text = np.searchsorted(offsets, at + first, "right") - 1
        parts.append((text, at + first - offsets[text], n, hashes[anchor].view(np.int64), content.view(np.int64)))
    names = ("text", "start", "n", "h", "c")
    if not parts:
        return {k: np.zeros(0, np.int64) for k in names}
    return {k: np.concatenate(x).astype(np.int64) for k, x in zip(names, zip(*parts, strict=True), strict=True)}


#: ``place`` holds start, number of windows (below 128) and three flags in one number.
SEEDS = "h long, c long, doc_id long, place long"
_SEEDS = pa.schema([(k, pa.int64()) for k in ("h", "c", "doc_id", "place")])
SPANS = "doc_id long, place long, h long"
_SPANS = pa.schema([(k, pa.int64()) for k in ("doc_id", "place", "h")])
DONE, MANY = 1, 2


def _place(start: np.ndarray, n: np.ndarray, flags: np.ndarray) -> np.ndarray:
    if np.size(n) and np.max(n) >= 128:
        raise ValueError("a segment has 128 windows or more: the window is too long for its anchors")
    return start << 10 | n << 3 | flags


def _batch(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c).cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema
    )


def with_ids(docs: DataFrame) -> DataFrame:
    by_text = F.lit(NO_ID) + F.xxhash64("text").bitwiseAND((1 << 62) - 1)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), by_text).alias("doc_id"), "text")


def combine(ids: np.ndarray, found: dict[str, np.ndarray], first_stays: bool) -> pa.RecordBatch:
    """Seeds of a batch, equal segments combined; those that are done are flagged."""
    doc = ids[found["text"]]
    key = found["h"] ^ mix(found["c"].view(np.uint64)).view(np.int64)
    order = np.lexsort((found["start"], doc, key))
    key, doc = key[order], doc[order]
    start, n, h, c = (found[k][order] for k in ("start", "n", "h", "c"))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
    key, doc, start, n, h, c = (x[new] for x in (key, doc, start, n, h, c))
    heads = run_starts([key])
    done = np.ones(len(key), bool)
    done[heads] = False
    many = np.zeros(len(key), bool)
    many[heads] = (np.diff(np.append(heads, len(key))) > 1) & (not first_stays)
    spread = mix(doc.view(np.uint64) * _BASE + start.view(np.uint64)).view(np.int64)
    place = _place(start, n, np.where(done, DONE, 0) | np.where(many, MANY, 0))
    return _batch(_SEEDS, np.where(done, spread, h), np.where(done, 0, c), doc, place)


class _Judge:
    """Spans from seeds sorted by anchor, content, id and place, batch by batch.

    Of the anchor that a batch ends with, the first seed of each content waits for what follows:
    at most ``crowd`` seeds, then the anchor is crowded and only the last content's waits.
    """

    def __init__(self, first_stays: bool, crowd: int) -> None:
        self.first_stays, self.crowd = first_stays, crowd
        self.waiting = [np.zeros(0, np.int64)] * len(_SEEDS)
        #: The anchor that the last batch ended with, if it is crowded.
        self.crowded = np.zeros(0, np.int64)

    def spans(self, seeds: list[np.ndarray], ended: bool) -> pa.RecordBatch:
        h, c, doc, place = (np.concatenate(x) for x in zip(self.waiting, seeds, strict=True))
        if not len(h):
            return _batch(_SPANS, *(np.zeros(0, np.int64),) * 3)
        one = run_starts([h, c, doc, place >> 3])
        flags = np.bitwise_or.reduceat(place & 7, one)
        h, c, doc, place = h[one], c[one], doc[one], place[one] >> 3 << 3
        done, many = (flags & DONE) > 0, (flags & MANY) > 0
        groups, contents = run_starts([h]), run_starts([h, c])
        head = np.zeros(len(h), bool)
        head[contents] = True
        count = np.add.reduceat(1 + many, contents)[np.cumsum(head) - 1]
        first = np.zeros(len(h), bool)
        first[groups] = True
        kinds = np.add.reduceat((head & ~done).astype(np.int64), groups)[np.cumsum(first) - 1]
        crowded = (kinds > self.crowd) | np.isin(h, self.crowded)
        whole = done | (~head if self.first_stays else count > 1)
        compare = ~done & head & ((kinds > 1) | crowded)
        kind = np.where(whole, WHOLE, 0) | np.where(compare, COMPARE, 0) | np.where(compare & crowded, CROWDED, 0)
        waits = head & ~done & (h == h[-1]) & (not ended)
        if crowded[-1]:
            waits[: contents[-1]] = False
        self.crowded = h[-1:][crowded[-1:]]
        self.waiting = [x[waits] for x in (h, c, doc, place | np.where(count > 1, MANY, 0))]
        out = (kind > 0) & ~waits
        return _batch(_SPANS, doc[out], (place | kind)[out], np.where(compare, h, 0)[out])


def seed_spans(
    docs: DataFrame,
    prepare: Callable[[pa.Array], tuple[Elements, np.ndarray]],
    window: int,
    gram: int,
    first_stays: bool,
    crowd: int = CROWD,
) -> DataFrame:
    """Spans of windows that repeat in whole, or that must be compared (``kind``), of ``with_ids`` rows.

    ``first_stays``: the occurrence with the smallest id and place is not itself a repeat.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, offsets = prepare(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield combine(ids, segments(elements, offsets, window, gram), first_stays)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _Judge(first_stays, crowd)
        for batch in batches:
            yield judged.spans([c.to_numpy() for c in batch.columns], ended=False)
        yield judged.spans([np.zeros(0, np.int64)] * len(_SEEDS), ended=True)

    seeds = docs.mapInArrow(scan, SEEDS)
    dealt = seeds.repartition("h").sortWithinPartitions("h", "c", "doc_id", "place")
    return dealt.mapInArrow(judge, SPANS)


def resolve(
    docs: DataFrame,
    spans: DataFrame,
    content: Callable[[str | None], Callable[[int, int], bytes]],
    extend: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    order: list[str | Column],
    finish: Callable[[str | None, np.ndarray, np.ndarray], tuple],
    schema: str,
    first_stays: bool,
) -> DataFrame:
    """Results of all documents from their spans.

    ``content(text)(start, n)`` is what the ``n`` windows from ``start`` cover, as bytes;
    ``extend`` gets rows ``h, doc_id, start, n, content`` with equal ``h`` in one task, sorted by
    ``order``, and gives spans ``doc_id, start, n`` of repeated windows; ``finish(text, starts, counts)`` makes the result.
    Documents without open segments are finished in the first pass; only the texts of the others
    travel a second time.
    """
    kind = F.col("place").bitwiseAND(7)
    per_doc = spans.groupBy("doc_id").agg(
        F.collect_list(F.when(kind.bitwiseAND(WHOLE) > 0, F.col("place"))).alias("whole"),
        F.collect_list(F.when(kind.bitwiseAND(COMPARE) > 0, F.struct("place", "h"))).alias("open"),
    )
    joined = docs.join(per_doc.hint("merge"), "doc_id", "left")
    result = [c.strip().split(" ", 1) for c in schema.split(",")]
    # One table of four kinds of rows: results, segments to compare, hashes of the windows of
    # crowded segments, documents that wait for them.
    fields = (
        f"{schema}, h long, start long, n int, content binary, windows array<long>, text string,"
        " spans array<struct<start:long,n:int>>"
    )
    names = [c[0] for c in result]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows: list[dict] = []
                for row in batch.slice(at, 256).to_pylist():
                    whole = [_start_and_n(p) for p in row["whole"] or []]
                    todo = [(s["h"], s["place"] & CROWDED, *_start_and_n(s["place"])) for s in row["open"] or []]
                    if not todo:
                        values = finish(row["text"], *_columns(whole))
                        rows.append({"doc_id": row["doc_id"], **dict(zip(names[1:], values, strict=True))})
                        continue
                    cut = content(row["text"])
                    rows.append(
                        {
                            "doc_id": row["doc_id"],
                            "text": row["text"],
                            "spans": [{"start": s, "n": n} for s, n in whole],
                        }
                    )
                    rows += [
                        {"doc_id": row["doc_id"], "h": h, "start": s, "n": n, "content": x}
                        for h, crowded, s, n in todo
                        if not crowded and (x := cut(s, n))
                    ]
                    rows += [
                        {"doc_id": row["doc_id"], "h": h, "start": s, "windows": _window_hashes(cut, s, n)}
                        for h, crowded, s, n in todo
                        if crowded and cut(s, n)
                    ]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                both = [(s["start"], s["n"]) for s in [*(row["spans"] or []), *(row["more"] or [])]]
                values = finish(row["text"], *_columns(both))
                rows.append(dict(zip(names, (row["doc_id"], *values), strict=True)))
            yield pa.RecordBatch.from_pylist(rows, schema=arrow_result)

    spark = docs.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = spark.createDataFrame([], fields)
    arrow = to_arrow_schema(empty.schema)
    arrow_result = to_arrow_schema(empty.select(*names).schema)
    table = stored(joined.mapInArrow(first, fields))
    compared = table.where("content is not null").select("h", "doc_id", "start", "n", "content")
    # Segments of repeated rows are one; what is dealt by anchor needs no second shuffle for that.
    compared = compared.repartition("h").dropDuplicates(["h", "doc_id", "start"])
    repeated = compared.sortWithinPartitions(*order).mapInArrow(extend, "doc_id long, start long, n int")
    repeated = repeated.union(_crowded_repeats(table.where("windows is not null"), first_stays))
    more = repeated.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("more"))
    waiting = table.where("spans is not null").select("doc_id", "text", "spans").join(more, "doc_id", "left")
    done = table.where("content is null and windows is null and spans is null").select(*names)
    out = done.union(waiting.mapInArrow(last, schema))
    return out.withColumn("doc_id", F.when(F.col("doc_id") >= LEAST_ID, F.col("doc_id")))


def _window_hashes(cut: Callable[[int, int], bytes], start: int, n: int) -> list[int]:
    hashes = np.array([xxhash.xxh64_intdigest(cut(s, 1)) for s in range(start, start + n)], np.uint64)
    return hashes.view(np.int64).tolist()


def _crowded_repeats(segments_: DataFrame, first_stays: bool) -> DataFrame:
    """Repeated windows ``doc_id, start, n`` of segments ``h, doc_id, start, windows``.

    A window that very many segments share is one row per task before the shuffle, and one row
    of the joined table's small side; its occurrences can be split between tasks.
    """
    rows = segments_.select("h", "doc_id", "start", F.posexplode("windows").alias("k", "window"))
    rows = rows.select("h", "window", "doc_id", (F.col("start") + F.col("k")).alias("start"))
    place = F.struct("doc_id", "start")
    ends = rows.groupBy("h", "window").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    found = rows.join(ends.where("first != last"), ["h", "window"])
    if first_stays:
        found = found.where(place != F.col("first"))
    return found.select("doc_id", "start", F.lit(1).alias("n"))


def _start_and_n(place: int) -> tuple[int, int]:
    return place >> 10, place >> 3 & 127


def _columns(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    both = np.array(spans, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def covered(size: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Elements inside a window of the spans; spans beyond the end are cut."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, np.clip(starts, 0, size), 1)
    np.add.at(marks, np.clip(starts + counts - 1 + window, 0, size), -1)
    return np.cumsum(marks)[:-1] > 0


def window_runs(doc: np.ndarray, first: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    """Spans ``doc_id, start, n`` of consecutive hit windows; windows are in order of segments."""
    on = np.flatnonzero(hit)
    if not len(on):
        return _batch(_RUNS, *(np.zeros(0, np.int64),) * 3)
    new = np.ones(len(on), bool)
    new[1:] = (doc[on][1:] != doc[on][:-1]) | (first[on][1:] != first[on][:-1] + 1)
    heads = np.flatnonzero(new)
    return _batch(_RUNS, doc[on][heads], first[on][heads], np.diff(np.append(heads, len(on))))


_RUNS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])
