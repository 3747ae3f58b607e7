"""Benchmark decontamination with an FM-index per shard of documents.

A shard (one Arrow batch) is a text of word numbers; words that no benchmark item has can be in
no match, so they only separate runs, and runs shorter than the shortest window are left out.
The rest is indexed: suffix array by prefix doubling, its Burrows-Wheeler transform, and a wavelet
matrix for ranks. All windows are searched backwards at once, their rows are located by walking
to the next sampled suffix position, and the occurrences are merged to spans of words.

Items are read in blocks of bounded size, one pass over the documents each. A window is ``window``
consecutive words of an item; an item of fewer words, but not none, is one window. Null texts
have no words. Items with the same id are one item, a null id is written as the empty string.
Every row of the documents gives one row, with repeated rows each on its own. Texts of any length are
indexed whole. Without documents there are no rows, without items no document has a hit. Helper columns
take names that the table does not have.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failcast.llm.common import fresh_name
from failcast.sources.storage import stored

#: Lower case for A-Z; what is neither digit, letter nor beyond ASCII becomes a space.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^\x20]+")
#: Every so many positions of the text are kept for locating.
SAMPLE = 8
#: Characters of benchmark text per block.
BLOCK_CHARS = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


class Vocabulary(dict):
    """Word numbers from 1; 0 for words that no item has."""

    def __missing__(self, word: bytes) -> int:
        return 0


@dataclass(frozen=True)
class Phrases:
    """Windows of a block of items: word numbers padded with 0, and the items of each window."""

    vocabulary: Vocabulary
    words: np.ndarray
    sizes: np.ndarray
    items: list[list[str]]


def phrases(items: list[tuple[str, str | None]], window: int) -> Phrases:
    vocabulary = Vocabulary()
    of: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        for at in range(max(1, len(ids) - window + 1) if ids else 0):
            of.setdefault(tuple(ids[at : at + window]), set()).add(item)
    words = np.zeros((len(of), window), np.int64)
    for k, w in enumerate(of):
        words[k, : len(w)] = w
    return Phrases(vocabulary, words, np.array([len(w) for w in of], np.int64), [sorted(x) for x in of.values()])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order; each separator (0) differs from all others, so order ends at a run's end."""
    n = len(text)
    cuts = text == 0
    rank = np.where(cuts, np.cumsum(cuts) - 1, text + cuts.sum())
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else after[:0]
        key = rank * (max(n, int(rank.max())) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(key[order][1:] != key[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Backward search over a text of numbers; 0 separates and is never searched."""

    def __init__(self, text: np.ndarray) -> None:
        suffixes = suffix_array(text)
        self.bwt = text[suffixes - 1]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.levels: list[tuple[int, int, np.ndarray]] = []
        now = self.bwt
        for bit in reversed(range(int(text.max()).bit_length())):
            ones = (now >> bit) & 1
            self.levels.append((bit, len(now) - int(ones.sum()), np.concatenate([[0], np.cumsum(ones)])))
            now = np.concatenate([now[ones == 0], now[ones == 1]])
        # A walk ends at a sampled position or at the first of a run.
        kept = (suffixes % SAMPLE == 0) | (self.bwt == 0)
        self.place = np.where(kept, suffixes, -1)

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each row."""
        low, high = np.zeros(len(symbols), np.int64), ends
        for bit, zeros, ones in self.levels:
            one = (symbols >> bit) & 1 == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the rows that start with each pattern."""
        low = np.zeros(len(sizes), np.int64)
        high = np.full(len(sizes), len(self.bwt), np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((sizes >= back) & (high > low))
            symbols = patterns[live, sizes[live] - back]
            there = symbols < len(self.less) - 1
            high[live[~there]] = low[live[~there]]
            live, symbols = live[there], symbols[there]
            low[live] = self.less[symbols] + self.rank(symbols, low[live])
            high[live] = self.less[symbols] + self.rank(symbols, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of the suffixes at ``rows``."""
        rows = rows.copy()
        found = np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        walked = 0
        while len(todo):
            at = self.place[rows[todo]]
            done = at >= 0
            found[todo[done]] = at[done] + walked
            todo = todo[~done]
            symbols = self.bwt[rows[todo]]
            rows[todo] = self.less[symbols] + self.rank(symbols, rows[todo])
            walked += 1
        return found


def shard_hits(texts: list[str | None], found: Phrases) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """Of each text: number of words, spans of hit words (start, end, start, ...), items."""
    get = found.vocabulary.__getitem__
    ids = []
    for text in texts:
        words = words_of(text)
        ids.append(np.fromiter(map(get, words), np.int32, len(words)))
    counts = np.array([len(x) for x in ids], np.int64)
    spans: list[list[int]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if not len(found.sizes) or not counts.sum():
        return counts, spans, items
    # A separator after each text, so that runs end with it.
    flat = np.concatenate([x for part in ids for x in (part, np.zeros(1, np.int32))]).astype(np.int64)
    starts = np.cumsum(counts + 1) - counts - 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flat > 0, [0]])))
    first, end = edges[::2], edges[1::2]
    long = end - first >= found.sizes.min()
    first, end = first[long], end[long]
    if not len(first):
        return counts, spans, items
    # Each run and its separator.
    sizes = end - first + 1
    place = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    index = FMIndex(flat[place])
    low, high = index.search(found.words, found.sizes)
    hit = np.flatnonzero(high > low)
    many = (high - low)[hit]
    rows = np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    window = np.repeat(hit, many)
    at = place[index.locate(rows)]
    marks = np.zeros(len(flat) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + found.sizes[window], -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(marks)[:-1] > 0, [0]])))
    doc = np.searchsorted(starts, edges[::2], "right") - 1
    for d, s, e in zip(doc.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        spans[d] += [s - int(starts[d]), e - int(starts[d])]
    pairs = np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, window]), axis=1)
    # Pairs are in order of documents.
    edges = np.append(np.flatnonzero(np.diff(pairs[0], prepend=-1)), pairs.shape[1]).tolist()
    for s, e in itertools.pairwise(edges):
        items[int(pairs[0, s])] = sorted({i for w in pairs[1, s:e].tolist() for i in found.items[w]})
    return counts, spans, items


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of about ``BLOCK_CHARS``; more benchmark text means more passes, not more memory."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + int(chars) // BLOCK_CHARS
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        yield sorted(((r["item"], r["text"]) for r in rows), key=lambda x: (x[0], x[1] or ""))


def _merged(spans: list[np.ndarray]) -> list[int]:
    pairs = sorted((int(s), int(e)) for x in spans for s, e in zip(x[::2], x[1::2], strict=True))
    out: list[int] = []
    for s, e in pairs:
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _hits(shared: Broadcast, text: Column) -> Column:
    @F.pandas_udf("n_words long, spans array<long>, items array<string>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            counts, spans, items = shard_hits(texts.tolist(), shared.value)
            yield pd.DataFrame({"n_words": counts, "spans": spans, "items": items})

    return hits(text)


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, into: str = "_hits") -> DataFrame:
    """Adds struct ``into``: ``n_words, n_hit, items`` (sorted ids) and ``spans`` of words, merged."""
    spark = docs.sparkSession
    found, names, shared = docs, [], None
    for block in _blocks(benchmark):
        if shared is not None:
            # One block's phrases at a time: a further block begins when the hits of this one are written.
            found = stored(found)
            shared.destroy()
        shared = spark.sparkContext.broadcast(phrases(block, window))
        names.append(fresh_name(found, f"{into}_{len(names)}"))
        found = found.withColumn(names[-1], _hits(shared, F.col("text")))
    merged_spans = fresh_name(found, "_spans")
    spans: Column = F.col(names[0])["spans"]
    if len(names) > 1:

        @F.pandas_udf("array<long>")
        def merged(*spans: pd.Series) -> pd.Series:
            return pd.Series([_merged(list(x)) for x in zip(*spans, strict=True)])

        spans = merged(*(F.col(n)["spans"] for n in names))
    items = F.array_sort(F.array_distinct(F.concat(*(F.col(n)["items"] for n in names))))
    n_hit = F.aggregate(
        F.transform(F.col(merged_spans), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    found = found.withColumn(merged_spans, spans)
    out = F.struct(
        F.col(names[0])["n_words"].alias("n_words"), n_hit.alias("n_hit"), items.alias("items"), F.col(merged_spans).alias("spans")
    )
    return found.withColumn(into, out).drop(merged_spans, *names)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = with_hits(docs.select("doc_id", "text"), benchmark, window)
    return found.select(
        "doc_id",
        "_hits.n_words",
        "_hits.n_hit",
        F.size("_hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_hits.items"), 256).alias("items_sha256"),
        (F.col("_hits.n_hit") > 0).alias("contaminated"),
    )


def without_words(text: str, spans: list[int]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    data = text.encode()
    words = [m.span() for m in _WORD.finditer(data.translate(_WORDS))]
    out, at = [], 0
    for s, e in zip(spans[::2], spans[1::2], strict=True):
        out.append(data[at : words[s][0]])
        at = words[e - 1][1]
    return b"".join([*out, data[at:]]).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with benchmark passages cut out of the texts; ``n_chars``, if there, is counted anew."""
    into = fresh_name(docs, "_found_hits")
    found = with_hits(docs, benchmark, window, into)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series(
            [t if t is None or not len(s) else without_words(t, list(s)) for t, s in zip(texts, spans, strict=True)],
            dtype=object,
        )

    out = found.withColumn("text", cut("text", F.col(into)["spans"]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
