"""Repeated word passages by seed and extend.

Documents meet on winnowed anchors (8 words; every 35-word window has one). Around an anchor that
stands at several places, the passage is extended both ways: a window is repeated if what it has
to the left of its anchor and what it has from the anchor on are both found together around another
occurrence. Consecutive repeated windows are a maximal repeat of at least the threshold, and all
its words go. Both occurrences go: windows are judged on the input.

Null and blank texts have no words and keep the digest of the empty text. An empty table gives no rows;
other columns are not looked at, whatever their names. See ``winnow`` for
repeated rows, null ids and hot passages. Words are compared by 64-bit hashes of 8-word grams
and of the whole extensions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from failcast.llm import winnow
from failcast.llm.common import run_starts, sorted_runs

GRAM = 8


def word_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in (text or "").encode().split()], np.uint64)


def _prepare(texts: pa.Array) -> tuple[winnow.Elements, np.ndarray]:
    words = [word_hashes(t) for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *words])
    return (lambda at, end: flat[at:end]), offsets


def extended(rows: pa.Table, window: int) -> pa.RecordBatch:
    """Repeated windows of segments (``h, doc_id, start, n, content``) in whole groups of ``h``."""
    h, doc, start, n = (rows.column(k).to_numpy().astype(np.int64) for k in ("h", "doc_id", "start", "n"))
    content = rows.column("content").to_pylist()
    keys = []
    # Where rows of one id differ in text, what stands at a segment's place may be no such segment.
    sound = np.ones(len(h), bool)
    for k in range(len(h)):
        words = np.frombuffer(content[k], np.uint64)
        hashes = winnow.gram_hashes(words, GRAM)
        # All windows of a segment have the same anchor, the smallest gram of each.
        anchor = int(winnow.smallest(hashes, window - GRAM + 1)[0])
        sound[k] = anchor >= n[k] - 1 and hashes[anchor].view(np.int64) == h[k]
        if not sound[k]:
            continue
        powers = np.multiply.accumulate(np.full(len(words) + 1, np.uint64(0x9E3779B97F4A7C15)))
        mixed = winnow.mix(words)
        first = np.arange(n[k])
        # Extension to the left, nearest word first, and to the right from the anchor.
        left = np.concatenate([[np.uint64(0)], np.add.accumulate(mixed[:anchor][::-1] * powers[:anchor])])
        right = np.concatenate([[np.uint64(0)], np.add.accumulate(mixed[anchor:] * powers[: len(words) - anchor])])
        back = anchor - first
        key = winnow.mix(left[back]) ^ winnow.mix(right[window - back] + back.astype(np.uint64))
        keys.append(key)
    h, doc, start, n = h[sound], doc[sound], start[sound], n[sound]
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(h)), n)
    first = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n) + start[of]
    order = np.lexsort((key, h[of]))
    heads = run_starts([h[of][order], key[order]])
    sizes = np.diff(np.append(heads, len(key)))
    hit = np.empty(len(key), bool)
    hit[order] = np.repeat(sizes > 1, sizes)
    return winnow.window_runs(doc[of], first, hit)


def remove_repeats(docs: DataFrame, window: int = 35, crowd: int = winnow.CROWD) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``."""

    def content(text: str | None):
        words = word_hashes(text)
        return lambda start, n: words[start : start + n - 1 + window].tobytes() if start + n - 1 + window <= len(words) else b""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, ["h"]):
            yield extended(rows, window)

    def finish(text: str | None, starts: np.ndarray, counts: np.ndarray) -> tuple:
        words = (text or "").encode().split()
        gone = winnow.covered(len(words), starts, counts, window)
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)
        return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()

    known = winnow.with_ids(docs)
    spans = winnow.seed_spans(known, _prepare, window, GRAM, first_stays=False, crowd=crowd)
    return winnow.resolve(
        known,
        spans,
        content,
        extend,
        ["h", "doc_id", "start"],
        finish,
        "doc_id long, n_words long, n_removed long, kept_sha256 string",
        first_stays=False,
    )
