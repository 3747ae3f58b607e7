"""Repeated byte strings with a logarithmic family of suffix arrays.

Only suffixes that can match are indexed: those of segments around an anchor that different
segments share (see ``winnow``). They are dealt by anchor, so equal strings meet in one task, and come
in order of document and place. A task reads them in batches. A batch gets a suffix array of its
windows, to the depth of the match length; it is merge-scanned against the suffix arrays of all
levels, where every string is from an earlier place, so an equal one is a match; and it becomes the
newest level. Levels of equal size are merged, so there are as many as the logarithm of the number of
batches, and each string is copied as often. A task works through its anchors in ``SLOTS`` parts,
each with a family of its own, so the strings in memory are those of one part. Anchors with very many
different segments are settled by counting (see ``winnow``).

Every byte inside a string that also starts earlier (smaller id, or same document, earlier place)
goes; strings are judged on the input. Null texts are empty. See ``winnow`` for repeated rows. An empty table gives no rows; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.llm import winnow
from failcast.llm.common import run_starts, text_bytes

GRAM = 32
#: Windows of a batch of the index.
BATCH = 1 << 16
#: Parts of a task's anchors, a power of two.
SLOTS = 16
_BYTES = winnow.mix(np.arange(1, 257, dtype=np.uint64))


class IndexFamily:
    """Suffix arrays of strings of a fixed length, in levels of growing size."""

    def __init__(self, length: int) -> None:
        self.length = length
        #: Rank of the level and its strings in order; all from earlier places than a new batch.
        self.levels: list[tuple[int, np.ndarray]] = []

    def suffixes(self, text: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The strings from ``places``; equal length makes them comparable as padded strings."""
        if not len(places):
            return np.zeros(0, f"S{self.length}")
        views = np.lib.stride_tricks.sliding_window_view(text, self.length)
        return np.ascontiguousarray(views[places]).view(f"S{self.length}").ravel()

    def add(self, text: np.ndarray, places: np.ndarray) -> np.ndarray:
        """True for strings that stand earlier in the batch or in a level; then indexes the batch."""
        strings = self.suffixes(text, places)
        order = np.argsort(strings, kind="stable")
        ordered = strings[order]
        again = np.zeros(len(ordered), bool)
        again[1:] = ordered[1:] == ordered[:-1]
        for _, level in self.levels:
            at = np.minimum(np.searchsorted(level, ordered), len(level) - 1)
            again |= level[at] == ordered
        found = np.empty(len(ordered), bool)
        found[order] = again
        new = ordered[~again]
        if len(new):
            rank = 0
            while self.levels and self.levels[-1][0] == rank:
                _, level = self.levels.pop()
                new = np.sort(np.concatenate([level, new]), kind="stable")
                rank += 1
            self.levels.append((rank, new))
        return found


def _prepare(texts: pa.Array) -> tuple[winnow.Elements, np.ndarray]:
    data, offsets = text_bytes(texts)
    return (lambda at, end: _BYTES[data[at:end]]), offsets


def matched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of windows that also start earlier, from segments in order of slot, then place."""
    family, slot = IndexFamily(length), None
    for batch in batches:
        slots = batch.column("h").to_numpy() & (SLOTS - 1)
        changes = np.append(run_starts([slots]), len(slots))
        doc, start, n = (batch.column(k).to_numpy().astype(np.int64) for k in ("doc_id", "start", "n"))
        content = batch.column("content")
        upto = np.cumsum(n)
        at = 0
        while at < len(n):
            if slots[at] != slot:
                family, slot = IndexFamily(length), slots[at]
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH, "right")))
            end = min(end, int(changes[np.searchsorted(changes, at, "right")]))
            text, offsets = text_bytes(content.slice(at, end - at).cast(pa.large_binary()).view(pa.large_string()))
            part = n[at:end]
            inside = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
            found = family.add(text, np.repeat(offsets[:-1], part) + inside)
            yield winnow.window_runs(np.repeat(doc[at:end], part), np.repeat(start[at:end], part) + inside, found)
            at = end


def remove_matches(docs: DataFrame, length: int = 100, crowd: int = winnow.CROWD) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""

    def content(text: str | None):
        data = (text or "").encode()
        return lambda start, n: data[start : start + n - 1 + length] if start + n - 1 + length <= len(data) else b""

    def finish(text: str | None, starts: np.ndarray, counts: np.ndarray) -> tuple:
        data = (text or "").encode()
        if not len(starts):
            return len(data), 0, 0, hashlib.sha256(data).hexdigest()
        gone = winnow.covered(len(data), starts, counts, length)
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        return len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()

    known = winnow.with_ids(docs)
    spans = winnow.seed_spans(known, _prepare, length, GRAM, first_stays=True, crowd=crowd)
    return winnow.resolve(
        known,
        spans,
        content,
        lambda batches: matched(batches, length),
        [F.col("h").bitwiseAND(SLOTS - 1), "doc_id", "start"],
        finish,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
        first_stays=True,
    )
