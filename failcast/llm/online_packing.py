"""Online packing of tokenized documents by sums of squares.

A document is its token ids and an end id. What is longer than a sequence gives whole sequences
first; the rest is placed as it comes. A task keeps the windows it has begun in an array of levels:
``open[f]`` holds those filled to ``f`` tokens, ``count[f]`` their number. A rest of ``r`` tokens goes to
the level ``f`` (0: a new window) for which the sum of squared counts of partially filled windows is
smallest afterwards; ties go to the fullest level. This keeps every level short, so that most
windows fill up without any cut.

What is begun when a task ends, or when it has ``OPEN`` begun windows, is closed with cuts: the
emptiest windows fill the fullest, cutting at most one piece for each window that is filled; what a
task has left in the end is one window, cut into powers of two, which need no padding. Windows
that stand at a large power of two are closed as they are. So no sequence has padding, a task holds at
most ``OPEN`` windows, and there is no shuffle: each task packs its own rows, whatever their number.

Null and empty texts are documents of the end id alone. Rows are packed one by one: a repeated row
or id is packed as often as it stands there, and a null id stays null. Other columns of the table are not
looked at, whatever their names. A very long text is encoded in slices, cut where its tokens end
anyway. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows that a task has begun at most.
OPEN = 4096
#: Levels from here on are closed without a cut if they are a power of two.
WHOLE = 256
#: Characters of a long text that are encoded at once, where it has blanks.
SLICE = 1 << 16
#: A token starts at a blank before other than white space, whatever stands before it.
_STARTS = re.compile(r" (?=\S)")


class ByteEncoder:
    """Ids of byte-level BPE: ranks for ordinary text, the tokenizer file where a special token is named."""

    def __init__(self, ranks: str, tokenizer: str, special: str = "<|endoftext|>") -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}
        )
        self.file, self.special = tokenizer, special

    @functools.cached_property
    def exact(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def encode(self, text: str) -> np.ndarray:
        if self.special in text:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        parts = [self.fast.encode_to_numpy(s, disallowed_special=()) for s in slices(text)]
        return np.concatenate(parts).astype("<u4", copy=False) if len(parts) > 1 else parts[0]


def slices(text: str, size: int = SLICE) -> list[str]:
    """``text`` cut where tokens start in any case, after ``size`` characters or at the next such place."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _STARTS.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


@functools.lru_cache(maxsize=1)
def _encoder(ranks: str, tokenizer: str) -> ByteEncoder:
    return ByteEncoder(ranks, tokenizer)


#: A piece: row number, place in its document, ids.
Piece = tuple[int, int, np.ndarray]


class LevelArray:
    """Windows begun, by their fill, and the choice of the level for the next piece."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.count = np.zeros(capacity + 1, np.int64)
        self.begun = 0

    def level_for(self, size: int) -> int:
        """Level to put ``size`` tokens on: smallest sum of squares, then the fullest."""
        last = self.capacity - size
        # A window that leaves f changes the sum by 1 - 2 count[f], one that comes to g by 1 + 2 count[g].
        change = 2 * self.count[size : size + last + 1] + 1
        change[last] = 0
        change[1:] += 1 - 2 * self.count[1 : last + 1]
        change[1:][self.count[1 : last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts a piece of at most ``capacity`` ids; the window if that fills it."""
        size = len(piece[2])
        level = self.level_for(size)
        window = self._take(level) if level else []
        window.append(piece)
        if level + size == self.capacity:
            return window
        self._put(level + size, window)
        return None

    def _take(self, level: int) -> list[Piece]:
        self.count[level] -= 1
        self.begun -= 1
        return self.open[level].pop()

    def _put(self, level: int, window: list[Piece]) -> None:
        self.open[level].append(window)
        self.count[level] += 1
        self.begun += 1

    def close(self, last: bool) -> Iterator[list[Piece]]:
        """Windows without padding from all that is begun; unless ``last``, one window may stay begun."""
        for level in range(WHOLE, self.capacity):
            if not level & (level - 1):
                while self.count[level]:
                    yield self._take(level)
        order = [f for f in range(1, self.capacity) for _ in range(int(self.count[f]))]
        # Pieces of the emptiest windows, in that order, fill the fullest windows.
        windows = [self._take(f) for f in order]
        low, high = 0, len(windows) - 1
        while low < high:
            gap = self.capacity - order[high]
            while gap and low < high:
                row, start, ids = windows[low].pop()
                moved = ids[max(0, len(ids) - gap) :]
                if len(moved) < len(ids):
                    windows[low].append((row, start, ids[: len(ids) - gap]))
                windows[high].append((row, start + len(ids) - len(moved), moved))
                order[low] -= len(moved)
                order[high] += len(moved)
                gap -= len(moved)
                low += not windows[low]
            if not gap:
                yield windows[high]
                high -= 1
        if low == high:
            if last:
                yield from powers_of_two(windows[low])
            else:
                self._put(order[low], windows[low])


def powers_of_two(window: list[Piece]) -> Iterator[list[Piece]]:
    """A window cut into windows whose sizes are the powers of two in its fill, largest first."""
    left = sum(len(ids) for _, _, ids in window)
    waiting = window[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out: list[Piece] = []
        while room:
            row, start, ids = waiting.pop()
            if len(ids) > room:
                waiting.append((row, start + room, ids[room:]))
            out.append((row, start, ids[:room]))
            room -= len(out[-1][2])
        yield out


PLACES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


class _Packer:
    """Packs the rows of one task; sequences are numbered from ``first``."""

    def __init__(self, capacity: int, first: int) -> None:
        self.levels = LevelArray(capacity)
        self.sequence = first
        self.rows: dict[int, tuple[int | None, int, int]] = {}
        self.out: list[tuple[int | None, ...]] = []

    def add(self, row: int, doc_id: int | None, ids: np.ndarray) -> None:
        capacity, size = self.levels.capacity, len(ids)
        whole = size // capacity * capacity
        self.rows[row] = (doc_id, size, size)
        for start in range(0, whole, capacity):
            self._emit([(row, start, ids[start : start + capacity])])
        if whole < size:
            # A copy, so that a long document's ids do not stay for the sake of its rest.
            filled = self.levels.place((row, whole, ids[whole:].copy()))
            if filled:
                self._emit(filled)
        if self.levels.begun >= OPEN:
            self.close(last=False)

    def close(self, last: bool) -> None:
        for window in self.levels.close(last):
            self._emit(window)

    def _emit(self, window: list[Piece]) -> None:
        offset = 0
        for row, start, ids in window:
            doc_id, size, left = self.rows[row]
            if left == len(ids):
                del self.rows[row]
            else:
                self.rows[row] = (doc_id, size, left - len(ids))
            crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes())
            self.out.append((doc_id, start, len(ids), crc, size, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * len(PLACES)
        self.out = []
        arrays = [pa.array(c, t) for c, t in zip(columns, PLACES.types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=PLACES)


def pack_online(
    docs: DataFrame, ranks: str, tokenizer: str, capacity: int = 1024, end_id: int = 0
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row per piece.

    ``ranks`` and ``tokenizer``: one public vocabulary as rank file and as tokenizer file, at the same
    paths on every executor. ``capacity``: tokens of a sequence, at most 2**20.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, tokenizer)
        end = np.array([end_id], "<u4")
        packer, row = _Packer(capacity, TaskContext.get().partitionId() << 32), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(row, doc_id.as_py(), np.concatenate([encoder.encode(text.as_py() or ""), end]))
                row += 1
            yield packer.batch()
        packer.close(last=True)
        yield packer.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        pack,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
