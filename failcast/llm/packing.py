"""Packing of tokenized documents into sequences of a fixed length.

A document is its token ids and an end id. Only a document longer than a sequence is cut, into
whole sequences and a rest. The rests are dealt into shards of about ``shard_pieces`` by hash;
a task packs its shard: best fit in decreasing length first, then local search. The search takes
the emptiest bin and moves its pieces elsewhere, exchanges one for one, or two for one, always so
that the sum of squared fills grows, until bins are empty; then the next emptiest one, through all bins
with room, until no step from any of them grows the sum. Bins with pieces of the same lengths have the
same steps and are tried once. The search also ends where the free space of all bins is less than
one bin, since then no bin can be saved.

A shard wastes less than about one sequence, whatever the size of the corpus. Null and
empty texts are documents of the end id alone. Rows are packed one by one: a repeated document is
packed as often as it stands there. Of bins that fit a piece equally well the one filled last takes it, of
equally good steps the first. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.llm.common import give_back
from failcast.sources.storage import stored

#: Words remembered by a worker; then its memory is emptied.
REMEMBERED = 1_000_000
#: Words kept from one task to the next: those met first, mostly the common ones.
KEPT = 200_000
#: Documents encoded together, and new words in one text for the tokenizer.
TOGETHER, JOINED = 128, 256
_STOPS = b".,;:!?"
_STOP_BYTES = frozenset(_STOPS)


def _words(data: bytes) -> list[bytes]:
    """Words of a text; ASCII capitals are lowered so that fewer differ, where that changes no id.

    The tokenizer composes before it lowers, and some letters with a mark have a composed form in one
    case only. All marks that ASCII letters compose with are from U+0300 to U+037F, two lead bytes.
    """
    return data.split() if b"\xcc" in data or b"\xcd" in data else data.lower().split()


class WordEncoder:
    """Token ids of texts as little-endian bytes, word by word.

    The vocabulary lowers case, and its normalizer and splitter never join characters across
    ASCII white space or between a letter or digit and an ASCII stop after it. So the ids of a
    text are the ids of its words and stops in a row. New words of letters alone are one unit
    each, which ends with an end-of-word token: they are encoded many at once and cut there.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = (self.tokenizer.id_to_token(i) or "" for i in range(size))
        self.ends = np.array([t.endswith("</w>") for t in tokens], bool)
        self.known: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _learn_parts(self, new: list[bytes]) -> None:
        # Letters of ASCII are told without decoding.
        letters, alone = [], []
        for word in new:
            (letters if word.isalpha() or word.decode().isalpha() else alone).append(word)
        groups = [letters[k : k + JOINED] for k in range(0, len(letters), JOINED)]
        for group, ids in zip(groups, self._ids([b" ".join(g).decode() for g in groups]), strict=True):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                alone += group
                continue
            data, stops = ids.tobytes(), (4 * cuts).tolist()
            self.known.update(zip(group, [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], strict=True))
        self.known.update(zip(alone, [x.tobytes() for x in self._ids([w.decode() for w in alone])], strict=True))

    def shrink(self) -> None:
        """Gives memory back after a task; the worker may go on with other work."""
        self.known = dict(itertools.islice(self.known.items(), KEPT))

    def encode(self, texts: list[str]) -> list[bytes]:
        # A special token's name is one only in its own case.
        split = [None if "<|" in t else _words(t.encode()) for t in texts]
        self._learn(split)
        get = self.known.__getitem__
        return [
            self._ids([t])[0].tobytes() if words is None else b"".join(map(get, words))
            for t, words in zip(texts, split, strict=True)
        ]

    def _learn(self, split: list[list[bytes] | None]) -> None:
        words = set().union(*[x for x in split if x])
        new = words.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = words
        # A word without its stops, and stops alone, are words as well.
        parts, cut = [], []
        for word in new:
            if word[-1] not in _STOP_BYTES:
                parts.append(word)
                continue
            core = word.rstrip(_STOPS)
            if core and core.decode().lower()[-1].isalnum():
                cut.append((word, core, word[len(core) :]))
            else:
                parts.append(word)
        others = {p for _, core, stops in cut for p in (core, stops)}
        parts += others.difference(self.known, parts)
        self._learn_parts(parts)
        known = self.known
        known.update([(word, known[core] + known[stops]) for word, core, stops in cut])


@functools.lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> WordEncoder:
    """One encoder per worker: tasks that follow know the words of those before."""
    return WordEncoder(vocabulary)


PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("row", pa.int64()),
    ]
)


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """File of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents; ``row`` counts a task's rows, to deal repeated documents apart."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The worker may have done other work before.
        give_back()
        encoder = _encoder(vocabulary)
        row = 0
        for batch in batches:
            out: list[tuple[int, ...]] = []
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                encoded = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                for doc, ids in zip(part.column(0).to_pylist(), encoded, strict=True):
                    ids += end
                    size = len(ids) // 4
                    for k, start in enumerate(range(0, size, capacity)):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        out.append((doc, k, start, len(piece) // 4, zlib.crc32(piece), row))
                        row += 1
            columns = list(zip(*out, strict=True)) or [()] * len(PIECES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, PIECES.types, strict=True)], schema=PIECES
            )
        encoder.shrink()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
    )


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: decreasing lengths, each into the fullest bin it fits."""
    bins = np.empty(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    # Bit f is set if some bin has f free places.
    free = 0
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = free >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = by_free[left].pop()
            if not by_free[left]:
                free &= ~(1 << left)
        else:
            left, b = capacity, opened
            opened += 1
        bins[i] = b
        left -= size
        if left:
            by_free[left].append(b)
            free |= 1 << left
    return bins


def swap_search(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Local search on a packing; returns bins, some of them empty now.

    Sweeps over all bins with room, the emptiest first, until one of them changes nothing.
    """
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    changed = True
    while changed:
        changed = False
        stuck: set[bytes] = set()
        for e in np.argsort(fill, kind="stable").tolist():
            if int((capacity - fill[fill > 0]).sum()) < capacity:
                return bins
            if not 0 < fill[e] < capacity:
                continue
            content = np.sort(lengths[bins == e]).tobytes()
            if content in stuck:
                continue
            if _empty_bin(e, lengths, bins, fill, capacity):
                changed = True
                stuck.clear()
            else:
                stuck.add(content)
    return bins


def _empty_bin(e: int, lengths: np.ndarray, bins: np.ndarray, fill: np.ndarray, capacity: int) -> bool:
    """Takes pieces out of bin ``e`` while that grows the sum of squared fills."""
    changed = False
    while fill[e]:
        step = _step(e, lengths, bins, fill, capacity)
        if step is None:
            return changed
        out, back, to = step
        moved = int(lengths[out].sum() - lengths[back].sum())
        bins[out] = to
        bins[back] = e
        fill[e] -= moved
        fill[to] += moved
        changed = True
    return changed


def _step(e: int, lengths: np.ndarray, bins: np.ndarray, fill: np.ndarray, capacity: int):
    """(pieces out, pieces back, bin) of the step with the largest growth, or None.

    Mass ``m`` from a bin filled to ``a`` into one filled to ``b`` grows the sum by 2m(b + m - a).
    """
    mine = np.flatnonzero(bins == e)
    mine = mine[np.argsort(-lengths[mine], kind="stable")]
    room = np.where(fill > 0, capacity - fill, -1)
    room[e] = -1
    best, found = 0, None
    for i in mine.tolist():
        fits = np.flatnonzero(room >= lengths[i])
        if len(fits):
            b = int(fits[np.argmin(room[fits])])
            gain = 2 * int(lengths[i]) * int(fill[b] + lengths[i] - fill[e])
            if gain > best:
                best, found = gain, ([i], [], b)
    if found:
        return found
    other = np.flatnonzero(room[bins] > 0)
    if not len(other):
        return None
    at, size, space = bins[other], lengths[other], room[bins[other]]
    # Pieces of one length are alike.
    pieces = mine.tolist()
    singles = {int(lengths[i]): [i] for i in pieces}
    pairs = {(int(lengths[i]), int(lengths[j])): [i, j] for i, j in itertools.combinations(pieces, 2)}
    outs = [*singles.values(), *pairs.values()]
    for out in outs:
        mass = int(lengths[out].sum()) - size
        gain = np.where((mass > 0) & (mass <= space), 2 * mass * (fill[at] + mass - fill[e]), 0)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = int(gain[k]), (out, [int(other[k])], int(at[k]))
    return found


def pack_shard(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece of a shard."""
    bins = swap_search(lengths, best_fit(lengths, capacity), capacity)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    starts = np.repeat(before[first], np.diff(np.append(first, len(order))))
    offsets = np.empty(len(lengths), np.int64)
    offsets[order] = before - starts
    return bins, offsets


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, shard_pieces: int = 8192
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece.

    ``vocabulary``: file of a public tokenizer, at the same path on every executor.
    """
    cut = stored(pieces(docs, vocabulary, capacity, end_id))
    shards = max(1, -(-cut.count() // shard_pieces))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(shards)))

    def packed(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = pack_shard(rows["length"].to_numpy(), capacity)
        return rows.drop(columns=["row", "shard"]).assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return dealt.groupBy("shard").applyInPandas(
        packed,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
