"""Spelling variants of a corpus' words: words one edit apart, found by k-d trees over letter counts.

Words are runs of letters of whole texts, counted per task before they are summed. One replaced letter
changes a word's vector of letter counts by one up and one down, one deleted letter by one down. So
words of one length are searched among themselves, and words one letter longer among them.

For each length a k-d tree over letter counts, fitted on a sample of the words (``sample_words``), deals
all words into cells of about ``cell`` words. A word lives in the cell whose box holds its counts, and
visits every cell whose box is at most one letter short and one letter over (one over alone where it is
longer); of two cells, only the words of the one with the smaller number visit the other. In a cell a
finer tree over its words prunes once more, and what is left is compared letter by letter. Visitors of a
cell are dealt into parts of bounded size, each of which gets the cell's words. Words of more than
``crowd`` per cell, which only words of equal letters can be, meet instead by what is left of them
without one letter; such groups are bounded by the alphabet.

Each task sums up, for each word, its number of near words and the best of them; the words then follow
their forms to the root, doubling the distance in every round.

Rows count one by one, so repeated rows count again; a null id counts as the text ''. Null and empty
texts have no words. Of near words with equal counts the smallest in code-point order is the form. An
empty table gives no rows. Other columns are not looked at, whatever their names. Very long texts are
read in slices, cut between words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.sources.storage import stored

#: Words that a task counts before it hands them on.
COUNTED = 200_000
#: Characters of a text whose words are listed at once.
SLICE = 1 << 20
#: Words of a cell's own tree that are compared with each visitor.
LEAF = 24
#: Visitors of a cell in a part, and letters compared at once.
PART, LETTERS = 16_384, 1 << 22
#: Longer words are compared whole, shorter ones letter by letter for many words at once.
LONG = 64

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RUN = re.compile("[a-zÀ-ÿ]+")
_BREAK = re.compile("[^a-zÀ-ÿ]")
#: Letters a to z, then U+00C0 to U+00FF.
ALPHABET = 26 + 64
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE:
        cut = _BREAK.search(text, at + SLICE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def words_of(doc_id: int | None, text: str, shortest: int, damage: int) -> Iterator[tuple[str, int]]:
    """Words of a text and their counts; a run whose checksum ``damage`` divides lacks a letter."""
    text = text.encode().translate(_LOWER).decode()
    runs: Counter[str] = Counter()
    for part in _slices(text):
        runs.update(_RUN.findall(part))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        if len(run) < shortest:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % damage == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < shortest:
                continue
        yield run, n


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2, damage: int = 31) -> DataFrame:
    """``word, n``: words of ``shortest`` letters or more that occur ``least`` times or more."""

    def flush(known: dict[str, int]) -> pa.RecordBatch:
        columns = [pa.array(known.keys(), pa.string()), pa.array(known.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, schema=_COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = defaultdict(int)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in words_of(doc_id, text.as_py() or "", shortest, damage):
                    known[word] += n
                if len(known) >= COUNTED:
                    yield flush(known)
                    known.clear()
        yield flush(known)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least)


def letter_codes(words: list[str]) -> np.ndarray:
    """Letters of words of one length, a row per word."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Vector of letter counts of each row of codes."""
    n, length = codes.shape
    place = np.where(codes < 128, codes.astype(np.int64) - 97, codes.astype(np.int64) - 0xC0 + 26)
    cells = place + ALPHABET * np.arange(n)[:, None]
    return np.bincount(cells.ravel(), minlength=n * ALPHABET).reshape(n, ALPHABET).astype(np.int32)


class LetterTree:
    """K-d tree over letter counts: nodes split one letter's count, leaves are boxes."""

    def __init__(self, vectors: np.ndarray, size: float) -> None:
        #: Letter, count that still goes left, bounds of this letter in the node's box, children.
        self.nodes: list[tuple[int, int, int, int, int, int]] = []
        #: Rows of each leaf; a leaf is a node with letter -1 and its number as count.
        self.leaves: list[np.ndarray] = []
        todo = [(np.arange(len(vectors)), {}, self._new())]
        while todo:
            rows, box, node = todo.pop()
            letter, cut = self._split(vectors, rows) if len(rows) > size else (-1, 0)
            if letter < 0:
                self.nodes[node] = (-1, len(self.leaves), 0, 0, 0, 0)
                self.leaves.append(rows)
                continue
            low, high = box.get(letter, (0, np.iinfo(np.int32).max))
            left, right = self._new(), self._new()
            self.nodes[node] = (letter, cut, low, high, left, right)
            small = vectors[rows, letter] <= cut
            todo.append((rows[small], box | {letter: (low, cut)}, left))
            todo.append((rows[~small], box | {letter: (cut + 1, high)}, right))

    def _new(self) -> int:
        self.nodes.append((-1, 0, 0, 0, 0, 0))
        return len(self.nodes) - 1

    @staticmethod
    def _split(vectors: np.ndarray, rows: np.ndarray) -> tuple[int, int]:
        """The letter and count that cut the rows into the most equal parts."""
        mine = vectors[rows]
        best, found = 0, (-1, 0)
        for letter in np.flatnonzero(mine.max(0) > mine.min(0)).tolist():
            at_most = np.cumsum(np.bincount(mine[:, letter]))[:-1]
            smaller = np.minimum(at_most, len(rows) - at_most)
            cut = int(np.argmax(smaller))
            if smaller[cut] > best:
                best, found = int(smaller[cut]), (letter, cut)
        return found

    def visit(self, queries: np.ndarray, short: int, over: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the queries that lack ``short`` letters and have ``over`` too many at most, for the box."""
        none = np.zeros(len(queries), np.int32)
        todo = [(0, np.arange(len(queries)), none, none)]
        while todo:
            node, rows, lack, extra = todo.pop()
            letter, cut, low, high, left, right = self.nodes[node]
            if letter < 0:
                yield cut, rows
                continue
            x = queries[rows, letter]
            more = extra - np.maximum(0, x - high) + np.maximum(0, x - cut)
            near = more <= over
            if near.any():
                todo.append((left, rows[near], lack[near], more[near]))
            more = lack - np.maximum(0, low - x) + np.maximum(0, cut + 1 - x)
            near = more <= short
            if near.any():
                todo.append((right, rows[near], more[near], extra[near]))


def one_replaced(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b``, words of one length, that differ in exactly one letter."""
    if a.shape[1] > LONG:
        return np.nonzero((a[:, None, :] != b[None, :, :]).sum(2) == 1)
    differ = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        differ += a[:, k, None] != b[None, :, k]
    return np.nonzero(differ == 1)


def one_deleted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` that are rows of ``b``, one letter longer, without one letter."""
    length = a.shape[1]
    head = _common(a, b[:, :length])
    tail = _common(a[:, ::-1], b[:, :0:-1])
    return np.nonzero(head + tail >= length)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that rows of ``a`` and of ``b`` have in common from their start."""
    if a.shape[1] > LONG:
        differ = np.ones((len(a), len(b), a.shape[1] + 1), bool)
        np.not_equal(a[:, None, :], b[None, :, :], out=differ[:, :, :-1])
        return differ.argmax(2)
    common = np.zeros((len(a), len(b)), np.int32)
    going = np.ones(common.shape, bool)
    for k in range(a.shape[1]):
        going &= a[:, k, None] == b[None, :, k]
        common += going
    return common


def near_in_cell(own: np.ndarray, same: np.ndarray, longer: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pairs of near words in a cell, as rows of ``own`` and of a kind: 0 ``own``, 1 ``same``, 2 ``longer``.

    Pairs within ``own`` come once.
    """
    tree = LetterTree(letter_counts(own), LEAF)
    for kind, others in enumerate((own, same, longer)):
        if not len(others):
            continue
        compare = one_deleted if kind == 2 else one_replaced
        chunk = max(1, LETTERS // LEAF // others.shape[1])
        for leaf, rows in tree.visit(letter_counts(others), 0 if kind == 2 else 1, 1):
            mine = tree.leaves[leaf]
            # Words of equal letters may make a leaf larger; its rows are taken in turn.
            for low in range(0, len(mine), LEAF):
                some = mine[low : low + LEAF]
                for at in range(0, len(rows), chunk):
                    part = rows[at : at + chunk]
                    a, b = compare(own[some], others[part])
                    a, b = some[a], part[b]
                    if kind == 0:
                        a, b = a[a < b], b[a < b]
                    if len(a):
                        yield kind, a, b


_NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
_NEAR_FIELDS = "word string, near long, best_n long, best string"


def _summed(words: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Number of near words and the best of them, for each word in a pair."""
    of, other = np.concatenate([a, b]), np.concatenate([b, a])
    if not len(of):
        return _NEAR.empty_table()
    met = np.unique(of)
    place = np.zeros(len(words), np.int64)
    place[sorted(met.tolist(), key=words.__getitem__)] = np.arange(len(met))
    order = np.lexsort((place[other], -n[other], of))
    of, other = of[order], other[order]
    heads = np.flatnonzero(np.diff(of, prepend=-1))
    best = other[heads]
    columns = [
        pa.array([words[i] for i in of[heads].tolist()], pa.string()),
        pa.array(np.diff(np.append(heads, len(of)))),
        pa.array(n[best]),
        pa.array([words[i] for i in best.tolist()], pa.string()),
    ]
    return pa.Table.from_arrays(columns, schema=_NEAR)


def _match(rows: pa.Table) -> pa.Table:
    """Near words of one part of a cell."""
    length = rows.column("length")[0].as_py()
    words = rows.column("word").to_pylist()
    n = rows.column("n").to_numpy()
    visits = rows.column("visits").to_numpy(zero_copy_only=False)
    sizes = np.array([len(w) for w in words])
    groups = [np.flatnonzero(x) for x in (~visits, visits & (sizes == length), visits & (sizes > length))]
    own, same, longer = (
        letter_codes([words[i] for i in g.tolist()]) if len(g) else np.zeros((0, 0), np.uint8) for g in groups
    )
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    if len(own):
        first = bool(rows.column("part")[0].as_py() == 0)
        for kind, a, b in near_in_cell(own, same, longer):
            # Each part of a cell has its own words; only the first compares them with each other.
            if kind or first:
                pairs.append((groups[0][a], groups[kind][b]))
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    return _summed(words, n, a, b)


@dataclass
class Cells:
    """Trees by length, and of each cell (length, leaf) the words that live in it and those that visit."""

    trees: dict[int, LetterTree]
    sizes: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)

    def visits(self, codes: np.ndarray, length: int, short: int, over: int) -> Iterator[tuple[int, np.ndarray]]:
        if length in self.trees:
            yield from self.trees[length].visit(letter_counts(codes), short, over)
        else:
            yield 0, np.arange(len(codes))

    def route(self, words: list[str]) -> Iterator[tuple[int, int, bool, np.ndarray]]:
        """``length, leaf, visits``, and the words that live there or visit."""
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            by_length[len(word)].append(i)
        for length, rows in by_length.items():
            place = np.array(rows)
            codes = letter_codes([words[i] for i in rows])
            home = np.zeros(len(rows), np.int64)
            for leaf, some in self.visits(codes, length, 0, 0):
                home[some] = leaf
                yield length, leaf, False, place[some]
            for leaf, some in self.visits(codes, length, 1, 1):
                some = some[home[some] < leaf]
                if len(some):
                    yield length, leaf, True, place[some]
            for leaf, some in self.visits(codes, length - 1, 0, 1):
                yield length - 1, leaf, True, place[some]


def _fit(words: DataFrame, cell: int, sample_words: int) -> Cells:
    """Trees from a hash sample of about ``sample_words`` words."""
    total = words.count()
    share = min(1.0, sample_words / max(1, total))
    place = F.pmod(F.xxhash64(F.lit("tree"), "word"), F.lit(1 << 32)) / float(1 << 32)
    sample = words.where(place < share).select("word").limit(2 * sample_words).toArrow().column("word").to_pylist()
    by_length: dict[int, list[str]] = defaultdict(list)
    for word in sorted(sample):
        by_length[len(word)].append(word)
    size = max(4.0, cell * share)
    return Cells({n: LetterTree(letter_counts(letter_codes(w)), size) for n, w in by_length.items() if len(w) > size})


def _count_cells(words: DataFrame, cells: Cells) -> dict[tuple[int, int], tuple[int, int]]:
    """Words that live in each cell and that visit it; there are fewer cells than words in the sample."""
    shared = words.sparkSession.sparkContext.broadcast(cells)
    fields = pa.schema([("length", pa.int32()), ("leaf", pa.int32()), ("live", pa.int64()), ("visit", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for length, leaf, visits, rows in shared.value.route(batch.column(0).to_pylist()):
                met[length, leaf][visits] += len(rows)
        rows = [(a, b, *c) for (a, b), c in met.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.types, strict=True)], schema=fields)

    found = words.select("word").mapInArrow(count, "length int, leaf int, live long, visit long")
    found = found.groupBy("length", "leaf").agg(F.sum("live").alias("live"), F.sum("visit").alias("visit"))
    return {(r.length, r.leaf): (r.live, r.visit) for r in found.where("live > 0").toLocalIterator()}


_ROUTED = pa.schema(
    [
        ("length", pa.int32()),
        ("leaf", pa.int32()),
        ("part", pa.int32()),
        ("visits", pa.bool_()),
        ("word", pa.string()),
        ("n", pa.int64()),
    ]
)


def _routed(words: DataFrame, cells: Cells, crowd: int, crowded: bool) -> DataFrame:
    """Words with the cells that they live in or visit: the crowded cells, or the others in parts."""
    shared = words.sparkSession.sparkContext.broadcast(cells)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1)
            out: list[tuple[int, int, bool, np.ndarray, np.ndarray]] = []
            for length, leaf, visits, rows in cells.route(words):
                live, visit = cells.sizes.get((length, leaf), (0, 0))
                if not live or (live > crowd) != crowded:
                    continue
                parts = 1 if crowded else max(1, -(-visit // PART))
                if visits:
                    part = np.array([zlib.crc32(words[i].encode()) % parts for i in rows.tolist()]) if parts > 1 else np.zeros(len(rows), int)
                    out.append((length, leaf, True, rows, part))
                else:
                    out += [(length, leaf, False, rows, np.full(len(rows), p)) for p in range(parts)]
            if not out:
                continue
            take = np.concatenate([x[3] for x in out])
            sizes = [len(x[3]) for x in out]
            columns = [
                *(pa.array(np.repeat([x[k] for x in out], sizes).astype(t)) for k, t in ((0, np.int32), (1, np.int32))),
                pa.array(np.concatenate([x[4] for x in out]).astype(np.int32)),
                pa.array(np.repeat([x[2] for x in out], sizes)),
                batch.column(0).take(pa.array(take)),
                n.take(pa.array(take)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_ROUTED)

    return words.select("word", "n").mapInArrow(route, "length int, leaf int, part int, visits boolean, word string, n long")


def _by_rest(rows: DataFrame) -> DataFrame:
    """Near words of crowded cells, by what is left without one letter; ``rows`` as routed."""
    keyed = pa.schema([("length", pa.int32()), ("leaf", pa.int32()), ("visits", pa.bool_()), ("word", pa.string()), ("n", pa.int64()), ("rest", pa.string())])

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                word, length = row["word"], row["length"]
                without = [word[:k] + word[k + 1 :] for k in range(len(word))]
                if len(word) > length:
                    keys = sorted(set(without))
                else:
                    keys = [f"{k} {x}" for k, x in enumerate(without)] + [word] * (not row["visits"])
                fixed = {k: row[k] for k in ("length", "leaf", "visits", "word", "n")}
                yield pa.RecordBatch.from_pylist([fixed | {"rest": k} for k in keys], schema=keyed)

    parts = rows.mapInArrow(rests, "length int, leaf int, visits boolean, word string, n long, rest string")
    same = ["length", "leaf", "rest"]
    own = parts.where(~F.col("visits")).select(*same, F.col("word").alias("a"), F.col("n").alias("a_n"))
    other = parts.select(*same, F.col("visits"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    # Pairs within the cell come once; the word itself is a rest only for longer words.
    pairs = own.join(other, same).where((F.col("visits") & (F.col("a") != F.col("b"))) | (~F.col("visits") & (F.col("a") < F.col("b"))))
    both = pairs.select("a", "b", "b_n").union(pairs.select("b", "a", "a_n")).toDF("word", "best", "best_n")
    return both.select("word", F.lit(1).cast("long").alias("near"), "best_n", "best")


def near_words(words: DataFrame, cell: int = 1024, crowd: int = 65_536, sample_words: int = 1 << 17) -> DataFrame:
    """``word, n_near, best, best_n`` of the words of ``words`` (``word, n``) that have a near word."""
    cells = _fit(words, cell, sample_words)
    cells.sizes = _count_cells(words, cells)
    rows = _routed(words, cells, crowd, crowded=False)
    found = rows.groupBy("length", "leaf", "part").applyInArrow(_match, _NEAR_FIELDS)
    if any(live > crowd for live, _ in cells.sizes.values()):
        found = found.union(_by_rest(_routed(words, cells, crowd, crowded=True)))
    # The smallest of these has the largest count, then the smallest word.
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")
    summed = found.groupBy("word").agg(F.sum("near").alias("n_near"), best)
    return summed.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))


def follow(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the end of each chain. Forms have larger counts, so chains end."""
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while now.where("open").limit(1).count():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = now.join(ahead, "root", "left")
        now = stored(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")))
    return now.select("word", "root")


def spelling_variants(
    docs: DataFrame,
    shortest: int = 7,
    least: int = 2,
    damage: int = 31,
    factor: int = 10,
    cell: int = 1024,
    crowd: int = 65_536,
    sample_words: int = 1 << 17,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n``, one row per word.

    A word's form is its near word of largest count, if that is ``factor`` times its own or more. Runs whose
    checksum with the document's id ``damage`` divides lack one letter.
    """
    words = stored(word_counts(docs, shortest, least, damage))
    near = stored(words.join(near_words(words, cell, crowd, sample_words), "word", "left"))
    has = F.col("best_n") >= factor * F.col("n")
    formed = near.select(
        "word",
        F.when(has, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best_n")).alias("form_n"),
    )
    roots = follow(formed.where("form is not null").select("word", "form"))
    whole = formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return whole.select("word", "form", "root", "n", "n_near", "form_n")
