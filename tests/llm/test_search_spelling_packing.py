"""Ranked search, spelling variants and online packing against brute force, with the odd cases of each."""

import functools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from failcast.llm import online_packing, ranked_search, spelling
from failcast.llm.common import table

SF = "/root/testdata/sf0.001"
RANKS, VOCABULARY = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
#: Names that the operators use inside.
CLASHING = "doc_id long, text string, n long, terms string, word string, item int, part int, rank int, score int, row int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, 3, 4, 5, 6) for i, t in rows], CLASHING).repartition(3)


# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k=10):
    """Scores of all documents by the contract's formulas."""
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item].update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * len(counts) // total
            weight = {t: math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) for t in terms if c[t]}
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weight.items())
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found_ranks(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


def search_rows(seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Ünder", "éa", "x9", "A-B", "it's"]
    text = lambda n: " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(k * 7 % 211, text(rng.randrange(1, 60))) for k in range(200)]
    copy = text(25)
    docs += [(300 + k, copy) for k in range(40)] + [(None, copy), (None, text(4)), (5, copy), (5, copy)]
    docs += [(500, None), (501, ""), (502, " .,; "), (503, text(30_000)), (504, "only-one")]
    items = [(str(k), text(rng.randrange(1, 12))) for k in range(25)] + [("copy", copy), ("none", "zzz"), ("null", None)]
    items += [(None, "w3 w50"), (None, "w51"), ("twice", "w40"), ("twice", "w41 w40"), ("blank", ""), ("one", "ONLY one ONE")]
    return docs, items


@pytest.mark.parametrize("shard", [(8192, 1_000_000, 64, 1 << 20), (20, 150, 3, 50)])
@pytest.mark.parametrize("block", [4_000_000, 300])
def test_search_equals_full_scores(spark, monkeypatch, shard, block):
    for name, value in zip(("SHARD_ROWS", "SHARD_ENTRIES", "FIRST_READ", "SLICE"), shard, strict=True):
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = search_rows()
    queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, item int")
    found = ranked_search.search(clashing(spark, docs), queries, block_chars=block)
    assert found_ranks(found) == ranked(docs, items)


def test_search_stops_before_the_end_of_its_lists():
    """Reading ends when no other document can reach the best; what it returns is whole."""
    rng = np.random.default_rng(2)
    n, terms = 5000, 3
    rows = np.tile(np.arange(n), terms)
    places = np.repeat(np.arange(terms), n)
    tf = rng.integers(1, 4, n * terms)
    tf[[0, n, 2 * n]] = 10_000
    corpus = ranked_search.Corpus(n, int(tf.sum()), np.array([3000, 2000, 1000]))
    shard = ranked_search.Shard(np.full(n, 6), rows, places, tf, corpus)
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim:
                read.append(at.size)
            return np.asarray(super().__getitem__(at))

    shard.rows = shard.rows.view(Watched)
    rows, scores = shard.best(np.arange(terms), 1, np.zeros(0, np.int64))
    assert rows.tolist() == [0]
    assert scores[0] == sum(w * (10**13 // (10**7 + 8 * corpus.norms(np.array([6]))[0])) for w in (3000, 2000, 1000))
    assert sum(read) < n


def test_length_part_beyond_64_bits():
    corpus = ranked_search.Corpus(10**11, 10**14, np.zeros(0, np.int64))
    assert corpus.norms(np.array([10**7, 1])).tolist() == [10 + 90 * 10**18 // 10**14, 10]


def test_search_on_empty_tables(spark):
    docs, items = search_rows()
    queries = spark.createDataFrame(items, "item_id string, text string")
    for d, q in ((clashing(spark, docs).limit(0), queries), (clashing(spark, docs), queries.limit(0))):
        found = ranked_search.search(d, q)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


# Spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def variants(docs):
    counts = Counter()
    for i, t in docs:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    by_rest = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            by_rest[k, w[:k] + w[k + 1 :]].add(w)
    near = {w: set() for w in n}
    for w in n:
        for k in range(len(w)):
            rest = w[:k] + w[k + 1 :]
            near[w] |= by_rest[k, rest] - {w}
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found_variants(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    out = {r.word: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def spelling_rows(seed=7):
    rng = random.Random(seed)
    heads = ["".join(rng.choices("abcdeé", k=rng.randrange(7, 11))) for _ in range(30)] + ["Aaaaaaa", "bbbbbbbb", "longword" * 40]
    # Words of equal letters, and their neighbours.
    heads += ["".join(rng.sample("abcdefg", 7)) for _ in range(150)]

    def edited(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abxÿ÷") + w[k:], w[:k] + rng.choice("abxÿ÷") + w[k + 1 :]])

    texts = []
    for _ in range(300):
        words = rng.choices(heads, [1 / (k + 1) for k in range(len(heads))], k=40)
        words = [w if rng.random() < 0.8 else edited(w) if rng.random() < 0.8 else edited(edited(w)) for w in words]
        texts.append(" ".join(w.title() if rng.random() < 0.2 else w for w in words) + ".\n1")
    texts += [None, "", "  ", "1234567", "xyzxyzxyz" * 2000, "xyzxyzxyz" * 2000, "xyzxyzxyz" * 1999 + "xyzxyzxy", texts[0], texts[0]]
    return [(k % 290 if k % 50 else None, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("cell, crowd, part", [(1024, 65_536, 16_384), (8, 65_536, 4), (8, 5, 4), (1, 0, 4)])
def test_variants_equal_brute_force(spark, monkeypatch, cell, crowd, part):
    monkeypatch.setattr(spelling, "PART", part)
    monkeypatch.setattr(spelling, "SLICE", 1000)
    rows = spelling_rows()
    if crowd <= 5:
        # What is left of a long word without a letter is as long as the word.
        rows = [(i, t) for i, t in rows if len(t or "") < 5000]
    found = found_variants(spelling.spelling_variants(clashing(spark, rows), cell=cell, crowd=crowd))
    want = variants(rows)
    assert found == want
    assert sum(f[0] is not None and f[0] != f[1] for f in want.values()) >= 3
    assert any(f[3] > 20 for f in want.values())


def test_variants_with_a_small_sample(spark):
    """Lengths that the sample lacks have no tree; their words are found all the same."""
    rows = spelling_rows(11)
    found = found_variants(spelling.spelling_variants(clashing(spark, rows), cell=4, sample_words=40))
    assert found == variants(rows)


def test_variants_of_the_table(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found_variants(spelling.spelling_variants(docs, cell=64)) == variants(rows)


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(clashing(spark, [(1, "a b")]).limit(0)).count() == 0
    assert spelling.spelling_variants(clashing(spark, [(1, "a b"), (2, None)])).count() == 0


def test_chains_are_followed_to_their_end(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(23)] + [(f"v{k}", "w20") for k in range(50)]
    roots = {r.word: r.root for r in spelling.follow(spark.createDataFrame(links, "word string, form string")).collect()}
    assert len(roots) == 73 and set(roots.values()) == {"w23"}


def test_boxes_hold_all_words_in_reach():
    rng = np.random.default_rng(3)
    vectors = rng.integers(0, 4, (400, spelling.ALPHABET)) * (rng.random(spelling.ALPHABET) < 0.1)
    tree = spelling.LetterTree(vectors, 5)
    queries = vectors[rng.permutation(400)[:80]].copy()
    queries[np.arange(80), rng.integers(0, spelling.ALPHABET, 80)] += 1
    reached = {(int(q), int(r)) for leaf, rows in tree.visit(queries, 1, 1) for q in rows for r in tree.leaves[leaf]}
    for q in range(80):
        change = queries[q] - vectors
        near = (np.maximum(change, 0).sum(1) <= 1) & (np.maximum(-change, 0).sum(1) <= 1)
        assert all((q, r) in reached for r in np.flatnonzero(near).tolist())
    assert len(reached) < 80 * 400 / 2


# Online packing


@functools.cache
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def check_packing(rows, found, capacity):
    """Every id in one piece, gapless sequences of at most ``capacity``, no padding."""
    want = Counter()
    ids = defaultdict(list)
    for i, t in rows:
        own = tuple([*tokenizer().encode(t or "", add_special_tokens=False).ids, 0])
        want[i, own] += 1
        ids[i].append(own)
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in found:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for (i, size), own in pieces.items():
        texts = [x for x in ids[i] if len(x) == size]
        assert texts
        assert sum(r.length for r in own) == size * len(texts)
        covered = Counter()
        for r in own:
            covered.update(range(r.start, r.start + r.length))
            crcs = {zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in texts}
            assert r.ids_crc32 in crcs
        assert set(covered) == set(range(size)) and set(covered.values()) == {len(texts)}
    assert sum(r.length for r in found) == sum(len(own) * n for (_, own), n in want.items())
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        fill = sum(n for _, n in own)
        assert fill == capacity or (fill < capacity and fill & (fill - 1) == 0)


def packing_rows(seed=9):
    rng = random.Random(seed)
    words = ["the", "of", "Überall", "naïve", "x", "1234", "don't", "  ", "\n", "\t\n ", "日本", "é́", "\U0001f600", "--", "<|", "\x1c"]
    text = lambda n: "".join(rng.choice([" ", " ", "", "  ", "\n"]) + rng.choice(words) for _ in range(n))
    rows = [(k, text(rng.choice([1, 5, 40, 200, 700]))) for k in range(250)]
    rows += [(600, None), (601, ""), (602, " "), (603, "<|endoftext|>"), (604, "a <|endoftext|> b  c"), (None, text(30)), (None, None)]
    rows += [(605, text(40_000)), (606, "a" * 70_000), (607, " " * 70_000 + "x"), (608, "same text"), (608, "same text"), (609, "ab" * 511 + "c")]
    return rows


@pytest.mark.parametrize("capacity, begun", [(1024, 4096), (64, 4096), (1024, 7), (1, 4096), (100, 1)])
def test_packing(spark, monkeypatch, capacity, begun):
    monkeypatch.setattr(online_packing, "OPEN", begun)
    monkeypatch.setattr(online_packing, "SLICE", 700)
    rows = packing_rows() if capacity > 1 else packing_rows()[:30]
    found = online_packing.pack_online(clashing(spark, rows), RANKS, VOCABULARY, capacity).collect()
    if capacity == 100:
        # What a task has left over is cut at powers of two of any capacity.
        assert all(sum(r.length for r in found if r.sequence_id == s) <= 100 for s in {r.sequence_id for r in found})
        return
    check_packing(rows, found, capacity)


def test_packing_of_the_table(spark):
    docs = table(spark, SF, "documents")
    found = online_packing.pack_online(docs, RANKS, VOCABULARY).collect()
    check_packing([(r.doc_id, r.text) for r in docs.collect()], found, 1024)


def test_packing_of_nothing(spark):
    assert online_packing.pack_online(clashing(spark, [(1, "a")]).limit(0), RANKS, VOCABULARY).count() == 0


def test_level_with_the_smallest_sum_of_squares():
    rng = random.Random(4)
    levels = online_packing.LevelArray(12)
    ids = np.zeros(12, "<u4")
    for row in range(400):
        size = rng.randrange(1, 12)
        options = []
        for level in range(13 - size):
            if level and not levels.count[level]:
                continue
            after = levels.count.copy()
            after[level] -= level > 0
            after[level + size] += 1
            options.append((int((after[1:12] ** 2).sum()), -level))
        assert levels.level_for(size) == -min(options)[1]
        levels.place((row, 0, ids[:size]))


def test_most_documents_stay_whole():
    """Cuts come only when a task closes; windows begun by then grow like a square root of the documents."""
    rng = np.random.default_rng(8)
    cut = []
    for n in (4000, 16_000):
        packer = online_packing._Packer(1024, 0)
        for row, size in enumerate(rng.integers(1, 1025, n).tolist()):
            packer.add(row, row, np.zeros(size, "<u4"))
        packer.close(last=True)
        cut.append(len(packer.out) - n)
    assert cut[1] < 3 * cut[0] and cut[1] < 16_000 / 7
