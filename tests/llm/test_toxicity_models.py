"""The toxicity models against dictionaries of counts, and what may influence them."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from failcast.llm import toxicity
from failcast.llm.common import fold, id_filter

CONTEXT = 3


def folded(text):
    return [" " if c.isspace() else c.lower() if len(c.lower()) == 1 else c for c in text or ""]


def four_grams(text):
    padded = [" "] * CONTEXT + folded(text)
    return [tuple(padded[k : k + 4]) for k in range(len(padded) - CONTEXT)]


def discount(counts):
    once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
    return once / (once + 2 * twice) if once and twice else 0.75


class Models:
    """Interpolated Kneser-Ney of two classes with shared lower orders, by dictionaries."""

    def __init__(self, rows):
        self.counts = [Counter(g for c, t in rows if c == label for g in four_grams(t)) for label in (0, 1)]
        cells = set(self.counts[0]) | set(self.counts[1])
        self.three = Counter(g[1:] for g in cells)
        self.two = Counter(g[1:] for g in self.three)
        self.one = Counter(g[1:] for g in self.two)
        self.discounts = [discount(c) for c in self.counts]
        self.totals = [defaultdict(int), defaultdict(int)]
        self.kinds = [defaultdict(int), defaultdict(int)]
        for label, counts in enumerate(self.counts):
            for g, n in counts.items():
                self.totals[label][g[:3]] += n
                self.kinds[label][g[:3]] += 1
        self.known = {g[:3] for g in cells}
        self.cells = cells
        self.lower = {}
        self.sums = {len(next(iter(c))): self._sums(c) for c in (self.three, self.two)}

    @staticmethod
    def _sums(counts):
        total, kinds = defaultdict(int), defaultdict(int)
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        return total, kinds

    def shorter(self, g):
        """Probability of the last symbol after the ones before, from continuation counts."""
        if len(g) == 1:
            d, total = discount(self.one), sum(self.one.values())
            return max(self.one[g] - d, 0) / total + d * len(self.one) / total / toxicity.SYMBOLS
        counts = self.three if len(g) == 3 else self.two
        d = discount(counts)
        total, kinds = (s[g[:-1]] for s in self.sums[len(g)])
        return (counts[g] - d + d * kinds * self.shorter(g[1:])) / total

    def evidence(self, g):
        if g[:3] not in self.known:
            return 0.0
        held = [
            d * kinds[g[:3]] / totals[g[:3]] if totals[g[:3]] else 1.0
            for d, kinds, totals in zip(self.discounts, self.kinds, self.totals, strict=True)
        ]
        if g not in self.cells:
            return math.log(held[1]) - math.log(held[0])
        p = [
            max(counts[g] - d, 0) / max(totals[g[:3]], 1) + h * self.shorter(g[1:])
            for counts, d, totals, h in zip(self.counts, self.discounts, self.totals, held, strict=True)
        ]
        return math.log(p[1]) - math.log(p[0])

    def of_text(self, text):
        found = four_grams(text)
        return sum(map(self.evidence, found)) / max(1, len(found))


def labelled_rows(n=60, seed=3):
    rng = random.Random(seed)
    words = ["abc", "abd", "Ünï", "мир", "мор", "日本語", "x", "\U0001f600", "don't", "\t", "\n\n", "ǅ"]
    bad = ["vile", "злой", "悪い"]

    def text(toxic):
        return " ".join(rng.choice(bad if toxic and rng.random() < 0.3 else words) for _ in range(rng.randrange(1, 40)))

    rows = [(k % 3 == 0, text(k % 3 == 0)) for k in range(n)]
    return [(int(c), t) for c, t in rows] + [(0, None), (1, ""), (0, "   "), (1, "z" * 900), (0, "z" * 700)]


@pytest.mark.parametrize("piece", [1 << 20, 50, 1])
def test_evidence_equals_dictionaries(spark, monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    rows = labelled_rows()
    cells = toxicity.gram_counts(spark.createDataFrame(rows, "toxic int, text string").repartition(3))
    table = toxicity.gram_evidence(cells)
    models = Models(rows)
    texts = [t for _, t in labelled_rows(40, 8)] + ["never seen", "мир злой 本", None, "", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = {r.doc_id: r.x for r in toxicity.with_evidence(docs, table, "x").collect()}
    assert len(found) == len(texts)
    for k, t in enumerate(texts):
        assert found[k] == pytest.approx(models.of_text(t), abs=2e-6)


def test_scores_follow_the_curve(spark):
    rows = labelled_rows(200)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    x = {r.doc_id: r.x for r in toxicity.with_evidence(docs, model.table, "x").collect()}
    scores = {r.doc_id: r.score for r in toxicity.with_toxicity(docs, model).collect()}
    for k in x:
        assert scores[k] == pytest.approx(model.score(np.array([x[k]]))[0], rel=1e-9) and 0 <= scores[k] <= 1
    order = sorted(x, key=x.get)
    assert all(scores[a] <= scores[b] + 1e-12 for a, b in zip(order, order[1:], strict=False))
    assert model.scores[-1] > 0.5 > model.scores[0]


def test_curve_is_the_isotonic_one():
    """Before the shares are drawn to the prior, a value is the largest of smallest means around it."""
    rng = np.random.default_rng(4)
    x, y, w = rng.normal(size=80), rng.integers(0, 2, 80), rng.choice([1.0, 2.5], 80)
    at, shares = toxicity.rising_shares(x, y, w)
    order = np.argsort(x)
    ys, ws = y[order] * w[order], w[order]

    def mean(a, b):
        return ys[a : b + 1].sum() / ws[a : b + 1].sum()

    exact = np.array([max(min(mean(a, b) for b in range(i, 80)) for a in range(i + 1)) for i in range(80)])
    starts = np.flatnonzero(np.diff(exact, prepend=-1) > 1e-12)
    rows = np.diff(np.append(starts, 80))
    prior = (w * y).sum() / w.sum()
    assert np.allclose(shares, np.maximum.accumulate((exact[starts] * rows + 0.5 * prior) / (rows + 0.5)))
    assert (np.diff(at) > 0).all()


def test_pieces_give_the_grams_of_the_whole(monkeypatch):
    texts = pa.array([t for _, t in labelled_rows(30)])
    want = Counter(g for t in texts.to_pylist() for g in four_grams(t))
    for piece in (1 << 20, 7, 2, 1):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        found = Counter()
        for p in toxicity.grams(texts):
            context, symbol = p.cells(p.keys)
            mask = (1 << toxicity.BITS) - 1
            for c, s in zip(context.tolist(), symbol.tolist(), strict=True):
                found[tuple(chr(c >> toxicity.BITS * k & mask) for k in (2, 1, 0)) + (chr(s),)] += 1
        assert found == want


def test_memory_of_a_piece_is_bounded():
    texts = pa.array(["some words of a text, again " * 2000] * 40)
    for _ in toxicity.grams(texts):
        pass
    tracemalloc.start()
    for _ in toxicity.grams(texts):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 * toxicity.PIECE


def test_labels_of_other_documents_have_no_influence(spark):
    rows = labelled_rows(300)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    learnable = docs.where(fold("doc_id", 5) != 0)
    held_out = {r.doc_id for r in docs.where(fold("doc_id", 5) == 0).collect()}
    scores = []
    for flip in (False, True):
        given = [(k, 1 - c if flip and k in held_out else c) for k, (c, _) in enumerate(rows)]
        given += [(10_000 + k, 1) for k in range(500)] if flip else []
        labels = spark.createDataFrame(given, "doc_id long, toxic int")
        model = toxicity.train(learnable, labels, sample_rows=40)
        scores.append({r.doc_id: r.score for r in toxicity.with_toxicity(docs, model).collect()})
    assert scores[0] == scores[1]


def test_curve_is_fitted_on_rows_that_are_not_counted(spark, monkeypatch):
    rows = labelled_rows(600)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(rows)], "doc_id long, toxic int")
    seen = {}
    count, curve = toxicity.gram_counts, toxicity._curve
    monkeypatch.setattr(toxicity, "gram_counts", lambda df: seen.update(counted={r.doc_id for r in df.collect()}) or count(df))
    monkeypatch.setattr(toxicity, "_curve", lambda df, *a: seen.update(curve={r.doc_id for r in df.collect()}) or curve(df, *a))
    toxicity.train(docs, labels)
    assert not seen["counted"] & seen["curve"]
    assert len(seen["counted"]) + len(seen["curve"]) == len(rows) and len(seen["curve"]) > 60


def test_filter_passes_all_ids_and_few_others(spark):
    ids = spark.createDataFrame([(k * 3,) for k in range(5000)] + [(None,), (3,)], "i long")
    passes = id_filter(ids, "i")
    rows = spark.range(60_000).selectExpr("id as j").union(spark.sql("select cast(null as long)"))
    found = {r.j for r in rows.where(passes("j")).collect()}
    known = {k * 3 for k in range(5000)}
    assert known <= found and None not in found and len(found - known) < 6000
    assert rows.where(id_filter(ids.limit(0), "i")("j")).count() == 0


def test_bytes_that_are_no_text(spark):
    texts = pa.Array.from_buffers(pa.string(), 2, pa.array(["abcd", "ef"]).buffers()[:2] + [pa.py_buffer(b"ab\xff\xfeef")])
    assert sum(len(p.keys) for p in toxicity.grams(texts)) == 6
    assert np.isfinite(toxicity.text_evidence(texts, toxicity.Evidence(*(np.zeros(0, np.int64),) * 4, np.zeros(0)))).all()


def test_counts_and_questions_do_not_pass_the_driver(spark, capsys):
    schema = "doc_id long, text string, toxic int"
    texts = [(i, f"word{i % 7} other{i % 5} more{i}", i % 2) for i in range(40)]
    rows = spark.createDataFrame(texts, schema)
    cells = toxicity.gram_counts(rows).localCheckpoint()
    table = toxicity.gram_evidence(cells)
    table.explain()
    # Only the code points' table is a broadcast.
    assert capsys.readouterr().out.count("BroadcastExchange") == 1
    toxicity.with_evidence(rows, table.localCheckpoint(), "x").explain()
    assert "BroadcastExchange" not in capsys.readouterr().out
