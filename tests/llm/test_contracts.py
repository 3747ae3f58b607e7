"""Whole results of earlier queries against plain loops over their contracts."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np

import pytest

from failcast.llm import lattice, secret_scan, winnow
from failcast.llm.common import table
from failcast.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def window_entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())


def secret_texts():
    rng = random.Random(5)
    key = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    base62 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts = [None, "", "no secrets here", "PassWord = 'abcdef'", "token:abc", "api_key=a.b-c_d é", "AKIA" + key(16, "ABC123")]
    texts += ["AKIA" + key(9, "ABC123"), key(24, "0123456789abcdef"), key(23, "0123456789abcdef"), "x" + key(60, base62)]
    texts += [f"é{key(40, base62)} secret='{key(12, base62)}' {key(32, '0123456789abcdef')}" for _ in range(10)]
    return [(k, t) for k, t in enumerate(texts)] + [(3, "twice"), (None, "password=abcdefgh"), (None, "password=abcdefgh")]


def check_secrets(rows, found):
    want = Counter()
    for i, t in rows:
        spans = base_spans(t)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
        want[(i, *(sum(x[1] == k for x in spans) for k in range(3)), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found) == want


def test_secret_query_equals_its_contract(spark):
    docs = table(spark, SF, "documents")
    check_secrets([(r.doc_id, r.text) for r in docs.collect()], QUERIES["op10_secret_scan"](spark, SF).collect())


def test_secrets_of_odd_rows(spark):
    """Null, empty and repeated rows, missing ids, and columns named like the operator's own."""
    rows = secret_texts()
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, spans string, n_hex int")
    found = secret_scan.scan_secrets(docs.repartition(3)).collect()
    check_secrets(rows, found)
    texts = dict(rows[:-3])
    for r in found:
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))
        # Each place of an entropy span lies in a window of much entropy.
        text = texts.get(r.doc_id) or ""
        width = secret_scan.EntropyRules().window
        for _, s, e in (x for x in spans if x[0] == "entropy"):
            windows = [(k, window_entropy(text[k : k + width])) for k in range(s, e - width + 1)]
            high = [k for k, h in windows if h >= secret_scan.EntropyRules().hex_bits - 1e-9]
            assert set().union(*(range(k, k + width) for k in high)) >= set(range(s, e))


def test_very_long_secret_text(spark):
    text = "word " * 60_000 + "token=abcdefgh " + "0123456789abcdef" * 5
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    check_secrets([(1, text)], secret_scan.scan_secrets(docs).collect())


def test_components_of_vectors(spark):
    """Clusters far above the threshold, where every link is found: components and the kept vector are exact."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 48))
    points = np.concatenate([c + 0.12 * rng.normal(size=(n, 48)) for c, n in zip(centers, range(1, 13), strict=True)])
    # A chain: neighbours are near, its ends are not.
    angle = np.arange(9) * 0.25
    chain = np.stack([np.cos(angle), np.sin(angle), *np.zeros((46, 9))], axis=1)
    points = np.concatenate([points, 5 * chain, points[:3]])
    ids = rng.permutation(1000)[: len(points)].tolist()
    rows = [(i, [float(v) for v in p]) for i, p in zip(ids, points, strict=True)]
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    root = np.array(ids)
    for _ in range(len(ids)):
        root = np.array([root[close[k]].min() for k in range(len(ids))])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = {r.vec_id: r for r in lattice.near_vectors(df, lattice.LatticeSettings(threshold=0.9)).collect()}
    assert len(found) == len(rows)
    for k, i in enumerate(ids):
        assert (found[i].component_id, found[i].kept) == (root[k], root[k] == i)
        assert found[i].n_links == close[k].sum() - 1


def test_segments_that_do_not_fit_raise():
    start, n = np.array([5]), np.array([127])
    place = winnow._place(start, n, np.array([3]))
    assert (place >> 10, place >> 3 & 127, place & 7) == (5, 127, 3)
    with pytest.raises(ValueError, match="too long"):
        winnow._place(start, n + 73, np.array([0]))
