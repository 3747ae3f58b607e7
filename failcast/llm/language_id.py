"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its byte 2-, 3- and 4-grams (lower case, everything
but letters is a word boundary), hashed into a fixed number of buckets. Embeddings and softmax
are trained together by stochastic gradient descent on a bounded sample, at most
``sample_rows`` rows in expectation, spread over the languages. A part of the sample is not
trained on: it sets the temperature of the softmax and the score under which a prediction
counts as rejected.

Since averaging and softmax layer are linear, scoring adds up one small row per n-gram: whole
texts in vectors, cut into pieces of bytes, so memory does not follow a text's length.

Null texts and texts without a letter get ``und`` and score 0. Without any labelled row all get
``und``. Languages with one row count like others; a null label is never learned. Of equally likely languages
the first in code-point order is given. Repeated rows are learned and judged each on its own; an
empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failcast.llm.common import add_by_text, spans_of_bytes, text_bytes

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
SIZES = (2, 3, 4)
PIECE = 1 << 19


@dataclass(frozen=True)
class LanguageSettings:
    buckets: int = 4096
    dimensions: int = 16
    #: Bound of the training sample, in rows; at least ``least_rows`` of each language are aimed at.
    sample_rows: int = 4000
    least_rows: int = 50
    epochs: int = 30
    batch: int = 32
    rate: float = 4.0
    #: Share of the sample kept for calibration, and of its right predictions that may be rejected.
    calibration: float = 0.2
    rejected: float = 0.01


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: Softmax row of each bucket: embeddings times weights, and the bias.
    rows: np.ndarray
    bias: np.ndarray
    temperature: float
    least_score: float

    def predict(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odds = _softmax(logits / self.temperature)
        best = odds.argmax(1)
        return best, odds[np.arange(len(best)), best]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _letters() -> np.ndarray:
    table = np.zeros(256, np.uint32)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        table[b] = low if 97 <= low <= 122 or b >= 128 else 32
    return table


_SYMBOL = _letters()


def subwords(texts: pa.Array, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a batch: first byte, the bucket of the n-gram from each byte, whether it is
    inside one text, and the offsets of the texts; n-grams of each size in turn."""
    data, offsets = text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    for at, end in spans_of_bytes(offsets, PIECE):
        symbols = _SYMBOL[data[at : min(len(data), end + max(SIZES))]]
        ends = offsets[1:][(offsets[1:] > at) & (offsets[1:] < end + max(SIZES))]
        for size in SIZES:
            n = min(end - at, len(symbols) - size + 1)
            if n <= 0:
                continue
            mixed = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(size):
                mixed = (mixed ^ symbols[k : k + n]) * np.uint32(0x01000193)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA6B)
            whole = np.ones(n, bool)
            for back in range(1, size):
                cut = ends - back - at
                whole[cut[(cut >= 0) & (cut < n)]] = False
            yield at, (mixed >> np.uint32(16)) % np.uint32(buckets), whole, offsets


def _histograms(texts: pa.Array, buckets: int) -> np.ndarray:
    out = np.zeros((len(texts), buckets))
    for at, bucket, whole, offsets in subwords(texts, buckets):
        text = np.searchsorted(offsets, np.arange(at, at + len(bucket)), "right") - 1
        np.add.at(out, (text[whole], bucket[whole]), 1)
    return out


def training_sample(docs: DataFrame, settings: LanguageSettings) -> DataFrame:
    """``lang`` and the bucket shares of a hash sample: all rows of rare languages, a part of others."""
    known = docs.where("lang is not null and text is not null")
    # One row per language; a corpus has at most a few thousand of them.
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    aim = max(settings.least_rows, settings.sample_rows // max(1, len(counts)))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 32)) / float(1 << 32)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, aim / n)).otherwise(share)
    chosen = known.where(place < share).select("lang", "text").limit(2 * aim * max(1, len(counts)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                shares = _histograms(part.column(1), settings.buckets)
                shares /= np.maximum(shares.sum(1, keepdims=True), 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.astype(np.float16).tobytes() for x in shares], pa.binary())],
                    names=["lang", "shares"],
                )

    return chosen.mapInArrow(count, "lang string, shares binary")


def train(docs: DataFrame, settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """Model of ``docs`` (``doc_id, text, lang``)."""
    # The sample's order depends on the tasks; sorting makes training repeatable.
    rows = sorted((r["lang"], bytes(r["shares"])) for r in training_sample(docs, settings).collect())
    languages = tuple(sorted({lang for lang, _ in rows}))
    if not rows:
        return LanguageModel((UNKNOWN,), np.zeros((settings.buckets, 1), np.float32), np.zeros(1), 1.0, 0.0)
    x = np.stack([np.frombuffer(s, np.float16) for _, s in rows]).astype(np.float32)
    y = np.searchsorted(np.array(languages), [lang for lang, _ in rows])
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    kept = order[: int(len(x) * settings.calibration)]
    used = order[len(kept) :]
    embed = rng.normal(0, 0.1, (settings.buckets, settings.dimensions)).astype(np.float32)
    weights = np.zeros((settings.dimensions, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(settings.epochs):
        rate = settings.rate * (1 - epoch / settings.epochs)
        for part in np.array_split(rng.permutation(used), max(1, len(used) // settings.batch)):
            hidden = x[part] @ embed
            miss = _softmax(hidden @ weights + bias)
            miss[np.arange(len(part)), y[part]] -= 1
            miss /= len(part)
            back = x[part].T @ (miss @ weights.T)
            weights -= rate * hidden.T @ miss
            bias -= 0.1 * rate * miss.sum(0)
            embed -= 20 * rate * back
    rows_of = embed @ weights
    if not len(kept):
        kept = used
    logits = x[kept] @ rows_of + bias
    right = (np.arange(len(kept)), y[kept])
    grid = np.geomspace(0.1, 10, 41)
    losses = [-np.log(np.maximum(_softmax(logits / t)[right], 1e-12)).mean() for t in grid]
    warm = float(grid[int(np.argmin(losses))])
    odds = _softmax(logits / warm)
    hits = odds.max(1)[odds.argmax(1) == y[kept]]
    least = float(np.quantile(hits, settings.rejected)) if len(hits) else 0.0
    return LanguageModel(languages, rows_of.astype(np.float32), bias, warm, least)


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        names = np.array(found.languages, object)
        for batch in batches:
            texts = batch.column(1)
            total = np.zeros((len(texts), len(names)))
            n = np.zeros(len(texts), np.int64)
            for at, bucket, whole, offsets in subwords(texts, len(found.rows)):
                add_by_text(total, found.rows[bucket] * whole[:, None], at, offsets)
                add_by_text(n, whole.astype(np.int64), at, offsets)
            best, odds = found.predict(total / np.maximum(n, 1)[:, None] + found.bias)
            lettered = np.array([bool(t and LETTER.search(t)) for t in texts.to_pylist()], bool)
            score = np.where(lettered, odds, 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(np.where(lettered, names[best], UNKNOWN), pa.string()),
                    pa.array(score),
                    pa.array(score < found.least_score),
                ],
                schema=schema,
            )

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, lang_pred string, score double, rejected boolean")
