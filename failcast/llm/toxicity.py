"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts.

The models are over 4-grams of code points, any script, in lower case; every white space and the
place before a text is a blank. The vocabulary is open: counts are a distributed table with a row
per 4-gram that a labelled text has, so it grows with the corpus and is never collected or
broadcast. Counts come from all labelled texts, whole. A class has its own counts of 4-grams; what
they lack in mass goes to continuation counts of shorter n-grams that both classes share. So a rare
expression that one class never had costs both classes alike.

A text's evidence is the difference of the two log-likelihoods per character. Where a 4-gram is
new, the shorter n-grams cancel and what its first three symbols hold back decides; where those are
new as well, there is no evidence. So the table has a row per context (three symbols) with its
symbols. Texts are dealt into batches of about ``BATCH_BYTES``; a batch asks once for each of its
distinct contexts, and the answers come back to it. A context is at most one row per piece of a
batch, whatever the number of texts that share it.

A curve that never falls turns the evidence into a score: the share of toxic rows among labelled rows of
such evidence, by isotonic regression. It is fitted on a bounded hash sample
of labelled rows (``sample_rows``, balanced between the classes and weighed back) that are not counted,
a fifth of a class at most; where that leaves fewer than ``CURVE_ROWS`` of a class, on counted rows.

Null and empty texts have no evidence: their score is that of evidence zero. Labels other than 0
and 1 are not learned; a document with several label rows counts once per row. Rows that repeat are scored
alike; an empty table gives no rows. Helper columns take names that the table does not have. Without both
classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from failcast.llm.common import add_by_text, fresh_name, give_back, id_filter, run_starts, text_bytes
from failcast.sources.storage import stored

ORDER = 4
#: Code points of Unicode, and bits of one.
SYMBOLS, BITS = 0x110000, 21
BLANK = 32
#: Bytes of texts whose 4-grams are looked at together.
PIECE = 1 << 20
#: Bytes of texts that are scored together.
BATCH_BYTES = 1 << 23
#: Part of the labelled rows kept for the curve at most, and rows of each class that it needs.
CURVE_SHARE, CURVE_ROWS = 0.2, 20
#: Largest model, in contexts, that the column form takes to every worker.
COLUMN_CONTEXTS = 2_000_000


def _alphabet() -> np.ndarray:
    table = np.arange(SYMBOLS, dtype=np.int32)
    for c in range(0x20000):
        low = chr(c).lower()
        table[c] = BLANK if chr(c).isspace() else ord(low) if len(low) == 1 else c
    return table


_SYMBOL = _alphabet()


@dataclass(frozen=True)
class ToxicityModel:
    #: ``context, held, found``: evidence of a new symbol after the context, and of those it had.
    table: DataFrame | None
    #: Points of the curve from evidence to score: evidence, rising, and score, not falling.
    evidence: np.ndarray
    scores: np.ndarray

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if not len(self.evidence):
            return np.zeros(len(evidence))
        # A little of the evidence itself keeps texts apart where the curve is level.
        order = 0.5 + evidence / (2 * (np.abs(evidence) + 1))
        return 0.998 * np.interp(evidence, self.evidence, self.scores) + 0.002 * order

    def score_of(self, evidence: Column) -> Column:
        curve = ToxicityModel(None, self.evidence, self.scores)

        @F.arrow_udf("double")
        def scored(values: pa.Array) -> pa.Array:
            return pa.array(curve.score(values.to_numpy(zero_copy_only=False)))

        return scored(evidence)


def no_model() -> ToxicityModel:
    return ToxicityModel(None, np.zeros(0), np.zeros(0))


def _valid(texts: pa.Array) -> pa.Array:
    """Texts in valid UTF-8; bytes that are none become replacement characters."""
    texts = texts.cast(pa.large_string())
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        raw = texts.cast(pa.large_binary()).to_pylist()
        return pa.array([t and t.decode(errors="replace") for t in raw], pa.large_string())
    return texts


@dataclass(frozen=True)
class Grams:
    """4-grams that end at each symbol of a piece, from ``at`` on, numbered by the piece's alphabet.

    ``places``: symbols before each text, for the texts met so far, and a large number for others.
    """

    at: int
    keys: np.ndarray
    alphabet: np.ndarray
    places: np.ndarray

    def cells(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and last symbol of 4-grams, as code points."""
        code = [self.alphabet[(keys >> np.uint64(16 * k)) & np.uint64(0xFFFF)] for k in range(ORDER)]
        return code[3] << 2 * BITS | code[2] << BITS | code[1], code[0]


def grams(texts: pa.Array) -> Iterator[Grams]:
    """4-grams of a batch of texts, piece by piece; the three symbols before a text are blanks."""
    data, starts = text_bytes(_valid(texts))
    places = np.where(starts == 0, 0, np.iinfo(np.int64).max)
    # First byte and number of symbols before the piece.
    at = done = 0
    size = PIECE
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        end = min(end, len(data))
        first, lead = at, 0
        while first and lead < ORDER - 1:
            first -= 1
            lead += data[first] & 0xC0 != 0x80
        while first and data[first] & 0xC0 == 0x80:
            first -= 1
        codes = _SYMBOL[np.frombuffer(data[first:end].tobytes().decode().encode("utf-32-le"), "<u4")]
        here = np.zeros(SYMBOLS, bool)
        here[codes] = True
        here[BLANK] = True
        alphabet = np.flatnonzero(here)
        del here
        if len(alphabet) > 1 << 16:
            size //= 2
            continue
        n = len(codes) - lead
        before = np.concatenate([[0], np.cumsum(data[at:end] & 0xC0 != 0x80)])
        met = slice(np.searchsorted(starts, at), np.searchsorted(starts, end, "right"))
        places[met] = done + before[starts[met] - at]
        number = np.zeros(SYMBOLS, np.uint16)
        number[alphabet] = np.arange(len(alphabet))
        blank = number[BLANK]
        part = np.concatenate([np.full(ORDER - 1 - lead, blank, np.uint16), number[codes]])
        del codes, number, before
        keys = np.zeros(n, np.uint64)
        near = slice(np.searchsorted(places[:-1], done - ORDER, "right"), np.searchsorted(places[:-1], done + n))
        cuts = np.unique(places[:-1][near]) - done
        for k in range(ORDER):
            symbol = part[k : k + n]
            back = ORDER - 1 - k
            if back and len(cuts):
                symbol = symbol.copy()
                for j in range(back):
                    cut = cuts + j
                    symbol[cut[(cut >= 0) & (cut < n)]] = blank
            keys = keys << np.uint64(16) | symbol
        yield Grams(done, keys, alphabet, places)
        at, done = end, done + n


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``context, symbol, n0, n1`` over all rows of ``labelled`` (``toxic, text``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for label in (0, 1):
                for piece in grams(batch.column(1).filter(pa.array(toxic == label))):
                    keys, n = np.unique(piece.keys, return_counts=True)
                    context, symbol = piece.cells(keys)
                    none = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(context), pa.array(symbol), *map(pa.array, (none, n) if label else (n, none))],
                        names=["context", "symbol", "n0", "n1"],
                    )

    rows = labelled.select(F.col("toxic").cast("int"), "text").mapInArrow(count, "context long, symbol long, n0 long, n1 long")
    return rows.groupBy("context", "symbol").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.75


def _smoothed(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Kneser-Ney step: discounted shares per context (last axis), the rest to ``shorter``."""
    discount = _discount((counts == 1).sum(), (counts == 2).sum())
    total = counts.sum(-1, keepdims=True).astype(float)
    kinds = (counts > 0).sum(-1, keepdims=True)
    held = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
    return np.maximum(counts - discount, 0) / np.maximum(total, 1) + held * shorter


def _discount_of(counts: DataFrame, column: str) -> float:
    return _discount(*counts.agg(F.count_if(F.col(column) == 1), F.count_if(F.col(column) == 2)).first())


def _smoothed_cells(counts: DataFrame, shorter: DataFrame, kept: int) -> DataFrame:
    """``_smoothed`` on rows ``cell, n`` of two or three symbols; ``shorter`` has ``cell, p``."""
    discount = _discount_of(counts, "n")
    context = F.shiftright("cell", BITS)
    totals = counts.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    rows = counts.select("cell", "n", context.alias("context"), F.col("cell").bitwiseAND(kept).alias("rest"))
    rows = rows.join(totals.hint("merge"), "context").join(shorter.toDF("rest", "shorter"), "rest")
    return rows.select("cell", ((F.col("n") - discount + discount * F.col("kinds") * F.col("shorter")) / F.col("total")).alias("p"))


def gram_evidence(cells: DataFrame) -> DataFrame:
    """``context, held, found`` from the counts: log-likelihood of toxic over ordinary."""
    spark = cells.sparkSession
    two_symbols, one_symbol = (1 << 2 * BITS) - 1, (1 << BITS) - 1
    rest = F.shiftleft(F.col("context").bitwiseAND(two_symbols), BITS).bitwiseOR(F.col("symbol"))
    many = F.count("*").alias("n")
    three = stored(cells.groupBy(rest.alias("cell")).agg(many))
    two = stored(three.groupBy(F.col("cell").bitwiseAND(two_symbols).alias("cell")).agg(many))
    # At most a row per code point.
    one = two.groupBy(F.col("cell").bitwiseAND(one_symbol).alias("cell")).agg(many).toArrow()
    shared = _smoothed(one.column("n").to_numpy(), np.float64(1 / SYMBOLS))
    least = spark.createDataFrame(pa.table({"cell": one.column("cell"), "p": shared}))
    # The counts are many times smaller in their files than as rows: only the code points' join is a broadcast.
    shorter = _smoothed_cells(three, _smoothed_cells(two, F.broadcast(least), one_symbol).hint("merge"), two_symbols).hint("merge")

    discounts = [_discount_of(cells, f"n{c}") for c in (0, 1)]
    totals = cells.groupBy("context").agg(
        *(F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)), *(F.count_if(F.col(f"n{c}") > 0).alias(f"k{c}") for c in (0, 1))
    )
    held = [F.when(F.col(f"t{c}") > 0, discounts[c] * F.col(f"k{c}") / F.col(f"t{c}")).otherwise(1.0) for c in (0, 1)]
    totals = totals.select("context", "t0", "t1", *(h.alias(f"h{c}") for c, h in enumerate(held)))
    rows = cells.withColumn("rest", rest).join(totals.hint("merge"), "context").join(shorter.toDF("rest", "shorter"), "rest")
    p0, p1 = (
        F.greatest(F.col(f"n{c}") - discounts[c], F.lit(0.0)) / F.greatest(F.col(f"t{c}"), F.lit(1))
        + F.col(f"h{c}") * F.col("shorter")
        for c in (0, 1)
    )
    known = rows.select("context", "symbol", (F.log("h1") - F.log("h0")).alias("held"), (F.log(p1) - F.log(p0)).alias("e"))
    # A context has at most a symbol per code point.
    found = F.map_from_entries(F.collect_list(F.struct(F.col("symbol").cast("int"), F.col("e").cast("float")))).alias("found")
    return known.groupBy("context").agg(F.first("held").cast("float").alias("held"), found)


class Evidence:
    """Evidence of 4-grams from rows of contexts with their symbols."""

    def __init__(self, context: np.ndarray, held: np.ndarray, sizes: np.ndarray, symbol: np.ndarray, value: np.ndarray) -> None:
        self.contexts, of = np.unique(context, return_inverse=True)
        self.held = np.zeros(len(self.contexts))
        self.held[of] = held
        cells = np.repeat(of, sizes) << BITS | symbol
        order = np.argsort(cells)
        self.known, self.values = cells[order], value[order].astype(np.float64)

    def of(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if not len(self.contexts):
            return np.zeros(len(context))
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        cells = at << BITS | symbol
        k = np.minimum(np.searchsorted(self.known, cells), len(self.known) - 1)
        found = np.where(self.known[k] == cells, self.values[k], self.held[at])
        return np.where(self.contexts[at] == context, found, 0.0)


def text_evidence(texts: pa.Array, evidence: Evidence) -> np.ndarray:
    """Difference of log-likelihoods per character."""
    total, places = np.zeros(len(texts)), np.zeros(len(texts) + 1, np.int64)
    for piece in grams(texts):
        keys = np.unique(piece.keys)
        values, places = evidence.of(*piece.cells(keys)), piece.places
        add_by_text(total, values[np.searchsorted(keys, piece.keys)], piece.at, places)
    return total / np.maximum(np.diff(places), 1)


def _distinct(cells: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of context and symbol, in order."""
    context, symbol = (np.concatenate(c) for c in zip(*cells, strict=True))
    order = np.lexsort((symbol, context))
    context, symbol = context[order], symbol[order]
    heads = run_starts([context, symbol])
    return context[heads], symbol[heads]


def _joined(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def with_evidence(docs: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """All rows and columns of ``docs``, and each text's evidence as ``name``."""
    batch = fresh_name(docs, "_batch")
    # A row counts as 64 bytes at least, so a batch has bounded rows as well.
    size = docs.agg(F.sum(F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(64)))).first()[0] or 0
    batches = -(-size // BATCH_BYTES) or 1
    number = F.pmod(F.xxhash64(F.lit("batch"), "doc_id", "text"), F.lit(batches))
    # Both uses share one shuffle of the texts: its columns are the same.
    dealt = docs.withColumn(batch, number).repartition(F.col(batch))

    def ask(rows: pa.Table) -> pa.Table:
        give_back()
        cells: list[tuple[np.ndarray, np.ndarray]] = []
        for piece in grams(_joined(rows.column("text"))):
            cells.append(piece.cells(np.unique(piece.keys)))
            if len(cells) == 4:
                cells = [_distinct(cells)]
        if not cells:
            return _ASKED.empty_table()
        context, symbol = _distinct(cells)
        heads = run_starts([context])
        lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(context)), pa.int32()), pa.array(symbol, pa.int32()))
        asker = np.full(len(heads), rows.column(batch)[0].as_py())
        return pa.Table.from_arrays([pa.array(asker), pa.array(context[heads]), lists], schema=_ASKED)

    def answer(rows: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        symbol, value = (_joined(answers.column(k)) for k in ("symbols", "found"))
        context = answers.column("context").to_numpy()
        sizes = symbol.value_lengths().to_numpy(zero_copy_only=False)
        evidence = Evidence(context, np.zeros(len(context)), sizes, symbol.flatten().to_numpy(), value.flatten().to_numpy())
        total = text_evidence(_joined(rows.column("text")), evidence)
        return rows.drop_columns([batch]).append_column(name, pa.array(total))

    asked = dealt.groupBy(batch).applyInArrow(ask, "asker long, context long, symbols array<int>")
    found = F.transform("symbols", lambda s: F.coalesce(F.try_element_at("found", s), "held"))
    # What the texts ask is sized by Spark as if each text asked once.
    answers = asked.join(table.hint("merge"), "context").select("asker", "context", "symbols", found.alias("found"))
    fields = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return dealt.groupBy(batch).cogroup(answers.groupBy("asker")).applyInArrow(answer, fields)


_ASKED = pa.schema([("asker", pa.int64()), ("context", pa.int64()), ("symbols", pa.list_(pa.int32()))])


def rising_shares(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Curve from ``x`` to the share of ones that never falls: neighbours that would fall are one stretch.

    A point stands at each stretch's mean of ``x``. Shares are drawn a little to that of all rows, as by half
    a row more, so that a stretch of few rows is not certain.
    """
    order = np.lexsort((y, x))
    prior = float((weight * y).sum() / weight.sum())
    # Of each stretch: weight of ones, weight, weighted sum of x, rows.
    stretches: list[list[float]] = []
    for xi, yi, wi in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        own = [wi * yi, wi, wi * xi, 1]
        while stretches and (stretches[-1][0] * own[1] >= own[0] * stretches[-1][1]):
            own = [a + b for a, b in zip(stretches.pop(), own, strict=True)]
        stretches.append(own)
    ones, total, place, rows = np.array(stretches, float).T
    shares = (ones / total * rows + 0.5 * prior) / (rows + 0.5)
    return place / total, np.maximum.accumulate(shares)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> ToxicityModel:
    """Model from the texts of ``docs`` that ``labels`` (``doc_id, toxic``) marks; other labels have no influence."""
    known = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # Only texts that may have a label are moved. Labels grow with the corpus: the join is a merge at every size.
    texts = docs.select("doc_id", "text").where(id_filter(known, "doc_id")("doc_id"))
    learnable = docs.select("doc_id").join(known.hint("merge"), "doc_id").groupBy("toxic").agg(F.count("*").alias("n"))
    sizes = {r["toxic"]: r["n"] for r in learnable.collect()}
    if len(sizes) < 2:
        return no_model()
    share = [min(CURVE_SHARE, sample_rows / 2 / sizes[c]) for c in (0, 1)]
    place = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(1 << 32)) / float(1 << 32)
    in_curve = place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    counted = texts.join(known.where(~in_curve).hint("merge"), "doc_id")
    cells = stored(gram_counts(counted))
    if not all(cells.agg(F.sum("n0"), F.sum("n1")).first()):
        in_curve = F.lit(False)
        cells = stored(gram_counts(texts.join(known.hint("merge"), "doc_id")))
        if not all(cells.agg(F.sum("n0"), F.sum("n1")).first()):
            return no_model()
    table = stored(gram_evidence(cells))
    curve = _curve(texts.where(place < max(share)).join(known.where(in_curve).hint("merge"), "doc_id"), table, share)
    if curve is None:
        # Too few rows to keep some for the curve: it sees rows that were counted as well.
        share = [min(1.0, sample_rows / 2 / sizes[c]) for c in (0, 1)]
        some = known.where(place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
        curve = _curve(texts.join(some.hint("merge"), "doc_id"), table, share)
    return ToxicityModel(table, *curve) if curve else no_model()


def _curve(labelled: DataFrame, table: DataFrame, share: list[float]) -> tuple[np.ndarray, np.ndarray] | None:
    """Curve fitted on labelled rows; None without ``CURVE_ROWS`` of each class."""
    rows = with_evidence(stored(labelled), table, "x").select("toxic", "x").toArrow()
    x, y = rows.column("x").to_numpy(), rows.column("toxic").to_numpy()
    if min((y == 0).sum(), (y == 1).sum()) < (CURVE_ROWS if max(share) <= CURVE_SHARE else 1):
        return None
    return rising_shares(x, y, np.where(y == 1, 1 / share[1], 1 / share[0]))


def with_toxicity(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """All rows and columns of ``docs``, and the score of each text, 0 to 1."""
    if model.table is None:
        return docs.withColumn(name, F.lit(0.0))
    found = with_evidence(docs, model.table, name)
    return found.withColumn(name, model.score_of(F.col(name)))


def toxicity(text: str | Column, model: ToxicityModel, spark) -> Column:
    """Score of a text column, 0 to 1, for models small enough to go to every worker.

    ``with_toxicity`` gives the same scores and has no such limit.
    """
    if model.table is None:
        return F.lit(0.0)
    if model.table.count() > COLUMN_CONTEXTS:
        raise ValueError("the model is too large for a column, use with_toxicity")
    rows = model.table.select("context", "held", F.map_keys("found").alias("s"), F.map_values("found").alias("e")).toArrow()
    symbol, value = (_joined(rows.column(k)) for k in ("s", "e"))
    sizes = symbol.value_lengths().to_numpy(zero_copy_only=False)
    evidence = Evidence(
        rows.column("context").to_numpy(), rows.column("held").to_numpy(), sizes, symbol.flatten().to_numpy(), value.flatten().to_numpy()
    )
    shared = spark.sparkContext.broadcast(evidence)
    curve = ToxicityModel(None, model.evidence, model.scores)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(curve.score(text_evidence(texts, shared.value)))

    return score(text)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """Documents whose score is below ``threshold``; all columns stay."""
    name = fresh_name(docs, "_score")
    return with_toxicity(docs, model, name).where(F.col(name) < threshold).drop(name)
