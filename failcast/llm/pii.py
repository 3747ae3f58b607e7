"""Personal data in DataFrame functions: patterns propose, checksums confirm, context scores.

Each kind has a pattern; the matches and the pieces between them give positions in code points,
so no match needs a second search. Card numbers must pass Luhn, account numbers (IBAN) mod 97.
A word of the kind's context list shortly before a match raises its score. The base kinds
(email, ip, card, phone) are kept whatever their score; account and national numbers enter when
their score reaches ``least_score``.

The patterns are written so that Java's matcher neither recurses per character nor tries a run
of characters from each of its places; they match what the plain forms named beside them match.
Rows without the characters a kind needs skip its work. Null texts count as empty. One row out
per row in, repeated ids included; an empty table gives no rows. Texts of any length are read whole.
Other columns are not looked at by ``find_pii`` and stay as they are in ``mask_pii``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failcast.llm.common import fresh_name

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "national_id")

#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])"
    r"[A-Za-z0-9.-]*?(?=\.\.|\.?(?:[^A-Za-z0-9.-]|\z))"
)
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: [0-9]([\x20-]?[0-9])+ of at least 16 characters, where separators that are not between digits are masked.
CARD = r"[0-9][0-9\x20-]{15,}+"
LONE_SEPARATOR = r"[\x20-](?![0-9])|(?<![0-9])[\x20-]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b"
NATIONAL_ID = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
IP_PARTS = rf"^{PART}\.{PART}\.{PART}\.{PART}$"

#: Score without context, and words that raise it by CONTEXT_GAIN. Fixed values.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8, "national_id": 0.4}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|address|host|server",
    "card": "card|visa|master|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax|contact",
    "iban": "iban|account|bank|transfer",
    "national_id": "ssn|social|security|national|tax",
}
CONTEXT_GAIN, CONTEXT_WIDTH = 0.3, 40
#: Spans worked on together: work grows with a text's length, not with its square.
SLICE = 128

_FOUND = "array<struct<start:bigint,end:bigint,match:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _slices(items: Column) -> Column:
    """``items`` in arrays of ``SLICE``; the last one may be empty."""

    def cut(whole: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.size(whole) / SLICE).cast("int"))
        return F.transform(numbers, lambda k: F.slice(whole, k * SLICE + 1, F.lit(SLICE)))

    return _let(items, cut)


def _matches(text: Column, pattern: str) -> Column:
    """Start, end and text of all matches, leftmost first."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    sized = F.zip_with(found, between, lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"))
        return F.struct(end.alias("at"), F.array_append(state["out"], span).alias("out"))

    return _fold(_slices(sized), _FOUND, lambda state, part: F.aggregate(part, state, add), lambda s: F.flatten(s["out"]))


def _fold(
    slices: Column,
    kind: str,
    run: Callable[[Column, Column], Column],
    finish: Callable[[Column], Column],
) -> Column:
    """Runs through all slices with a state of ``at`` and ``out``; ``run`` takes a state through one.

    Each slice starts with an empty array ``out`` of type ``kind``, since appending copies an array;
    ``finish`` gets the arrays of all slices.
    """

    def step(state: Column, part: Column) -> Column:
        empty = F.struct(state["at"].alias("at"), F.array().cast(kind).alias("out"))
        done = run(empty, part)
        return _let(done, lambda r: F.struct(r["at"].alias("at"), F.array_append(state["out"], r["out"]).alias("out")))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(slices, none, step, finish)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _places(text: Column) -> Column:
    return F.sequence(F.lit(1), F.length(text))


def luhn(digits: Column) -> Column:
    """True if a string of digits, not empty, passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(_places(digits), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """True if an account number (letters and digits, five or more) leaves 1 modulo 97."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(_places(turned), F.lit(0), add) == 1


def _kind(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind; rows that cannot have any skip the search."""
    if kind == "email":
        may, found = F.contains(text, F.lit("@")), _matches(text, EMAIL)
    elif kind == "ip":
        may = F.rlike(text, F.lit(r"[0-9]\.[0-9]"))
        found = F.filter(_matches(text, IP), lambda s: F.rlike(s["match"], F.lit(IP_PARTS)))
    elif kind == "card":
        may = F.rlike(text, F.lit(r"[0-9][0-9\x20-]{15}"))
        masked = F.regexp_replace(text, LONE_SEPARATOR, "x")

        def is_card(s: Column) -> Column:
            digits = _digits(s["match"])
            return F.length(digits).between(16, 19) & luhn(digits)

        found = F.filter(_matches(masked, CARD), is_card)
    elif kind == "phone":
        may = F.rlike(text, F.lit(r"\+[0-9]"))
        found = F.filter(_matches(text, PHONE), lambda s: F.length(_digits(s["match"])).between(8, 15))
    elif kind == "iban":
        may = F.rlike(text, F.lit(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]"))
        found = F.filter(_matches(text, IBAN), lambda s: mod97(F.regexp_replace(s["match"], " ", "")))
    else:
        may, found = F.rlike(text, F.lit(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")), _matches(text, NATIONAL_ID)

    def scored(part: Column) -> Column:
        """Spans of a slice; contexts are cut from the slice's own region of the text."""
        first = F.greatest(F.get(part, F.lit(0))["start"] - CONTEXT_WIDTH, F.lit(0))
        last = F.get(part, F.size(part) - 1)["start"]

        def one(region: Column, s: Column) -> Column:
            at = F.greatest(s["start"] - CONTEXT_WIDTH, F.lit(0))
            before = F.lower(F.substr(region, (at - first + 1).cast("int"), (s["start"] - at).cast("int")))
            near = F.rlike(before, F.lit(rf"\b(?:{CONTEXT[kind]})"))
            gain = F.when(near, CONTEXT_GAIN).otherwise(0.0)
            return F.struct(
                F.lit(kind).alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.round(F.lit(SCORES[kind]) + gain, 3).alias("score"),
            )

        region = F.substr(text, (first + 1).cast("int"), (last - first).cast("int"))
        return _let(region, lambda r: F.transform(part, lambda s: one(r, s)))

    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return F.when(may, F.flatten(F.transform(_slices(found), scored))).otherwise(none)


def with_pii(docs: DataFrame, text: str = "text", least_score: float = 0.6, into: str = "_pii") -> DataFrame:
    """Adds column ``into``: spans (kind, start, end, score) by kind, then start."""
    source = F.coalesce(F.col(text), F.lit(""))
    kinds = [_kind(source, k) for k in BASE]
    kinds += [F.filter(_kind(source, k), lambda s: s["score"] >= least_score) for k in EXTRA]
    return docs.withColumn(into, F.concat(*kinds))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, least_score: float = 0.6) -> DataFrame:
    """``doc_id``, counts of the base kinds, digest of the base spans, all spans."""
    found = with_pii(docs.select("doc_id", "text"), least_score=least_score)

    def of(*kinds: str) -> Column:
        return F.filter("_pii", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(of(*BASE)), 256).alias("base_sha256"),
        _listed(F.col("_pii")).alias("spans"),
    )


def mask_pii(docs: DataFrame, text: str = "text", least_score: float = 0.6) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans are one.

    A null text stays null. All columns stay; ``n_chars``, if there, is counted anew.
    """
    spans = fresh_name(docs, "_pii_spans")
    found = with_pii(docs, text, least_score, spans)
    source = F.col(text)

    def part(region: Column, start: Column, end: Column) -> Column:
        return F.substr(region, (start + 1).cast("int"), (end - start).cast("int"))

    def run(begin: Column, slice_: Column) -> Column:
        def through(region: Column) -> Column:
            def add(state: Column, s: Column) -> Column:
                label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
                between = part(region, state["at"] - begin["at"], s["start"] - begin["at"])
                more = F.array_append(F.array_append(state["out"], between), label)
                fresh = F.struct(s["end"].alias("at"), more.alias("out"))
                inside = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
                return F.when(s["start"] >= state["at"], fresh).otherwise(inside)

            return F.aggregate(slice_, begin, add)

        return _let(part(source, begin["at"], F.get(slice_, F.size(slice_) - 1)["start"]), through)

    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    masked = _fold(
        _slices(ordered),
        "array<string>",
        run,
        lambda state: F.concat(
            F.array_join(F.flatten(state["out"]), ""), part(source, state["at"], F.length(source).cast("long"))
        ),
    )
    out = found.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(source)).drop(spans)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
