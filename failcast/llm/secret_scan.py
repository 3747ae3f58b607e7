"""Secrets: known shapes by pattern, unknown ones by sliding-window Shannon entropy.

Candidate strings (unbroken runs of key-like characters) are scanned with a window whose
character counts, and the sum of ``n log n`` over them, change by one character in and one
out per step. A window is suspicious when its entropy reaches the limit of the class of the
characters in it and its letters do not stand like those of words; overlapping suspicious windows
are one span. An allow-list suppresses the windows
that overlap placeholders, identifiers in words, and uniform unique ids. Null texts count as empty; every row in gives
one row out, repeated ids included; an empty table gives no rows. Texts of any length are read whole.
Extra columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Base patterns, fixed values. Keywords match in either case, ASCII letters only.
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_VALUE = 6
#: A run shorter than the limit is dropped and has no longer part, so the limits can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALLOWED = re.compile(
    r"(?i)example|sample|placeholder|dummy|xxxx|changeme|your[_-]?(key|token|secret)"
    r"|(?<![a-z0-9])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![a-z0-9])"
)
#: Frequent pairs of letters in words of English, German, French, Italian and Spanish.
PAIRS = frozenset(
    "ab ac ad ag ai al am an ap ar as at au av ay ba be bi bl bo br bu by ca ce ch ci ck co cr ct cu da de di do dr du"
    " ea ec ed ee ef eg ei el em en ep er es et eu ev ew ex ey fa fe ff fi fo fr ft fu ga ge gh gi gl go gr gu ha he hi"
    " ho hr ht ia ib ic id ie if ig il im in io ir is it iv iz ke ki la ld le li ll lo ls lt lu ly ma mb me mi mm mo mp"
    " mu na nc nd ne ng ni nk nn no ns nt nu ob oc od of og ol om on oo op or os ot ou ov ow pa pe ph pi pl po pp pr pt"
    " pu qu ra rc rd re rg ri rk rl rm rn ro rr rs rt ru ry sa sc se sh si sk so sp ss st su ta te th ti to tr ts tt tu"
    " ty tz ub uc ud ue ui ul um un up ur us ut va ve vi vo wa we wh wi wo ze zu".split()
)
#: Share of them among random pairs.
_CHANCE = len(PAIRS) / 26**2
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class EntropyRules:
    """Window length, and bits per character from which a class is suspicious.

    About the 1 % quantile of random windows of the class: base 16, base 32 and 36, base 62 and 64;
    without digits, letters of one case or of both.
    """

    window: int = 20
    hex_bits: float = 2.9
    lower_bits: float = 3.34
    mixed_bits: float = 3.64
    letter_bits: float = 3.22
    mixed_letter_bits: float = 3.58


#: Kinds of characters: digits, hex and other letters of either case, the rest.
DIGIT, HEX_LOWER, LOWER, HEX_UPPER, UPPER, OTHER = range(6)
_KIND = dict.fromkeys("+/_=-", OTHER)
_KIND |= dict.fromkeys(string.digits, DIGIT)
_KIND |= {c: HEX_LOWER if c < "g" else LOWER for c in string.ascii_lowercase}
_KIND |= {c: HEX_UPPER if c < "G" else UPPER for c in string.ascii_uppercase}


def _limit(kinds: list[int], rules: EntropyRules) -> float | None:
    """Limit for the class of a window, from the counts of its kinds; None without letters."""
    lower, upper = kinds[HEX_LOWER] + kinds[LOWER], kinds[HEX_UPPER] + kinds[UPPER]
    if not (lower or upper):
        return None
    if not kinds[DIGIT]:
        return rules.mixed_letter_bits if lower and upper else rules.letter_bits
    if lower and upper:
        return rules.mixed_bits
    return rules.lower_bits if kinds[LOWER] or kinds[UPPER] or kinds[OTHER] else rules.hex_bits


def _wordlike(run: str) -> Callable[[int, int], bool]:
    """Whether ``run[start:end]`` has more frequent pairs than random letters, by 2.6 deviations."""
    low = run.lower()
    letters, frequent = [0], [0]
    for a, b in itertools.pairwise(low):
        letters.append(letters[-1] + (a.isalpha() and b.isalpha()))
        frequent.append(frequent[-1] + (a + b in PAIRS))

    def judge(start: int, end: int) -> bool:
        n = letters[end - 1] - letters[start]
        c = frequent[end - 1] - frequent[start]
        return n > 3 and c >= _CHANCE * n + 2.6 * math.sqrt(_CHANCE * (1 - _CHANCE) * n)

    return judge


def entropy_spans(text: str, rules: EntropyRules = EntropyRules()) -> list[tuple[int, int]]:
    """Spans whose windows reach the entropy limit, longest runs first in text order."""
    found: list[tuple[int, int]] = []
    width = rules.window
    log = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    for match in CANDIDATE.finditer(text):
        run = match[0]
        if len(run) < width:
            continue
        allowed = [m.span() for m in ALLOWED.finditer(run)]
        wordlike = None
        counts: dict[str, int] = {}
        kinds = [0] * 6
        total = 0.0
        for i, c in enumerate(run):
            if i >= width:
                old = run[i - width]
                n = counts[old]
                counts[old] = n - 1
                total += log[n - 1] - log[n]
                kinds[_KIND[old]] -= 1
            n = counts.get(c, 0)
            counts[c] = n + 1
            total += log[n + 1] - log[n]
            kinds[_KIND[c]] += 1
            if i < width - 1:
                continue
            limit = _limit(kinds, rules)
            # Entropy of a window is log2(width) - sum(n log2 n) / width.
            if limit is None or total > (math.log2(width) - limit) * width + 1e-9:
                continue
            first = i - width + 1
            while allowed and allowed[0][1] <= first:
                allowed.pop(0)
            if allowed and allowed[0][0] <= i:
                continue
            if limit != rules.hex_bits:
                wordlike = wordlike or _wordlike(run)
                if wordlike(first, i + 1):
                    continue
            start, end = match.start() + first, match.start() + i + 1
            if found and found[-1][1] >= start:
                found[-1] = (found[-1][0], end)
            else:
                found.append((start, end))
    return found


def find_secrets(text: str | None, rules: EntropyRules = EntropyRules()) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by start, then kind as in ``KINDS``."""
    if not text:
        return []
    low = text.lower()
    spans: list[tuple[int, int, int]] = []
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(s, 3, e) for s, e in entropy_spans(text, rules)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(spans)]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(f"n_{k}", pa.int64()) for k in KINDS[:3]]
    + [("base_sha256", pa.string()), ("spans", pa.string())]
)


def scan_secrets(docs: DataFrame, rules: EntropyRules = EntropyRules()) -> DataFrame:
    """``doc_id``, counts of the base kinds, digest of the base spans, and all spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = find_secrets(text, rules)
                base = [s for s in spans if s[0] != "entropy"]
                rows.append(
                    (
                        *(sum(s[0] == k for s in base) for k in KINDS[:3]),
                        hashlib.sha256(digest(base).encode()).hexdigest(),
                        digest(spans),
                    )
                )
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, SCHEMA.types[1:], strict=True))],
                schema=SCHEMA,
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)
