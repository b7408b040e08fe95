"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Base kinds: email, ip, card (Luhn), phone. Added kinds: iban (mod 97) and ssn; a span of
an added kind counts from a score of 0.5, which an ssn reaches only near a context word.
Base spans always stay. Offsets are code points, the end exclusive.

Every pattern is anchored so that a scan is linear: a run of digits or of address
characters is entered at its first character only.

Edge cases: a null text is the empty text and has no spans; overlapping spans of different
kinds are all reported, redaction merges them; repeated rows are treated alike; an empty
table gives an empty result. Only the text column is read; others pass through redaction.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches, small_batches, texts_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[a-z]+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: The score of a kind before context, and the whole words near by that raise it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "visa", "credit", "payment"},
    "phone": {"phone", "telephone", "call", "tel", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "konto"},
    "ssn": {"ssn", "social", "security"},
}
REACH, RAISE, LEAST = 40, 0.4, 0.5


class Span(NamedTuple):
    start: int
    rank: int
    end: int
    score: float

    @property
    def kind(self) -> str:
        return KINDS[self.rank]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


#: Characters of an IBAN by country; elsewhere every length is tried.
IBAN_SIZE = {c: n for n, cs in {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT"}.items() for c in cs.split()}


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each head the longest part that ends before a blank or a sign and passes mod 97."""
    head = IBAN.search(text)
    while head:
        start, at = head.start(), head.end()
        rest = IBAN_REST.match(text, at)
        end = rest.end() if rest else at
        while end > at:
            size = end - start - text.count(" ", start, end)
            ends = text[end - 1] != " " and not re.match(r"[A-Za-z0-9]", text[end : end + 1])
            if ends and 15 <= size <= 34 and size == IBAN_SIZE.get(text[start : start + 2], size) and mod97(text[start:end].replace(" ", "")):
                yield start, end
                break
            end -= 1
        head = IBAN.search(text, max(at, end))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for start, end in _ibans(text):
        yield "iban", start, end
    for m in SSN.finditer(text):
        yield "ssn", *m.span()


def find(text: str) -> list[Span]:
    """All spans of a text by start, then kind."""
    found = []
    for kind, start, end in _proposals(text):
        around = WORD.findall(text[max(0, start - REACH) : start].lower() + " " + text[end : end + REACH].lower())
        score = min(1.0, PRIOR[kind] + RAISE * (not CONTEXT[kind].isdisjoint(around)))
        if kind in BASE or score >= LEAST:
            found.append(Span(start, KINDS.index(kind), end, score))
    return sorted(found)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"


def scan(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, all spans and their scores."""
    small_batches(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            out = []
            for text in texts_of(b.column(1)):
                spans = find(text)
                kinds = [s.kind for s in spans]
                base = listed([s for s in spans if s.kind in BASE])
                out.append((*(kinds.count(k) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), listed(spans), [s.score for s in spans]))
            columns = [pa.array(c) for c in zip(*out, strict=True)]
            columns[-1] = pa.array([r[-1] for r in out], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def redact_text(text: str) -> str:
    """Each stretch of overlapping spans becomes the name of its first kind, in angle brackets."""
    out, done, spans = [], 0, find(text)
    for i, s in enumerate(spans):
        if s.start >= done or i == 0:
            out += [text[done : s.start], f"<{s.kind.upper()}>"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced; null texts stay null."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            columns = list(b.columns)
            columns[at] = pa.array([None if t is None else redact_text(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(run, docs.schema)
