"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

All work is on one text at a time inside the scan; nothing is shuffled. Patterns are applied so that
the time grows with the length of a text: e-mail addresses are looked up from their @, and runs of
digits are entered at their first digit only, which changes no match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from burdenlens.llm.common import added, arrow, pieces

#: Kinds of the base rule, in the order that breaks ties; the checksum kinds follow.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")

#: Signs an address may have before its @ (fixed value).
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})")
_SIGNS = re.compile(r"(?:\x20?[A-Z0-9]){0,30}")
_BOUNDARY = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
_DIGIT = re.compile(r"[0-9]")

#: Signs of an account number by country, as registered (fixed values).
LENGTH = {
    code: length
    for length, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}

#: Words near a span that speak for its kind, and how far they may be (code points).
CONTEXT = {
    "email": {"email", "e-mail", "mail", "contact", "write"},
    "ip": {"ip", "address", "server", "host", "addr"},
    "card": {"card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
}
AGAINST = {"example", "version", "test", "sample", "invoice", "order", "id"}
NEAR = 40
#: Score of a confirmed span without context, and what a word for or against it changes.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9}
STEP = 0.2
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Check digits of an account number: letters count from 10, the first four signs go last."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers: every end of a word is tried, the registered length first, then from the
    longest on; what follows a number does not hide it, nor does what fails hide what follows."""
    last = 0
    for m in _IBAN.finditer(text):
        start = m.start()
        if start < last:
            continue
        stop = _SIGNS.match(text, m.end()).end()
        ends = {}
        for boundary in _BOUNDARY.finditer(text, m.end(), min(stop + 1, len(text))):
            end = boundary.start()
            if end <= stop:
                number = text[start:end].replace(" ", "")
                if len(number) >= 15:
                    ends[len(number)] = end, number
        usual = LENGTH.get(text[start : start + 2])
        for length in sorted(ends, key=lambda n: (n != usual, -n)):
            end, number = ends[length]
            if mod97(number):
                last = end
                yield start, end
                break


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose form and checksum are right."""
    for start, end in _emails(text):
        yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if len(m[0]) < 64 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield "phone", *m.span()
    for start, end in _accounts(text):
        yield "iban", start, end


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    around = set(_WORD.findall(near.lower()))
    score = PRIOR[kind] + STEP * (not around.isdisjoint(CONTEXT[kind]))
    return round(min(1.0, max(0.0, score - STEP * (not around.isdisjoint(AGAINST)))), 3)


def find(text: str | None) -> list[Span]:
    """Spans of a text by start, then kind as listed; code points, end exclusive."""
    if not text:
        return []
    found = [Span(a, b, kind, _score(text, kind, a, b)) for kind, a, b in _proposed(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


FIELD = "pii array<struct<kind: string, start: int, end: int, score: double>>"
_ARROW = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]
    )
)


def detect(frame: DataFrame, text: str = "text") -> DataFrame:
    """The frame without its text, with ``pii``: kind, start, end and score of every span found.

    Base kinds (email, ip, card, phone) are the leftmost, non-overlapping matches of each kind that
    pass their check; account numbers by mod-97 come on top, whatever words stand next to them. A score never drops a span. Null and
    empty texts have none; rows are kept one by one, repeated ones too; a column named pii is
    replaced.
    """
    rest = [c for c in frame.columns if c.lower() not in (text.lower(), "pii")]
    schema = added(frame.select(*rest), FIELD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            spans = [
                [{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in find(t)]
                for t in piece.column(text).to_pylist()
            ]
            columns = [piece.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, _ARROW)], [*rest, "pii"])

    return arrow(frame.select(*rest, text), run, schema)
