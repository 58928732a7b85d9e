import random
import re

import pytest

from burdenlens.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The base rule as it is worded."""
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), list(PATTERNS).index(kind), kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def base(text):
    return [(s.kind, s.start, s.end) for s in pii.find(text) if s.kind in pii.BASE]


@pytest.mark.parametrize("seed", range(6))
def test_base_rule_on_random_texts(seed):
    rnd = random.Random(seed)
    signs = "ab@.-+ 1234 (50)é%_\n" if seed % 2 else "a@.@-+ 0"
    for _ in range(4000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(60)))
        assert base(text) == plain(text), text


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("card 4111 1111 1111 1111.", ["card"]),
        ("4111 1111 1111 1112", []),
        ("IBAN DE89 3704 0044 0532 0130 00 here", ["iban"]),
        ("DE88370400440532013000", []),
        ("at 10.0.0.255 and 10.0.0.256", ["ip"]),
        ("call +49 (30) 1234-5678", ["phone"]),
        ("x.y@example.co.uk", ["email"]),
        ("", []),
        (None, []),
    ],
)
def test_kinds(text, kinds):
    assert [s.kind for s in pii.find(text)] == kinds


def test_context_moves_the_score():
    plain_, near, against = (
        pii.find(t + "4111111111111111")[0].score for t in ("xyz ", "credit card ", "order ")
    )
    assert against < plain_ < near


def test_long_runs_take_linear_time():
    for run in ("a" * 300_000 + "@", "1" * 300_000, "+" * 100_000, "a@" * 100_000, "1." * 100_000):
        pii.find(run)


def test_frame(spark):
    rows = [(1, "a@b.cd", "x"), (2, None, None), (None, "", "y"), (1, "a@b.cd", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, PII string")
    got = pii.detect(frame)
    assert got.columns == ["doc_id", "pii"]
    spans = sorted((r["doc_id"] or 0, [tuple(s)[:3] for s in r["pii"]]) for r in got.collect())
    assert spans == [(0, []), (1, [("email", 0, 6)]), (1, [("email", 0, 6)]), (2, [])]
    assert pii.detect(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "numbers"),
    [
        ("IBAN DE89370400440532013000 EUR 50", ["DE89370400440532013000"]),
        ("DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", ["DE89 3704 0044 0532 0130 00"]),
        (
            "GB82 WEST 1234 5698 7654 32 GB29 NWBK 6016 1331 9268 19",
            ["GB82 WEST 1234 5698 7654 32", "GB29 NWBK 6016 1331 9268 19"],
        ),
        ("XY12 3456 REF 7 DE89370400440532013000", ["DE89370400440532013000"]),
        ("NO93 8601 1117 947 NOK 1 000 000 000", ["NO93 8601 1117 947"]),
        ("DE89370400440532013000x", []),
        ("xDE89370400440532013000 A", []),
    ],
)
def test_words_next_to_account_numbers(text, numbers):
    assert [text[s.start : s.end] for s in pii.find(text) if s.kind == "iban"] == numbers


def test_account_numbers_are_those_at_any_end_of_a_word():
    rnd = random.Random(1)
    for _ in range(3000):
        words = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "EUR", "50", "a", "AB12"]
        text = rnd.choice(" .x").join(rnd.choice(words) for _ in range(rnd.randrange(8)))
        for s in (s for s in pii.find(text) if s.kind == "iban"):
            assert pii.mod97(text[s.start : s.end].replace(" ", ""))
        whole = re.findall(r"(?<![A-Za-z0-9])(?:DE89[0-9]{18}|GB82[A-Z0-9 ]{23})(?![A-Za-z0-9])", text)
        assert [text[s.start : s.end] for s in pii.find(text) if s.kind == "iban"] == whole
    for run in ("AB12 " * 60_000, "A" * 300_000, "AB12" + " A" * 150_000):
        pii.find(run)
