"""Repair of conversations against every edit sequence, and over ranges of all sizes."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from burdenlens.llm import repair

BLANKS = " \t\n\x0b\x0c\r"
COST = {"K": 0, "R": 3, "D": 4, "I": 3}


def flags(rows):
    """First fault of every (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        shown = text.rstrip(BLANKS)
        if not shown:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif shown[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def brute(rows):
    """The least (cost, audit) of all edit sequences, by trying every one up to two insertions on end."""
    faults = flags(rows)
    best = None
    choices = [[e for e in "DKR" if e == "D" or f not in ("blank", "duplicate")] for f in faults]
    for edits in itertools.product(*choices):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * n + e for n, e in zip(inserts, (*edits, ""), strict=True))
            cost = sum(COST[e] for e in audit)
            cost += sum(3 for e, f in zip(edits, faults, strict=True) if f == "truncated" and e != "D")
            if best is not None and (cost, audit) >= best[0]:
                continue
            row, read = iter(rows), []
            for e in audit:
                role, text = (None, "") if e == "I" else next(row)
                if e != "D":
                    read.append((role if e == "K" else None, text))
            led = bool(read) and (read[0][0] or "")[:1] == "s"
            roles = [
                ("user", "assistant")[(k - led) % 2] if r is None else r for k, (r, _) in enumerate(read)
            ]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r in roles)) and all(roles):
                best = (cost, audit), "\n".join(f"{r}:{t}" for r, (_, t) in zip(roles, read, strict=True))
    return best


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(4)
    texts = ["One.", "Two!", "cut", "", " \n", "Three?  ", "é."]
    roles = ["user", "assistant", "system", "tool", "", "unknown"]
    out = {}
    for k in range(60):
        n = rnd.randrange(1, 5)
        out[k] = [(rnd.choices(roles, [5, 5, 2, 1, 1, 1])[0], rnd.choice(texts)) for _ in range(n)]
    return out


def check(mended, talks):
    report = {r.conv_id: r for r in mended.report.collect()}
    sums = {r.conv_id: r.sha256 for r in repair.checksums(mended.turns).collect()}
    assert set(report) == set(talks)
    for k, rows in talks.items():
        (cost, audit), text = brute(rows)
        assert (report[k].cost, report[k].audit) == (cost, audit), (k, rows)
        if text or k in sums:
            assert sums[k] == hashlib.sha256(text.encode()).hexdigest(), (k, rows)
        faults = flags(rows)
        for kind in ("blank", "duplicate", "truncated"):
            assert report[k][kind] == faults.count(kind)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
        assert report[k].illegal == sum(p not in ("su", "ua", "au") for p in pairs)


def frame(spark, talks):
    rows = [(k, n, *row, "x") for k, turns in talks.items() for n, row in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, edit string")


def test_equals_every_edit_sequence(spark, talks):
    check(repair.repair(frame(spark, talks).repartition(3)), talks)


def test_conversations_over_many_ranges(spark, talks):
    """With a range for nearly every turn, conversations are put together from pieces."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    few = {k: v for k, v in talks.items() if k < 25}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mended = repair.repair(frame(spark, few))
        check(mended, few)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pieces_equal_the_whole():
    """A long conversation in one go and in ranges of any size, through the same composition."""
    rnd = random.Random(8)
    grammar = repair.Grammar()
    rows = [(rnd.choice("usaax"), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(700)]

    def least(parser_rows):
        parser = repair.Parser(grammar, grammar.start)
        for row in parser_rows:
            parser.turn(*row)
        parser.inserted()
        return min(w for t, w in parser.ways().items() if t in grammar.final)

    whole = least(rows)
    front = {grammar.start: (0, "", "")}
    at = 0
    while at < len(rows):
        size = rnd.randrange(1, 200)
        new = {}
        for top, (cost, audit, roles) in front.items():
            parser = repair.Parser(grammar, top)
            for row in rows[at : at + size]:
                parser.turn(*row)
            for to, (c, a, r) in parser.ways().items():
                way = (cost + c, audit + a, roles + r)
                new[to] = min(new.get(to, way), way)
        front, at = new, at + size
    parser = repair.Parser(grammar, grammar.start)
    parser.front = front
    parser.inserted()
    assert whole == min(w for t, w in parser.front.items() if t in grammar.final)


def test_odd_rows(spark):
    rows = [
        (None, None, "user", "Hello."),
        (None, 3, "assistant", "Yes."),
        (1, 5, None, None),
        (1, 9, "user", None),
        (2, 1, "user", "Same."),
        (2, 1, "user", "Same."),
        (2, 2, "assistant", "long " * 50_000 + "."),
        (3, 1, "assistant", ""),
    ]
    mended = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    report = {r.conv_id: r.asDict() for r in mended.report.collect()}
    assert report[None] | {"conv_id": 0} == {
        "conv_id": 0, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "KK",
    }
    assert (report[1]["gaps"], report[1]["blank"], report[1]["audit"]) == (3, 2, "DD")
    assert (report[2]["duplicate"], report[2]["illegal"], report[2]["audit"]) == (1, 1, "KDK")
    assert (report[3]["audit"], report[3]["cost"]) == ("D", 4)
    turns = mended.turns.where("conv_id = 2").orderBy("place", "step").collect()
    assert [(t.role, len(t.text)) for t in turns] == [("user", 5), ("assistant", 250_001)]
    assert [t.conv_id for t in mended.turns.where("conv_id IN (1, 3)").collect()] == []


def test_empty_table_and_grammars(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    mended = repair.repair(none)
    assert mended.report.collect() == [] and mended.turns.collect() == []
    assert repair.checksums(mended.turns).where(F.lit(True)).collect() == []
    with pytest.raises(ValueError, match="any depth"):
        repair.Grammar((("x", ("a", "x", "u")), ("x", ("s",))), limit=50)
    with pytest.raises(ValueError, match="equal tops"):
        repair.Grammar((("x", ("y",)), ("x", ("u", "y", "u")), ("y", ("a", "s"))))
