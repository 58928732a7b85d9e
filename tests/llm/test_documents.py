"""Operators on documents against brute force, with nulls, ties, repeated rows and no rows."""

import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from burdenlens.llm import decontaminate, jaccard, lines, shards, suffix_tree, toxicity, winnow
from burdenlens.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, NAME string, size int"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def runs(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()


def corpus(seed):
    """Random documents with copies, edited copies, shared passages and odd rows."""
    rnd = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(400)] + ["Été", "x" * 300]
    passage = "\n".join(" ".join(rnd.choice(vocabulary) for _ in range(26)) for _ in range(3))
    rows = []
    for k in range(60):
        text = "\n".join(
            " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 40)))
            for _ in range(rnd.randrange(1, 8))
        )
        if k % 4 == 0:
            text += "\n" + passage
        rows.append((k, text))
    for k in range(60, 110):
        w = rows[rnd.choice([3, 5, 7, rnd.randrange(60)])][1].split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2, len(w) // 20])):
            w[rnd.randrange(len(w))] = "changed"
        rows.append((k, " ".join(w)))
    rows += [(110, ""), (111, None), (112, " \n\t"), (113, "one two"), (114, "One  two"), (115, "a")]
    rows += [(116, "word " * 3000), (117, "\n\n" + passage.upper() + "\n\n")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(k, t, "en", "s", len(t or ""), "x", 1) for k, t in corpus(1)], SCHEMA
    ).repartition(3)


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.drop("NAME", "size").write.parquet(f"{folder}/documents.parquet")
    texts = dict(corpus(1))
    items = [(k, " ".join(words(texts[4 * k])[:30])) for k in range(12)]
    items += [(50, None), (51, ""), (52, "one two"), (53, items[0][1]), (53, items[0][1])]
    spark.createDataFrame(items, "item_id long, text string").distinct().write.parquet(
        f"{folder}/benchmark.parquet"
    )
    rnd = random.Random(2)
    said = ["One.", "Two! ", "cut", "", " ", "Three?", None]
    turns = [
        (c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice(said))
        for c in [*range(40), None]
        for t in [*range(rnd.randrange(1, 7)), *([None] if c and c % 9 == 0 else [])]
        if rnd.random() < 0.9
    ]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(
        f"{folder}/conversations.parquet"
    )
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_and_sql(spark, tables, name):
    folder, con = tables
    found = QUERIES[name](spark, folder)
    expected = con.execute(ORACLE[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    own, given = (sorted(map(repr, map(tuple, r))) for r in (found.select(columns).collect(), expected.fetchall()))
    if name == "op2_line_dedup":  # SQL sees no lines in a null text
        own = [r for r in own if not r.startswith("(111,")]
        given = [r for r in given if not r.startswith("(111,")]
    assert own == given


def test_copies_that_overlap_their_first_one(spark):
    """A line on end: the first run of 50 words stays whole. The same for two lines in turn."""
    line, other = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, "\n".join([line] * 6)), (2, "\n".join([line, other] * 6)), (3, "\n".join([line] * 4))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.dedup(frame).collect()}
    assert (got[1]["n_deleted"], got[1]["text"]) == (1, "\n".join([line] * 5))
    # runs from the first and from the second line are there again two lines further on
    assert (got[2]["n_deleted"], got[2]["text"]) == (7, "\n".join([line, other] * 2 + [line]))
    assert got[3]["n_deleted"] == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.execute(ORACLE["op2_line_dedup"]).fetchall()
    assert {r[0]: tuple(r[1:]) for r in found} == {
        k: (r["text"], r["n_lines"], r["n_deleted"]) for k, r in got.items()
    }


def test_some_lines_go(docs):
    got = {r["doc_id"]: r for r in lines.dedup(docs).collect()}
    texts = dict(corpus(1))
    assert got[0]["text"] == texts[0] and got[0]["n_deleted"] == 0
    assert got[4]["n_deleted"] >= 3 and got[4]["text"] != texts[4]
    assert got[111]["text"] is None and got[110]["text"] == "" and got[110]["n_lines"] == 1
    assert lines.dedup(docs).columns == [*docs.columns, "n_lines", "n_deleted"]


def test_components_by_brute_force(docs):
    sets = {k: runs(t) for k, t in corpus(1)}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(docs).collect()}
    assert got == {k: (len(s), find(k)) for k, s in sets.items()}
    assert len({c for _, c in got.values()}) < len(got) - 20


def test_trie_finds_what_counting_finds():
    rnd = random.Random(4)
    for _ in range(60):
        base = [rnd.randrange(1, 400) for _ in range(rnd.randrange(1, 60))]
        sets = []
        for _ in range(30):
            s = {x if rnd.random() < 0.93 else rnd.randrange(1, 400) for x in base}
            sets.append(sorted(s))
        packed = [b"".join(x.to_bytes(8, "little") for x in s) for s in sets]
        want = {
            k
            for k, s in enumerate(sets)
            if 100 * len(set(s) & set(sets[0])) >= 75 * len(set(s) | set(sets[0]))
        }
        assert set(jaccard.linked(packed, packed[0], 75)) == want


def test_long_chains_are_one_component(spark):
    pairs = [(k, k + 1) for k in range(0, 300)] + [(500, 400), (400, 450), (7, 7)]
    got = jaccard.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["root"] for r in got} == {0, 400}
    assert len(got) == 304


def winnowed(text):
    """Hashes are taken from the operator, so only the choice of positions is compared."""
    w = words(text)
    return max(len(w) - 5, 0) + 1 if w else 0


def test_fingerprints(spark, docs):
    rows = {r["doc_id"]: r for r in winnow.fingerprints(docs).select(
        "*",
        winnow.positions(F.col("print")).alias("at"),
        winnow.hashes(F.col("print")).alias("h"),
        winnow.likeness(F.col("print"), F.col("edited_print")).alias("near"),
    ).collect()}
    texts = dict(corpus(1))
    order = sorted(texts)
    for k, own in enumerate(order):
        text, after = texts[own] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        assert rows[own]["edited"] == text[: len(text) - half] + after[:half]
        n, at = winnowed(text), rows[own]["at"]
        assert at == sorted(at) and all(0 <= p < n for p in at)
        # one choice in each window of four, and so one in every eight words
        assert all(any(a <= p < a + 4 for p in at) for a in range(n - 3))
        assert bool(at) == bool(n) and 0 <= rows[own]["near"] <= 1
    assert rows[113]["print"] == rows[114]["print"]
    # of equal hashes the rightmost is kept: a text of one word over and over moves on by one
    assert rows[116]["at"] == list(range(3, 2996))


def test_shards(docs):
    rows = shards.shard(docs, 5).collect()
    texts = dict(corpus(1))
    where = {}
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 8 and r["text_crc32"] == zlib.crc32(text.encode())
        assert where.setdefault(text, r["shard"]) == r["shard"]
    for k in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))
    # no smaller capacity would do
    groups, first = Counter(), {}
    for r in rows:
        text = texts[r["doc_id"]] or ""
        groups[text] += r["size"]
        first[text] = min(first.get(text, 10**9), r["doc_id"])
    sizes = [groups[t] for t in sorted(groups, key=first.get)]
    largest = max(sum(r["size"] for r in rows if r["shard"] == k) for k in range(5))

    def fits(capacity):
        used, filled = 1, 0
        for s in sizes:
            if filled + s > capacity:
                used, filled = used + 1, 0
            filled += s
        return used <= 5

    assert max(sizes) <= largest and fits(largest) and not (largest > max(sizes) and fits(largest - 1))


@pytest.mark.parametrize("seed", range(8))
def test_smallest_capacity(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([8, 9, 30, rnd.randrange(8, 5000)]) for _ in range(rnd.randrange(1, 4000))]
    if seed % 3 == 0:
        sizes[len(sizes) // 2] = sum(sizes) // 3  # a group with a third of everything
    wanted, ends, total = rnd.choice([1, 3, 11, 24]), [], 0
    for s in sizes:
        total += s
        ends.append(total)

    def ranges_of(windows, width):
        found = {}
        for x in ends:
            for k, (a, b) in enumerate(windows):
                if a < x <= b:
                    low, high, n = found.get((k, (x - a - 1) // width), (x, x, 0))
                    found[k, (x - a - 1) // width] = (min(low, x), max(high, x), n + 1)
        return list(found.values())

    capacity, cuts = shards._search(total, max(sizes), wanted, 200, ranges_of)
    low, high = max(sizes), total
    while low < high:
        middle, used, filled = (low + high) // 2, 1, 0
        for s in sizes:
            if filled + s > middle:
                used, filled = used + 1, 0
            filled += s
        low, high = (low, middle) if used <= wanted else (middle + 1, high)
    assert capacity == low and cuts[-1] == total


def test_suffix_tree_scores(spark, docs):
    train = F.col("doc_id") % 5 != 1
    rows = {r["doc_id"]: r for r in suffix_tree.scores(docs, train, depth=3).collect()}
    texts = dict(corpus(1))
    counts = Counter()
    for k, t in texts.items():
        if k % 5 != 1:
            counts.update([*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    for k, t in texts.items():
        tokens = [*words(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        r = rows[k]
        assert (r["n_tokens"], r["train_tokens"]) == (len(tokens), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0


def test_tree_learns_order(spark):
    """Words follow each other by a rule that single words do not show."""
    rnd = random.Random(2)
    rows = []
    for k in range(300):
        word, text = rnd.randrange(12), []
        for _ in range(60):
            word = (word + rnd.choice([1, 1, 1, 5])) % 12
            text.append("ab" + "cdefghijklmn"[word])
        rows.append((k, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    held = suffix_tree.scores(frame, F.col("doc_id") % 5 != 1).where("NOT train").collect()
    assert len(held) == 60 and all(r["score"] > 0.8 * r["base_score"] for r in held)


def test_chances_sum_to_one(docs):
    tree = suffix_tree.grow(docs.select(F.lit(True).alias("train"), "text"), depth=3)
    sums = (10.0 ** tree.chance.astype(float)).sum(1)
    assert abs(sums - 1).max() < 1e-4 and len(sums) > 5


def test_toxicity_on_held_out_texts(spark):
    rnd = random.Random(5)
    plain = ["lorem", "ipsum", "dolor", "amet", "elit", "sed", "quis", "nulla", "porta", "velit"]
    rows, marks = [], []
    for k in range(400):
        bad = k % 4 == 0
        w = [rnd.choice(plain) for _ in range(30)]
        if bad:
            w[rnd.randrange(30)] = rnd.choice(["Grobian", "schuft!!", "LUMP"])
        rows.append((k, " ".join(w)))
        marks.append((k, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (900, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, toxicity.marks(labels).where("doc_id % 5 != 0"))
    scored = toxicity.score(docs.withColumn("SCORE", F.lit(1)), model)
    assert scored.columns == ["doc_id", "text", "score"]
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in range(0, 400, 5))
    assert 0 < got[900] < 0.5 and got[900] == got[901]
    none = toxicity.train(docs, toxicity.marks(labels.limit(0)))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, text), (None, text), (None, "x y"), (2, text + " more"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["n_deleted"]) for r in lines.dedup(frame).collect())
    assert kept == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 0), (3, 0)]  # the null id comes first
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard.groups(frame).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted(r["slot"] for r in shards.shard(frame, 1).collect()) == [0, 1, 2, 3, 4, 5]
    items = spark.createDataFrame([(7, text), (7, text), (None, "x y"), (8, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(frame, items).collect()}
    assert found == {(1, 7), (None, 7), (2, 7), (None, None)}
    assert [r["doc_id"] for r in decontaminate.clean(frame, items).collect()] == [3]
    assert winnow.fingerprints(frame).count() == 6
    assert suffix_tree.scores(frame, F.lit(False)).count() == 6


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert lines.dedup(none).count() == jaccard.groups(none).count() == 0
    assert winnow.fingerprints(none).count() == shards.shard(none).count() == 0
    assert decontaminate.contained(none, items).count() == 0
    assert suffix_tree.scores(none, F.lit(True)).count() == 0


def tree_scores(texts, learned, depth):
    """Scores by the longest retained suffix, with all contexts in one dictionary."""
    streams = ["\n" + " ".join(words(t)) + "\n" for t in texts]
    streams = [s.encode() for s in streams]
    counts = {}
    for s, own in zip(streams, learned, strict=True):
        for i in range(1, len(s)):
            for n in range(min(depth, i) + 1):
                if own:
                    counts.setdefault(s[i - n : i], Counter())[s[i]] += 1
    seen = counts.get(b"", Counter())

    def chance(context, sign):
        if not context:
            return (seen[sign] + 0.5) / (sum(seen.values()) + 0.5 * 256)
        above, own = chance(context[1:], sign), counts.get(context, {})
        size = sum(own.values())
        if size < 2 or not kept_(context):
            return above
        return (own.get(sign, 0) + len(own) * above) / (size + len(own))

    @lru_cache(None)
    def kept_(context):
        own = counts[context]
        size = sum(own.values())
        saved = sum(c * math.log(c / size / chance(context[1:], x)) for x, c in own.items())
        return saved >= 0.005 * size and saved >= 2 * len(own)

    found = []
    for s in streams:
        places = range(1, len(s))
        found.append(sum(math.log10(chance(s[max(0, i - depth) : i], s[i])) for i in places))
    return found


@pytest.mark.parametrize("depth", [1, 2, 5, 8])
def test_suffix_tree_scores_as_in_one_dictionary(spark, depth, monkeypatch):
    monkeypatch.setattr(suffix_tree, "UNIT", 700)  # of the session's own tasks: several units
    rnd = random.Random(depth)
    some = ["ab", "abc", "Été", "x", "ba", "cab", "bacab", "\u4e2d\u6587"]
    texts = [" ".join(rnd.choices(some, k=rnd.randrange(25))) for _ in range(120)]
    texts[7], texts[8] = None, "new \x00 signs \u20ac"
    rows = [(k, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_tree.scores(frame, F.col("doc_id") % 4 != 0, depth=depth).collect()
    want = tree_scores([t or "" for t in texts], [k % 4 != 0 for k in range(120)], depth)
    assert len(got) == 120
    for r in got:
        assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-4, abs_tol=1e-4), r


def test_contexts_are_looked_at_whatever_their_share(spark):
    """A word seen 8 times in two million signs is learned."""
    rnd = random.Random(4)
    rows = [(k, " ".join(rnd.choices(["tic", "tac", "toe"], k=12_500))) for k in range(40)]
    rows += [(100 + k, "qzjxvkwy") for k in range(8)]
    rows += [(200, "qzjxvkwy"), (201, "yqzkxwvj")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_tree.scores(frame, F.col("doc_id") < 200).where("doc_id >= 200").collect()
    score = {r["doc_id"]: r["score"] for r in got}
    # the first sign must be dear, the seven others and the end are not
    assert score[200] > -12 and score[201] < 2 * score[200]


def test_grams_of_a_unit_by_pairs_and_by_keys(monkeypatch):
    rnd = np.random.default_rng(3)
    for depth in (1, 3, 8):
        monkeypatch.setattr(suffix_tree, "STEP", int(rnd.integers(5, 60)))
        stream = rnd.choice(np.array([10, 32, 97, 98], np.uint8), 500)
        stream[-1] = 10
        train = rnd.random((stream == 10).sum()) < 0.6
        found = []
        for limit in (0, 1 << 14):
            key, old, count, places = suffix_tree._unit(stream, train, depth, limit)
            at = np.concatenate(places)
            assert len(set(zip(key, old, strict=True))) == len(key)
            found.append([key[at], old[at], count[at]])
        assert all((a == b).all() for a, b in zip(*found, strict=True))
