"""What the Jaccard join leaves out before it compares sets is no link, and is much."""

import random

from pyspark.sql import functions as F

from burdenlens.llm import jaccard
from burdenlens.llm.common import summed


def copies(spark, seed):
    """Near copies of two texts at several distances, with a passage that all share, repeated rows too."""
    rng = random.Random(seed)
    passage = " ".join(f"common{k}" for k in range(30))
    texts = []
    for base in range(2):
        words = [f"w{base}x{k}" for k in range(60)]
        for _ in range(60):
            own = list(words)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = f"new{rng.random()}"
            texts.append(" ".join(own[: rng.randint(45, 60)]) + f" {passage}" * (rng.random() < 0.5))
    texts += texts[:5] + [passage, "", None]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_no_linked_pair_is_left_out_by_place_size_or_mark(spark):
    docs = copies(spark, 1)
    found = jaccard._described(docs)
    levels = jaccard._levels(summed(found.where("block IS NOT NULL").select("block", "counts"), jaccard.BUCKETS))
    heads = jaccard._heads(docs, levels, 75).cache()
    shared = jaccard._shared(heads, 75)
    marks = found.where("n > 0").groupBy("name").agg(F.first("n").alias("n"), F.first("mark").alias("mark"))
    sets = {r["name"]: frozenset(r["runs"][i : i + 8] for i in range(0, len(r["runs"]), 8))
            for r in jaccard._fetched(docs, marks.select("name"), levels).collect()}
    want = {
        (a, b) for a in sets for b in sets
        if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    }
    rows = shared.join(marks.select("name", "mark"), "name")
    met = rows.alias("p").join(rows.alias("q"), F.expr(
        "p.run = q.run AND p.name < q.name AND q.n <= p.most AND p.n <= q.most"
    ))
    passed = met.where(jaccard._may_link(75)).select("p.name", "q.name").distinct()
    got = {tuple(r) for r in passed.collect()}
    assert len(want) > 300 and want <= got
    assert len(got) < 1.5 * len(want)  # most that do not link are left out by sizes and marks alone
    assert shared.count() < 0.6 * heads.count()  # runs of the same sets are one


def test_wide_marks_leave_out_large_sets_that_do_not_link(spark):
    rng = random.Random(3)
    shared = [f"s{k}" for k in range(400)]
    large = [[f"w{base}x{k}" for k in range(2600)] + shared for base in range(6)]
    texts = [" ".join(words) for words in large]
    for words in large:
        own = list(words)
        for _ in range(40):
            own[rng.randrange(len(own))] = f"new{rng.random()}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate([*texts, "a b c", None])), "doc_id long, text string")
    found = jaccard._described(docs)
    marks = found.where("n > 0").groupBy("name").agg(*(F.first(c).alias(c) for c in ("doc_id", "n", "mark", "wide")))
    marks = marks.cache()
    pairs = marks.alias("p").join(marks.alias("q"), F.expr("p.doc_id < q.doc_id")).where(
        "100 * least(p.n, q.n) >= 75 * greatest(p.n, q.n)"
    )
    narrow = pairs.where(jaccard._may_link(75)).select(F.col("p.name").alias("a"), F.col("q.name").alias("b"))
    names = {r["name"]: r["doc_id"] for r in marks.collect()}
    left = {(names[r["a"]], names[r["b"]]) for r in jaccard._plausible(narrow, marks, 75).collect()}
    assert narrow.count() == 66  # marks say nothing of sets of this size
    assert left == {(k, k + 6) for k in range(6)}
    roots = {r["doc_id"]: r["component_id"] for r in jaccard.groups(docs).collect()}
    assert roots == {k: k % 6 if k < 12 else k for k in range(14)}


def test_few_edges_are_tied_up_in_one_step_and_many_in_rounds(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(300)]
    edges += [(k, k + 1) for k in range(1000, 1100)]
    root = {}

    def top(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    want = {k: top(k) for k in {x for a, b in edges if a != b for x in (a, b)}}
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    calls = []
    plain = jaccard.kept
    monkeypatch.setattr(jaccard, "kept", lambda f: calls.append(1) or plain(f))
    few = jaccard.components(frame).collect()
    assert {r["name"]: r["root"] for r in few} == want and len(few) == len(want)
    assert len(calls) == 2  # no rounds of joins
    monkeypatch.setattr(jaccard, "EDGES", 16)
    many = jaccard.components(frame).collect()
    assert {r["name"]: r["root"] for r in many} == want and len(many) == len(want)
    assert len(calls) > 5
