"""Pairs of single samples are dealt as lists of partners and added up once, where they arrive."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from burdenlens.operators import pairs


def units_of(spark, split_above):
    rng = random.Random(3)
    carried = [(f"v{k}", f"s{s}") for s in range(40) for k in rng.sample(range(60), 12)]
    carried += [("v0", f"s{s}") for s in range(40) if ("v0", f"s{s}") not in carried]
    n_case = Counter(v for v, _ in carried)
    rows = [(int(v[1:]), n_case[v], s, True) for v, s in carried]
    placed = spark.createDataFrame(rows, "id long, n_case long, sample_id string, in_case boolean")
    cases, _ = pairs._units(placed, 60, False, split_above)
    by_sample = {}
    for v, s in carried:
        by_sample.setdefault(s, []).append((-n_case[v], int(v[1:])))
    want = Counter((y[1], x[1]) for own in by_sample.values() for x, y in combinations(sorted(own), 2))
    return cases, want


@pytest.mark.parametrize("split_above", [1024, 5])
@pytest.mark.parametrize("hot", [1 << 12, 3])
def test_lists_give_every_pair_once(spark, monkeypatch, split_above, hot):
    monkeypatch.setattr(pairs, "HOT", hot)
    cases, want = units_of(spark, split_above)
    got = cases.pairs(None, pairs._Bound(0, 0)).collect()
    assert len(got) == len(want)
    assert {(r["x"], r["y"]): r["n"] for r in got} == want


def test_pairs_are_not_added_up_before_the_shuffle(spark):
    """Nearly all are distinct, so that would hold and spill them; before, each was a row of the shuffle."""
    cases, want = units_of(spark, 1024)
    found = cases.pairs(None, pairs._Bound(0, 0))
    plan = found._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("REPARTITION_BY_NUM", 1)
    assert "Generate explode(ys" in above and "keys=[x" in above and "keys=[x" not in below
    assert found.agg(F.sum("n")).first()[0] == sum(want.values())
