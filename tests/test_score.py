import random

import brute
import pytest
from conftest import CASES, CONTROLS, HAND_MADE, calls_of
from pyspark.sql import functions as F

from burdenlens import (
    AnalysisSpec,
    case_exclusive_variants,
    count_difference,
    number_of_tests,
    score,
    with_rank,
)
from burdenlens.operators import burden, cohorts, frequency, pairs

FREE = {"case_max_freq": 1.0, "control_max_freq": 1.0}


def ranked(calls, **options):
    return score(calls, AnalysisSpec("t", CASES, CONTROLS, **options)).collect()


def random_rows(seed, samples=30, variants=25, genes=6, density=0.2):
    rng = random.Random(seed)
    rows = []
    for i in range(samples):
        name = ("A" if i % 3 else "B") + str(i)
        for v in range(variants):
            if rng.random() < density * (1 + v % 4) / 2:
                for _ in range(rng.choice((1, 1, 1, 2))):
                    rows.append((name, f"v{v}", f"G{v % genes}", rng.choice((1, 2))))
    return rows


def as_calls(spark, rows):
    return calls_of(spark, " ".join(f"{s} {v} {g} {d}" for s, v, g, d in rows))


def as_brute(rows):
    return brute.Calls([(s, f"1:{v[1:]}:A:C", g, d) for s, v, g, d in rows])


# --- hand-made calls ----------------------------------------------------------------------------


@pytest.mark.parametrize("table, p", [("standard", (4 / 35, 13 / 35)), ("compat", (1 / 14, 2 / 7))])
def test_genes(calls, table, p):
    found = ranked(calls, fisher_table=table, **FREE)
    assert [r["gene_symbol"] for r in found] == ["G1", "G3"]
    assert [r["score"] for r in found] == pytest.approx([0.75, 2 / 3 - 1 / 4])
    assert [r["pvalue"] for r in found] == pytest.approx(p)
    assert [(r["sum_case"], r["sum_control"]) for r in found] == [(3, 1), (2, 1)]
    assert {(r["n_case"], r["n_control"], r["ntests"]) for r in found} == {(3, 4, 4)}


@pytest.mark.parametrize("packed", [None, True, False])
def test_gene_pairs(calls, packed, monkeypatch):
    shared = pairs.shared_carriers
    monkeypatch.setattr(pairs, "shared_carriers", lambda *a, **k: shared(*a, packed=packed, **k))
    found = ranked(calls, scope="digenic", **FREE)
    keys = [(r["gene_symbol1"], r["gene_symbol2"]) for r in found]
    assert keys == [("G3", "G1"), ("G4", "G1"), ("G2", "G1"), ("G3", "G2")]
    assert [(r["sum_case"], r["sum_control"]) for r in found] == [(2, 0), (1, 0), (1, 1), (1, 1)]
    assert [r["score"] for r in found] == pytest.approx([2 / 3, 1 / 3, 1 / 12, 1 / 12])
    assert [r["pvalue"] for r in found] == pytest.approx([1 / 7, 3 / 7, 5 / 7, 5 / 7])
    assert {(r["ntests"], r["npairs"]) for r in found} == {(10, 6)}


def test_case_exclusive(calls):
    found = case_exclusive_variants(calls, CASES, CONTROLS).collect()
    assert [(r["variant_id"], r["score"]) for r in found] == [("1:1:A:C", 2), ("1:4:A:C", 2)]


def test_frequency_limits(calls):
    rows = cohorts.unique_calls(cohorts.tag_groups(calls, CASES, CONTROLS))
    sizes = cohorts.group_sizes(cohorts.sample_roles(rows)).select(
        F.struct("n_case", "n_control")
    )

    def kept(strict):
        frequencies = frequency.variant_frequencies(rows, sizes.scalar())
        left = frequency.drop_frequent(rows, frequencies, 0.5, 0.5, strict)
        return {r["variant_id"].split(":")[1] for r in left.select("variant_id").collect()}

    assert kept(False) == {"2", "3", "5", "6"}
    assert kept(True) == {"2", "5"}


def test_burdens(calls):
    rows = cohorts.unique_calls(cohorts.tag_groups(calls, CASES, CONTROLS))

    def of_g1(by):
        found = burden.gene_burden(rows, by).where("gene_symbol = 'G1'").collect()
        return {r["sample_id"]: r["burden"] for r in found}

    assert of_g1("alleles") == {"A1": 2, "A2": 2, "A3": 1, "B1": 1}
    assert of_g1("variants") == {"A1": 1, "A2": 1, "A3": 1, "B1": 1}


def test_count_difference(calls):
    found = count_difference(calls, CASES, CONTROLS).collect()
    assert [tuple(r) for r in found] == [("G1", 2, 3, 1), ("G3", 1, 2, 1)]


def test_allele_t_test_on_genes(calls):
    found = {r["gene_symbol"]: r for r in ranked(calls, test="ttest", burden="alleles", **FREE)}
    assert set(found) == {"G1", "G2", "G3", "G4"}  # negative scores stay
    g1 = found["G1"]
    assert (g1["sum_case"], g1["sum_control"]) == (5, 1)
    assert g1["pvalue"] == pytest.approx(brute.t_halved([2, 2, 1], [1, 0, 0, 0]), rel=1e-11)


@pytest.mark.parametrize("options", [{}, FREE, {"scope": "digenic", **FREE}])
def test_number_of_tests(calls, options):
    row = number_of_tests(calls, AnalysisSpec("t", CASES, CONTROLS, **options)).head().asDict()
    assert row == {
        "n_case": 3, "n_control": 4, "tests_gene": 4, "tests_variant": 6, "tests_gene_pair": 10,
        "gene_pairs": 6, "tests_variant_pair": 21, "variant_pairs": 15,
    }


# --- edge cases ---------------------------------------------------------------------------------


def test_sample_in_both_groups_is_refused(calls):
    spec = AnalysisSpec("t", "sample_id <= 'B1'", CONTROLS)
    with pytest.raises(Exception, match="in the case and in the control group"):
        score(calls, spec).collect()
    with pytest.raises(Exception, match="in the case and in the control group"):
        score(calls, AnalysisSpec("t", "sample_id <= 'B1'", CONTROLS, scope="digenic")).collect()


def test_sample_in_both_groups_can_be_left_out(calls):
    spec = AnalysisSpec("t", "sample_id <= 'B1'", CONTROLS, on_overlap="exclude", **FREE)
    found = score(calls, spec).collect()
    assert {(r["n_case"], r["n_control"]) for r in found} == {(3, 3)}
    assert {r["gene_symbol"]: r["sum_control"] for r in found}["G1"] == 0


def test_no_control_group(calls):
    found = score(calls, AnalysisSpec("t", CASES, None, **FREE)).collect()
    assert {(r["ratio_control"], r["pvalue"], r["n_control"]) for r in found} == {(0.0, None, 0)}
    assert [(r["gene_symbol"], r["sum_case"]) for r in found] == [
        ("G1", 3), ("G3", 2), ("G2", 1), ("G4", 1),
    ]


def test_sample_without_rows_left_leaves_the_group(spark, calls):
    found = score(calls, AnalysisSpec("t", CASES + " AND gene_symbol = 'G3'", CONTROLS, **FREE))
    assert {(r["n_case"], r["n_control"]) for r in found.collect()} == {(2, 4)}


def test_fixed_cohort_keeps_its_size(spark, calls):
    cohort = spark.createDataFrame(
        [(s, s < "B") for s in ("A1", "A2", "A3", "A9", "B1", "B2", "B3", "B4")],
        "sample_id string, is_case boolean",
    )
    spec = AnalysisSpec("t", "gene_symbol != 'G4'", "", cohort=cohort, **FREE)
    found = score(calls, spec).collect()
    assert {(r["n_case"], r["n_control"]) for r in found} == {(4, 4)}
    assert found[0]["ratio_case"] == 3 / 4


def test_variant_in_two_genes_counts_in_both(spark):
    calls = calls_of(spark, "A1 v1 G1 1 A1 v1 G2 1 B1 v2 G3 1")
    found = ranked(calls, **FREE)
    assert [(r["gene_symbol"], r["sum_case"], r["ntests"]) for r in found] == [
        ("G1", 1, 3), ("G2", 1, 3),
    ]


def test_calls_without_gene_form_a_gene_of_their_own(spark):
    calls = calls_of(spark, "A1 v1 G1 1 A2 v9 NONE 1 B1 v2 G3 1 A1 v9 NONE 2").withColumn(
        "gene_symbol", F.nullif(F.col("gene_symbol"), F.lit("NONE"))
    )
    assert ranked(calls, **FREE)[0]["gene_symbol"] is None
    pair = ranked(calls, scope="digenic", **FREE)[0]
    assert (pair["gene_symbol1"], pair["gene_symbol2"]) == ("G1", None)
    assert ranked(calls, case_max_freq=0.5, control_max_freq=0.5)[0]["gene_symbol"] == "G1"


def test_ties_are_ordered_by_key(spark):
    calls = calls_of(spark, "A1 v1 G2 1 A1 v2 G1 1 A1 v3 G3 1 B1 v4 G4 1")
    assert [r["gene_symbol"] for r in ranked(calls, top_k=2, **FREE)] == ["G1", "G2"]


def test_rank_positions(calls):
    ranking = score(calls, AnalysisSpec("t", CASES, CONTROLS, **FREE))
    assert [(r["rank"], r["gene_symbol"]) for r in with_rank(ranking, "gene_symbol").collect()] == [
        (1, "G1"), (2, "G3"),
    ]


def test_all_rows_are_numbered(spark):
    """Ties by key, over several ranges and beyond any default length."""
    ranking = spark.range(5000).selectExpr("id % 7 / 10 AS score", "concat('g', id) AS gene_symbol")
    found = [tuple(r) for r in with_rank(ranking.repartition(5), "gene_symbol").collect()]
    expected = sorted(((k % 7 / 10, f"g{k}") for k in range(5000)), key=lambda r: (-r[0], r[1]))
    assert found == [(*r, k + 1) for k, r in enumerate(expected)]
    cut = with_rank(ranking, "gene_symbol", top_k=3).collect()
    assert [tuple(r) for r in cut] == [(*r, k + 1) for k, r in enumerate(expected[:3])]


@pytest.mark.parametrize("packed, split", [(True, 1024), (False, 1024), (False, 2)])
def test_unknown_and_empty_genes_are_two_items(spark, packed, split):
    rows = [("A1", "G1"), ("A1", ""), ("A1", None), ("A2", "G1"), ("A2", None), ("B1", ""), ("B1", None)]
    frame = spark.createDataFrame(rows, "sample_id string, gene_symbol string")
    in_case = F.col("sample_id").startswith("A")
    carrying = frame.withColumn("in_case", in_case).withColumn("in_control", ~in_case)
    found = pairs.shared_carriers(carrying, "gene_symbol", "x", "y", packed=packed, split_above=split)
    assert {(r["x"], r["y"]): (r["sum_case"], r["sum_control"]) for r in found.collect()} == {
        ("G1", ""): (1, 0),
        ("G1", None): (2, 0),
        ("", None): (1, 1),
    }


def test_pairs_of_different_blocks_are_formed_once(spark):
    rows = spark.range(64).selectExpr("'A1' AS sample_id", "true AS in_case", "false AS in_control", "concat('g', id) AS g")
    joined = pairs.shared_carriers(rows, "g", "x", "y", packed=False, split_above=8)
    assert joined.count() == 64 * 63 // 2
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "block1" in plan and "Cartesian" not in joined._jdf.queryExecution().toString()


def test_number_of_pairs_is_exact(spark):
    n = 3_000_000_001
    row = spark.range(1).select(pairs.pair_count(F.lit(n)).alias("p"), pairs.pair_tests(F.lit(n)).alias("t"))
    assert tuple(row.head()) == (n * (n - 1) // 2, n * (n + 1) // 2)


def test_overlap_in_the_other_rankings(calls):
    shared = "sample_id IN ('A1', 'B1')"
    for ranking_of in (case_exclusive_variants, count_difference):
        with pytest.raises(Exception, match="in the case and in the control group"):
            ranking_of(calls, CASES, shared).collect()
        left_out = ranking_of(calls, CASES, shared, on_overlap="exclude").collect()
        alone = ranking_of(calls.where("sample_id <> 'A1'"), CASES, shared).collect()
        assert left_out == alone


def test_a_sample_listed_twice_counts_once(spark, calls):
    twice = [("A1", True), ("A1", True), ("A2", True), ("B1", False), ("B1", False)]
    cohort = spark.createDataFrame(twice, "sample_id string, is_case boolean")
    unique = cohorts.unique_calls(cohorts.tag_groups(calls, CASES, CONTROLS))
    assert unique.count() < calls.count()
    distinct = calls.dropDuplicates(["sample_id", "pos", "gene_symbol"])
    for table, options in ((calls, {}), (distinct, {"deduplicated": True})):
        found = ranked(table, cohort=cohort, min_score=None, **FREE, **options)
        assert all(r["sum_case"] <= r["n_case"] == 2 and r["n_control"] == 1 for r in found)


def test_bad_parameters_are_refused():
    with pytest.raises(ValueError):
        AnalysisSpec("t", "", "", scope="trigenic")
    with pytest.raises(ValueError):
        AnalysisSpec("t", "", "", scope="digenic", test="ttest")


# --- against brute force ------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_genes_against_brute_force(spark, seed):
    rows = random_rows(seed)
    found = ranked(as_calls(spark, rows), case_max_freq=0.3, control_max_freq=0.4)
    expected = as_brute(rows).gene_fisher(0.3, 0.4)
    assert [(r["gene_symbol"], r["sum_case"], r["sum_control"]) for r in found] == [
        (e[0], e[4], e[5]) for e in expected
    ]
    assert [r["score"] for r in found] == [e[1] for e in expected]
    for r in found:
        exact = brute.fisher(r["sum_case"], r["n_case"], r["sum_control"], r["n_control"])
        assert r["pvalue"] == pytest.approx(exact, rel=1e-10)


def test_variants_against_brute_force(spark):
    rows = random_rows(3)
    b = as_brute(rows)
    found = ranked(as_calls(spark, rows), scale="variant", top_k=None, case_max_freq=0.4)
    kept = b.within(0.4, 0.5)
    assert {(r["gene_symbol"], r["variant_id"]) for r in found} == {k[:2] for k in kept}
    for r in found:
        key = (r["gene_symbol"], r["variant_id"])
        case = [kept.get((*key, s), 0) for s in b.cases]
        control = [kept.get((*key, s), 0) for s in b.controls]
        assert (r["sum_case"], r["sum_control"]) == (sum(case), sum(control))
        assert r["pvalue"] == pytest.approx(brute.t_halved(case, control), rel=1e-9)


@pytest.mark.parametrize("packed, split", [(True, 1024), (False, 1024), (True, 2), (False, 2)])
@pytest.mark.parametrize("item, part", [("gene_symbol", 0), ("variant_id", 1)])
def test_pairs_against_brute_force(spark, packed, split, item, part):
    """Both ways of forming pairs, with and without splitting large samples."""
    rows = random_rows(4, samples=80)
    tagged = cohorts.tag_groups(as_calls(spark, rows), CASES, CONTROLS)
    carrying = burden.carriers(cohorts.unique_calls(tagged), item)
    found = pairs.shared_carriers(carrying, item, "x", "y", packed=packed, split_above=split)
    got = {(r["x"], r["y"]): (r["sum_case"], r["sum_control"]) for r in found.collect()}
    expected = {
        (max(e[0]), min(e[0])): (e[4], e[5]) for e in as_brute(rows).pairs(part, 1.0, 1.0)
    }
    assert got == expected


def test_packing_more_samples_than_a_cell_holds(spark):
    n = 1500
    rows = spark.range(n).select(
        F.concat(F.lit("A"), "id").alias("sample_id"), (F.col("id") % 3 != 0).alias("in_case")
    ).withColumn("in_control", ~F.col("in_case"))
    carrying = rows.withColumn("gene_symbol", F.explode(F.array(F.lit("x"), F.lit("y"), F.lit("z"))))
    found = pairs.shared_carriers(carrying, "gene_symbol", "g1", "g2").collect()
    assert {(r["sum_case"], r["sum_control"]) for r in found} == {(1000, 500)}
    assert len(found) == 3


@pytest.mark.parametrize(
    "top_k, scale, part, leading, min_score",
    [
        (5, "gene", 0, 3, 0.0),
        (40, "variant", 1, 3, None),
        (40, "variant", 1, 1000, 0.0),
        (5000, "variant", 1, 7, None),
    ],
)
def test_rounds_of_a_cut_ranking_change_no_ranking(spark, monkeypatch, top_k, scale, part, leading, min_score):
    """Blocks of items by case share, ties included; also where too few pairs can be told by shares."""
    monkeypatch.setattr(pairs, "FEW", 0)
    monkeypatch.setattr(pairs, "LEADING", leading)
    rows = random_rows(11, samples=40, variants=60, genes=20, density=0.1)
    found = ranked(
        as_calls(spark, rows), scope="digenic", scale=scale, top_k=top_k, min_score=min_score, **FREE
    )
    # the brute-force order of pairs is by key, smaller member first where variants are paired
    expected = [
        e for e in as_brute(rows).pairs(part, 1.0, 1.0) if min_score is None or e[1] > min_score
    ][:top_k]
    keys = [c for c in found[0].asDict() if c[-1] in "12"]
    assert [(tuple(r[k] for k in keys), r["sum_case"], r["sum_control"]) for r in found] == [
        (e[0], e[4], e[5]) for e in expected
    ]


@pytest.mark.parametrize("packed, split", [(True, 2), (False, 1024), (False, 2)])
def test_rounds_with_both_kinds_of_units(spark, packed, split):
    rows = random_rows(4, samples=80)
    tagged = cohorts.tag_groups(as_calls(spark, rows), CASES, CONTROLS)
    carrying = burden.carriers(cohorts.unique_calls(tagged), "variant_id")
    b = as_brute(rows)
    found = pairs.best_pairs(
        carrying, "variant_id", "x", "y", len(b.cases), len(b.controls), 30, 0.0,
        packed=packed, split_above=split, leading=5,
    )
    got = {(r["x"], r["y"]): (r["sum_case"], r["sum_control"]) for r in found.collect()}
    expected = [e for e in b.pairs(1, 1.0, 1.0) if e[1] > 0]
    least = expected[29][1]
    assert got == {
        (max(e[0]), min(e[0])): (e[4], e[5]) for e in expected if e[1] >= least
    }


def test_rounds_form_few_pairs_and_end_early(spark, monkeypatch):
    """Twenty items that cases share and many that single samples carry: what is formed is counted."""
    n = 60
    common = spark.range(20).crossJoin(spark.range(n).withColumnRenamed("id", "s")).selectExpr(
        "'c' || id AS gene_symbol", "'A' || s AS sample_id", "(s + id) % 3 > 0 AS in_case"
    ).where("in_case")
    rare = spark.range(n).crossJoin(spark.range(50).withColumnRenamed("id", "k")).selectExpr(
        "'r' || (k * 7 + id * 3) % 900 AS gene_symbol", "'A' || id AS sample_id", "true AS in_case"
    ).distinct()
    controls = spark.range(900).selectExpr(
        "'r' || id AS gene_symbol", "'B' || id % 30 AS sample_id", "false AS in_case"
    )
    carrying = common.unionByName(rare).unionByName(controls).cache()
    formed = []
    real = pairs._Units.pairs

    def spied(self, done, bound):
        out = real(self, done, bound)
        formed.append(out.agg(F.sum("n")).head()[0] or 0)
        return out

    monkeypatch.setattr(pairs._Units, "pairs", spied)
    found = pairs.best_pairs(carrying, "gene_symbol", "x", "y", n, 30, 10, 0.0, packed=False, leading=30)
    everything = pairs.shared_carriers(carrying, "gene_symbol", "x", "y", packed=False)
    total = everything.agg(F.sum(F.col("sum_case") + F.col("sum_control"))).head()[0]
    assert sum(formed) * 10 <= total
    score = F.col("sum_case") / n - F.col("sum_control") / 30
    best = [tuple(r) for r in everything.orderBy(F.desc(score), "x", "y").limit(10).collect()]
    assert [tuple(r) for r in found.orderBy(F.desc(score), "x", "y").limit(10).collect()] == best

def test_uncut_pair_ranking(spark):
    rows = random_rows(6)
    found = ranked(as_calls(spark, rows), scope="digenic", scale="variant", top_k=None, **FREE)
    expected = as_brute(rows).pairs(1, 1.0, 1.0)
    assert [((r["variant_id1"], r["variant_id2"]), r["sum_case"], r["sum_control"]) for r in found] == [
        (e[0], e[4], e[5]) for e in expected
    ]
    for r in found:
        exact = brute.fisher(r["sum_case"], r["n_case"], r["sum_control"], r["n_control"])
        assert r["pvalue"] == pytest.approx(exact, rel=1e-10)


# --- properties ---------------------------------------------------------------------------------


def test_swapping_the_groups_negates_the_score(spark):
    calls = as_calls(spark, random_rows(7))
    one = score(calls, AnalysisSpec("t", CASES, CONTROLS, min_score=None, **FREE)).collect()
    two = score(calls, AnalysisSpec("t", CONTROLS, CASES, min_score=None, **FREE)).collect()
    negated = {r["gene_symbol"]: -r["score"] for r in two}
    assert {r["gene_symbol"]: r["score"] for r in one} == negated


def test_widening_a_group_never_lowers_its_sums(spark):
    calls = as_calls(spark, random_rows(8))
    few = score(calls, AnalysisSpec("t", CASES + " AND pos < 12", CONTROLS, min_score=None, **FREE))
    all_ = score(calls, AnalysisSpec("t", CASES, CONTROLS, min_score=None, **FREE))
    wide = {r["gene_symbol"]: r["sum_case"] for r in all_.collect()}
    assert all(r["sum_case"] <= wide[r["gene_symbol"]] for r in few.collect())


def test_a_pair_has_no_more_carriers_than_its_genes(spark):
    calls = as_calls(spark, random_rows(9))
    options = {"min_score": None, **FREE}
    alone = {r["gene_symbol"]: r for r in ranked(calls, **options)}
    for r in ranked(calls, scope="digenic", **options):
        for g in (r["gene_symbol1"], r["gene_symbol2"]):
            assert r["sum_case"] <= alone[g]["sum_case"]
            assert r["sum_control"] <= alone[g]["sum_control"]


def test_duplicated_table_scores_the_same(spark):
    calls = as_calls(spark, random_rows(10))
    once, twice = (ranked(c) for c in (calls, calls.union(calls).union(calls)))
    assert once == twice


def test_table_known_to_be_unique(spark, calls):
    unique = calls.groupBy("sample_id", "chr", "pos", "ref", "alt", "gene_symbol").agg(
        F.max("zygosity").alias("zygosity")
    )
    for options in ({}, {"scale": "variant"}, {"scope": "digenic"}, {"test": "ttest"}):
        assert ranked(unique, deduplicated=True, **options) == ranked(calls, **options)


def test_scan_is_shared_and_pruned(spark, tmp_path):
    """One scan and one shuffle of the calls serve scores, sizes and test counts."""
    wide = calls_of(spark, HAND_MADE).withColumn("unused", F.lit("x"))
    wide.write.parquet(str(tmp_path / "calls"))
    calls = spark.read.parquet(str(tmp_path / "calls"))
    ranking = score(calls, AnalysisSpec("t", CASES, CONTROLS))
    ranking.collect()
    plan = ranking._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "ReusedExchange" in final
    assert "unused" not in plan
    assert "PushedFilters" in plan
