import pytest
from pyspark.sql import functions as F

from burdenlens.operators import browse, cohorts, drilldown, filters, frequency
from burdenlens.schema import BROWSE_FIELDS, browse_projection, canonical_calls, choose_columns
from conftest import CASES, CONTROLS

WIDE = (
    "sample_id string, chr string, pos long, ref string, alt string, gene_symbol string,"
    " zygosity int, read_depth int, genotype_quality int, filters string, consensus_maf double,"
    " snpeff_impact string, snpeff_effect string, variant_confidence_by_depth double"
)


@pytest.fixture(scope="module")
def wide(spark):
    rows = [
        ("S1", "1", 1, "A", "C", "G1", 1, 10, 70, "PASS", 0.01, "HIGH", "STOP", 6.0),
        ("S2", "1", 1, "A", "C", "G1", 2, 9, 70, "PASS", 0.02, "LOW", "SILENT", 5.0),
        ("S3", "1", 2, "A", "G", "G2", 1, 30, 69, "my_snp_filter", None, "HIGH", None, None),
        ("S 4", "2", 3, "T", "G", "G3", None, 25, 99, "my_indel_filter", 0.0, None, "STOP", 9.0),
        ("S5", "2", 4, "T", "G", None, 1, None, None, None, 0.005, "HIGH", "INTRON", 7.0),
    ]
    return spark.createDataFrame(rows, WIDE).cache()


def who(df):
    return sorted(r["sample_id"] for r in df.select("sample_id").collect())


@pytest.mark.parametrize(
    "text, expected",
    [
        ("sample_id IN('A , B')", "sample_id IN('A','B')"),
        ("sample_id in ('A,B ,C') AND x = 1", "sample_id IN('A','B','C') AND x = 1"),
        ("g IN('A','B') OR h IN ( 'C , D' )", "g IN('A','B') OR h IN('C','D')"),
        ("n IN('A, B','C')", "n IN('A, B','C')"),
        ("n IN('O''Brien , Z')", "n IN('O''Brien','Z')"),
        ("n IN(1, 2)", "n IN(1, 2)"),
        ("name = 'Smith, John'", "name = 'Smith, John'"),
        ("a NOT IN('x , y z')", "a NOT IN('x','y z')"),
        ("", ""),
    ],
)
def test_in_list_shorthand(text, expected):
    assert filters.normalise_in_lists(text) == expected


# The shapes of predicate people save, with invented samples.
@pytest.mark.parametrize(
    "predicate, expected",
    [
        ("", ["S 4", "S1", "S2", "S3", "S5"]),
        (None, ["S 4", "S1", "S2", "S3", "S5"]),
        ("sample_id IN('S1 , S 4 , S9')", ["S 4", "S1"]),
        (
            "sample_id IN('S1,S2,S3') AND read_depth >= 10 AND genotype_quality >= 70"
            " AND ( consensus_maf <= 0.01 OR consensus_maf IS NULL )  AND snpeff_impact = 'HIGH'",
            ["S1"],
        ),
        ("( filters = 'PASS' OR filters = 'my_indel_filter' OR filters = 'my_snp_filter' )",
         ["S 4", "S1", "S2", "S3"]),
        ("snpeff_effect != 'SILENT' AND snpeff_effect != 'INTRON'", ["S 4", "S1"]),
        ("consensus_maf < 0.005 OR consensus_maf IS NULL", ["S 4", "S3"]),
        ("gene_symbol IN('G1,G3')", ["S 4", "S1", "S2"]),
    ],
)
def test_saved_predicates(wide, predicate, expected):
    assert who(filters.apply_predicate(wide, predicate)) == expected


@pytest.mark.parametrize(
    "condition, expected",
    [
        (lambda: filters.quality(), ["S 4", "S1"]),
        (lambda: filters.quality(5, 60, states=["PASS"], above_confidence=5), ["S1"]),
        (lambda: filters.rare(0.01), ["S 4", "S1", "S3", "S5"]),
        (lambda: filters.rare(0.01, strict=True), ["S 4", "S3", "S5"]),
        (lambda: filters.impact("HIGH"), ["S1", "S3", "S5"]),
        (lambda: filters.effect_not("SILENT"), ["S 4", "S1", "S5"]),
        (lambda: filters.in_genes(["G2"]), ["S3"]),
        (lambda: filters.samples_in("S1, S 4"), ["S 4", "S1"]),
        (lambda: filters.exact_variant("1", 1, "A", "C"), ["S1", "S2"]),
        (lambda: filters.id_range("pos", 2, 3), ["S 4", "S3"]),
        (lambda: filters.all_of(filters.rare(0.01), filters.impact("HIGH")), ["S1", "S3", "S5"]),
    ],
)
def test_presets(wide, condition, expected):
    assert who(wide.where(condition())) == expected


def test_listed_samples_and_genes(spark, wide):
    genes = spark.createDataFrame([("G1",), ("G1",), ("G3",)], "symbol string")
    assert who(filters.keep_listed(wide, genes, "gene_symbol")) == ["S 4", "S1", "S2"]


def test_browsing(wide):
    shown = browse.browse(wide, "read_depth > 0", {"sample_id": "Sample", "pos": "Position"}, 2)
    assert [tuple(r) for r in shown.collect()] == [("S1", 1), ("S2", 1)]
    assert browse.browse(wide, ordered=False, max_rows=3).count() == 3
    assert browse.browse(wide, max_rows=None).count() == 5
    counted = browse.count_rows(wide, "", max_rows=3).head()
    assert (counted["n_records"], counted["truncated"]) == (5, True)
    assert counted["notice"] == "Warning: Query returns 5 records. First 3 retrieved."
    assert browse.count_rows(wide, "pos = 1").head()["notice"] == ""


def test_browse_fields_and_choice(wide):
    assert len(BROWSE_FIELDS) == 36
    projected = browse_projection(wide.withColumn("private", F.lit(1)))
    assert "private" not in projected.columns
    assert projected.columns == [c for c in BROWSE_FIELDS if c in wide.columns]
    assert choose_columns(wide, ["pos", "chr"]).columns == ["pos", "chr"]


def test_earlier_column_generations(spark):
    first = spark.createDataFrame(
        [("P1", "1", 5, "A", "C", "G", "Heterozygous")],
        "Patient string, chr string, pos int, reference string, alternative string,"
        " gene_symbol string, zygosity string",
    )
    third = spark.createDataFrame(
        [("S1", "1", 5, "A", "C", "ENSG1", 2)],
        "sample_id string, chr string, position int, reference string, alternative string,"
        " gene_ensembl string, zygosity int",
    )
    for df, gene in ((first, "G"), (third, "ENSG1")):
        row = canonical_calls(df).select(
            "sample_id", "chr", "pos", "ref", "alt", "gene_symbol", "zygosity"
        ).head()
        assert (row["pos"], row["ref"], row["gene_symbol"]) == (5, "A", gene)


def test_facets_pivot_and_totals(wide):
    found = {(r["field"], r["value"]): r["n_rows"] for r in browse.facets(
        wide, ["chr", "filters"]).collect()}
    assert found[("chr", "1")] == 3 and found[("filters", None)] == 1
    table = browse.pivot(wide, ["chr"], "snpeff_impact", F.count(F.lit(1)), ["HIGH", "LOW"])
    assert {r["chr"]: (r["HIGH"], r["LOW"]) for r in table.collect()} == {
        "1": (2, 1), "2": (1, None)}
    sums = browse.totals(wide, ["chr"], F.sum("read_depth").alias("depth")).collect()
    assert {(r["chr"], r["depth"], r["level"]) for r in sums} == {
        ("1", 49, 0), ("2", 25, 0), (None, 74, 1)}


def test_drill_down(spark, calls):
    rows = drilldown.drill_down(calls, CASES, CONTROLS, ["G3", "G4"], "ill", "well")
    assert sorted((r["Group"], r["sample_id"]) for r in rows.collect()) == [
        ("ill", "A1"), ("ill", "A2"), ("ill", "A3"), ("well", "B2"), ("well", "B3"), ("well", "B4")]
    ranking = spark.createDataFrame([("G3", "G1")], "gene_symbol1 string, gene_symbol2 string")
    genes = drilldown.ranked_genes(ranking)
    rows = drilldown.drill_down(calls, CASES, None, genes)
    assert {r["sample_id"] for r in rows.collect()} == {"A1", "A2", "A3"}
    both = drilldown.drill_down(calls, "", CONTROLS, ["G4"])
    assert both.where("sample_id = 'B3'").count() == 2  # under each name


def test_counts_next_to_each_other(calls):
    found = drilldown.case_control_counts(calls, CASES, CONTROLS, F.col("pos"), "pos").collect()
    assert {r["pos"]: (r["n_case"], r["n_control"]) for r in found}[5] == (0, 1)


def test_recurrent_variants(wide):
    listed = frequency.recurrent_variants(wide, more_than=1)
    assert [r["variant_id"] for r in listed.collect()] == ["1:1:A:C"]
    assert who(frequency.drop_variants(wide, listed)) == ["S 4", "S3", "S5"]


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_recurrent_variants_in_one_scan(spark, wide, tmp_path):
    """One variant has half of all calls; calls without a variant id stay."""
    rows = spark.range(4000).selectExpr(
        "'S' || id % 977 AS sample_id", "IF(id % 100 = 3, NULL, '1') AS chr",
        "IF(id % 2 = 0, 0, id % 700) AS pos", "'A' AS ref", "'C' AS alt",
        "IF(id % 5 = 0, 'PASS', 'other') AS filters", "id AS n",
    )
    rows.repartition(6).write.parquet(str(tmp_path / "calls"))
    calls = spark.read.parquet(str(tmp_path / "calls"))
    expected = frequency.drop_variants(calls, frequency.recurrent_variants(calls, more_than=2))
    found = frequency.drop_recurrent(calls, more_than=2)
    both = (sorted(map(str, df.select(*found.columns).collect())) for df in (found, expected))
    assert next(both) == next(both)
    assert 0 < found.count() < 2000
    plan = executed(found)
    assert plan.count("FileScan parquet") == 1 and plan.count("ReusedExchange") == 1
    assert who(frequency.drop_recurrent(wide, more_than=1)) == ["S 4", "S3", "S5"]


def test_unordered_preview_reads_until_it_has_enough(spark, wide):
    """Later partitions would fail if they were read."""
    fails = F.when(F.col("pos") > 60_000, F.raise_error(F.lit("read"))).otherwise(F.lit("G"))
    rows = spark.range(0, 100_000, 1, 50).withColumnRenamed("id", "pos").withColumn("gene_symbol", fails)
    few = browse.browse(rows, ordered=False, max_rows=30)
    assert few.count() == 30
    assert "SinglePartition" not in executed(few.select("pos"))
    with pytest.raises(ValueError, match="at most"):
        browse.browse(rows, ordered=False, max_rows=browse.MAX_TAKEN + 1)
    assert browse.browse(wide, "read_depth > 9", ordered=False).count() == 3
    assert browse.browse(wide.limit(0), ordered=False).count() == 0


def test_cross_table_with_margins(spark):
    rows = [("a", "x", "p", 1), ("a", "x", "q", 2), ("a", None, "p", 4), (None, "x", None, 8), ("b", "x", "z", 16)]
    df = spark.createDataFrame(rows, "r1 string, r2 string, c string, n long")
    found = browse.cross_table(df, ["r1", "r2"], "c", ["p", "q", None], lambda w: F.sum(F.when(w, F.col("n"))))
    assert {(r["r1"], r["r2"], r["level"]): tuple(r)[2:6] for r in found.collect()} == {
        ("a", "x", 0): (1, 2, None, 3), ("a", None, 0): (4, None, None, 4),
        (None, "x", 0): (None, None, 8, 8), ("b", "x", 0): (None, None, None, 16),
        ("a", None, 1): (5, 2, None, 7), (None, None, 1): (None, None, 8, 8),
        ("b", None, 1): (None, None, None, 16), (None, None, 3): (5, 2, 8, 31),
    }
    assert executed(found).count(" Exchange ") == 1


def test_sample_texts_of_bounded_size(spark):
    n = 3000
    ids = spark.range(n).selectExpr("IF(id % 3 = 0, NULL, 'g' || id % 2) AS g", "repeat('é', id % 7) || id AS s")
    found = cohorts.sample_list_text(ids.unionByName(ids), ["g"], "s", max_bytes=200).collect()
    assert all(len(r["sample_ids"].encode()) <= 200 for r in found)
    for g in (None, "g0", "g1"):
        texts = sorted((r["part"], r["sample_ids"]) for r in found if r["g"] == g)
        joined = [s for _, text in texts for s in text.split(" , ")]
        assert joined == sorted(joined, key=str.encode) and len(joined) == n // 3
        assert [part for part, _ in texts] == list(range(len(texts)))
    with pytest.raises(Exception, match="no room"):
        cohorts.sample_list_text(ids, ["g"], "s", max_bytes=10).collect()
    assert cohorts.sample_list_text(ids.limit(0), ["g"], "s").collect() == []


def test_sample_lists(spark, calls):
    ids = [r[0] for r in cohorts.sample_ids(calls.where(CASES)).collect()]
    assert ids == ["A1", "A2", "A3"]
    groups = calls.withColumn("g", F.substring("sample_id", 1, 1))
    texts = cohorts.sample_list_text(groups, ["g"]).collect()
    assert {r["g"]: r["sample_ids"] for r in texts} == {
        "A": "A1 , A2 , A3", "B": "B1 , B2 , B3 , B4"}
    dealt = cohorts.sample_list_text(groups, ["g"], max_bytes=8).collect()
    assert {(r["g"], r["part"]): r["sample_ids"] for r in dealt} == {
        ("A", 0): "A1 , A2", ("A", 1): "A3", ("B", 0): "B1 , B2", ("B", 1): "B3", ("B", 2): "B4"}


def test_phenotype_to_calls(spark, calls):
    phenotypes = spark.createDataFrame(
        [("Clinic A", "A1", "NEURODEV"), ("Clinic A", "B1", "Control"), ("X", "B2", "NEURODEV")],
        "Data_Source string, Sample_ID string, Pathology string",
    )
    kept = cohorts.calls_of_phenotype(
        calls, phenotypes, "Data_Source = 'Clinic A' AND Pathology = 'NEURODEV'"
    )
    assert set(who(kept)) == {"A1"}


def test_stack_and_blank(calls):
    stacked = cohorts.stack_groups(calls.where(CONTROLS), calls.where(CASES))
    assert stacked.where("is_case").count() == calls.where(CASES).count()
    blanked = filters.blank_where(calls, "gene_symbol", F.col("sample_id") == "A1")
    assert {r[0] for r in blanked.where("sample_id = 'A1'").select("gene_symbol").collect()} == {""}
