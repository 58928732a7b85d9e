"""One query per operator of the engine, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenlens import (
    AnalysisSpec,
    case_exclusive_variants,
    count_difference,
    number_of_tests,
    score,
    with_rank,
)
from burdenlens.functions import display, keys
from burdenlens.operators import browse as b
from burdenlens.operators import burden, cohorts, drilldown, filters, frequency
from burdenlens.plans.score import group_rows
from burdenlens.schema import SCORING_FIELDS, canonical_calls, choose_columns, scoring_projection
from burdenlens.sources import calls as call_io
from burdenlens.sources import groups as group_io
from burdenlens.sources import phenotypes as phenotype_io
from burdenlens.sources import results, synthetic
from burdenlens.sources.warehouse import customer_phenotypes, order_calls
from burdenlens.workspace import new_folder
from workload.groups import (
    ALL_CASE,
    ALL_CONTROL,
    CASE,
    CONTROL,
    HIGH,
    LOW,
    PANEL,
    SAMPLE_TEXT,
    SAVED,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def digits(pvalue: Column) -> Column:
    """Six significant digits of a p-value, so that two implementations can be compared exactly."""
    return F.when(pvalue.isNotNull(), F.format_string("%.5e", pvalue).cast("double"))


def rounded(ranking: DataFrame, test: str = "fisher") -> DataFrame:
    """P-values to six significant digits, or, for the t-test, whose counterpart in SQL subtracts
    from 1, to six decimals."""
    shown = digits(F.col("pvalue")) if test == "fisher" else F.round("pvalue", 6)
    return ranking.withColumn("pvalue", shown)


def ranking(spark: SparkSession, sf_dir: str, case=CASE, control=CONTROL, **options) -> DataFrame:
    spec = AnalysisSpec("ranking", case, control, **options)
    return rounded(score(order_calls(spark, sf_dir), spec), spec.effective_test)


def by_gene(calls: DataFrame) -> DataFrame:
    """Summary of a call table in which every row and scoring column takes part."""
    return calls.groupBy("gene_symbol").agg(
        F.count("*").alias("n_calls"),
        F.countDistinct("sample_id").alias("n_samples"),
        F.sum("zygosity").cast("bigint").alias("sum_zygosity"),
        F.sum("pos").cast("bigint").alias("sum_pos"),
        F.min("chr").alias("first_chr"),
        F.max("ref").alias("last_ref"),
        F.max("alt").alias("last_alt"),
    )


# --- scoring ------------------------------------------------------------------------------------


@query
def gene_monogenic(spark, sf_dir):
    return ranking(spark, sf_dir)


@query
def gene_monogenic_compat(spark, sf_dir):
    return ranking(spark, sf_dir, fisher_table="compat")


@query
def gene_monogenic_rare(spark, sf_dir):
    return ranking(spark, sf_dir, ALL_CASE, ALL_CONTROL, case_max_freq=0.005, control_max_freq=0.005)


@query
def gene_monogenic_strict(spark, sf_dir):
    limits = {"case_max_freq": 0.012, "control_max_freq": 0.015, "strict_freq": True}
    return ranking(spark, sf_dir, ALL_CASE, ALL_CONTROL, min_score=None, **limits)


@query
def gene_no_control(spark, sf_dir):
    return ranking(spark, sf_dir, control=None)


@query
def gene_overlap_excluded(spark, sf_dir):
    return ranking(spark, sf_dir, HIGH, LOW, on_overlap="exclude", min_score=None)


@query
def gene_fixed_cohort(spark, sf_dir):
    """Group sizes from the phenotype table instead of from the samples with calls left."""
    phenotypes = customer_phenotypes(spark, sf_dir)
    cohort = phenotypes.where(F.col("Pathology").isin("BUILDING", "MACHINERY")).select(
        F.col("Sample_ID").alias("sample_id"), (F.col("Pathology") == "BUILDING").alias("is_case")
    )
    return ranking(spark, sf_dir, cohort=cohort)


@query
def gene_ttest(spark, sf_dir):
    return ranking(spark, sf_dir, test="ttest", burden="alleles")


@query
def gene_ttest_greater(spark, sf_dir):
    return ranking(spark, sf_dir, test="ttest", burden="variants", t_tail="greater", top_k=None)


@query
def gene_count_difference(spark, sf_dir):
    return count_difference(order_calls(spark, sf_dir), CASE, CONTROL)


@query
def variant_monogenic(spark, sf_dir):
    return ranking(spark, sf_dir, scale="variant")


@query
def variant_monogenic_all(spark, sf_dir):
    return ranking(spark, sf_dir, ALL_CASE, ALL_CONTROL, scale="variant", top_k=None)


@query
def variant_case_exclusive(spark, sf_dir):
    return case_exclusive_variants(order_calls(spark, sf_dir), CASE, CONTROL)


@query
def gene_digenic(spark, sf_dir):
    return ranking(spark, sf_dir, scope="digenic")


@query
def gene_digenic_dense(spark, sf_dir):
    return ranking(spark, sf_dir, ALL_CASE, ALL_CONTROL, scope="digenic", top_k=None)


@query
def variant_digenic(spark, sf_dir):
    return ranking(spark, sf_dir, scope="digenic", scale="variant")


@query
def variant_digenic_dense(spark, sf_dir):
    return ranking(spark, sf_dir, ALL_CASE, ALL_CONTROL, scope="digenic", scale="variant")


@query
def gene_digenic_unknown(spark, sf_dir):
    """Pairs where some calls have no gene and others an empty one."""
    gene = F.col("gene_symbol")
    blanked = F.when(gene.startswith("Brand#1"), F.lit("")).when(~gene.startswith("Brand#2"), gene)
    calls = order_calls(spark, sf_dir).withColumn("gene_symbol", blanked)
    spec = AnalysisSpec("unknown", ALL_CASE, ALL_CONTROL, scope="digenic", min_score=None, top_k=None)
    return rounded(score(calls, spec))


@query
def variant_exclusive_overlap(spark, sf_dir):
    """Samples in both groups are left out."""
    return case_exclusive_variants(order_calls(spark, sf_dir), HIGH, LOW, on_overlap="exclude")


@query
def gene_difference_overlap(spark, sf_dir):
    calls = order_calls(spark, sf_dir)
    return count_difference(calls, HIGH, LOW, top_k=None, min_score=-1000, on_overlap="exclude")


@query
def ntests(spark, sf_dir):
    spec = AnalysisSpec("tests", CASE, CONTROL)
    return number_of_tests(order_calls(spark, sf_dir), spec)


@query
def ranked_positions(spark, sf_dir):
    """Positions in an uncut ranking of whole groups."""
    spec = AnalysisSpec("ranked", ALL_CASE, ALL_CONTROL, min_score=None, top_k=None)
    ranks = with_rank(score(order_calls(spark, sf_dir), spec), "gene_symbol")
    return ranks.select("rank", "gene_symbol", "score")


# --- steps of scoring ---------------------------------------------------------------------------


def tagged(spark, sf_dir, case=CASE, control=CONTROL) -> DataFrame:
    return cohorts.tag_groups(order_calls(spark, sf_dir), case, control)


def sizes_of(rows: DataFrame) -> Column:
    sizes = cohorts.group_sizes(cohorts.sample_roles(rows))
    return sizes.select(F.struct("n_case", "n_control")).scalar()


@query
def unique_calls(spark, sf_dir):
    return cohorts.unique_calls(tagged(spark, sf_dir))


@query
def variant_frequency(spark, sf_dir):
    rows = cohorts.unique_calls(tagged(spark, sf_dir, ALL_CASE, ALL_CONTROL))
    return frequency.variant_frequencies(rows, sizes_of(rows))


@query
def variant_frequency_filter(spark, sf_dir):
    rows = cohorts.unique_calls(tagged(spark, sf_dir, ALL_CASE, ALL_CONTROL))
    frequencies = frequency.variant_frequencies(rows, sizes_of(rows))
    kept = frequency.drop_frequent(rows, frequencies, 0.01, 0.01)
    return kept.groupBy("variant_id", "gene_symbol").agg(F.count("*").alias("n_carriers"))


@query
def burden_variants(spark, sf_dir):
    return burden.gene_burden(cohorts.unique_calls(tagged(spark, sf_dir)), "variants")


@query
def burden_alleles(spark, sf_dir):
    return burden.gene_burden(cohorts.unique_calls(tagged(spark, sf_dir)), "alleles")


@query
def gene_carriers(spark, sf_dir):
    carrying = burden.carriers(tagged(spark, sf_dir, ALL_CASE, ALL_CONTROL), "gene_symbol")
    return burden.carrier_counts(carrying, "gene_symbol")


@query
def recurrent_blacklist(spark, sf_dir):
    calls = order_calls(spark, sf_dir)
    listed = frequency.recurrent_variants(calls, more_than=12)
    return by_gene(frequency.drop_variants(calls, listed))


@query
def recurrent_one_scan(spark, sf_dir):
    """The same from one scan and one shuffle of the calls."""
    calls = order_calls(spark, sf_dir).select(*SCORING_FIELDS, "filters")
    return by_gene(frequency.drop_recurrent(calls, more_than=12))


@query
def position_counts(spark, sf_dir):
    return frequency.position_counts(order_calls(spark, sf_dir))


@query
def case_control_counts(spark, sf_dir):
    calls = order_calls(spark, sf_dir)
    return drilldown.case_control_counts(calls, CASE, CONTROL, keys.variant_id(), "variant_id")


# --- samples and groups -------------------------------------------------------------------------


@query
def sample_ids(spark, sf_dir):
    return cohorts.sample_ids(filters.apply_predicate(order_calls(spark, sf_dir), CASE))


@query
def sample_overlap(spark, sf_dir):
    calls = order_calls(spark, sf_dir)
    return cohorts.overlapping_samples(calls.where(HIGH), calls.where(LOW))


@query
def group_sizes(spark, sf_dir):
    return cohorts.group_sizes(cohorts.sample_roles(tagged(spark, sf_dir)))


@query
def sample_list_text(spark, sf_dir):
    phenotypes = customer_phenotypes(spark, sf_dir)
    return cohorts.sample_list_text(phenotypes, ["Pathology"], "Sample_ID", max_bytes=900)


@query
def stacked_groups(spark, sf_dir):
    calls = order_calls(spark, sf_dir)
    stacked = cohorts.stack_groups(
        filters.apply_predicate(calls, CONTROL), filters.apply_predicate(calls, CASE)
    )
    return stacked.groupBy("is_case", "gene_symbol").agg(F.count("*").alias("n_calls"))


@query
def labelled_samples(spark, sf_dir):
    samples = customer_phenotypes(spark, sf_dir).select(
        F.col("Sample_ID").alias("sample_id"), (F.col("Gender") == "F").alias("is_case")
    )
    labelled = cohorts.label_samples(order_calls(spark, sf_dir), samples)
    return labelled.groupBy("is_case", "snpeff_impact").agg(F.count("*").alias("n_calls"))


# --- phenotypes ---------------------------------------------------------------------------------


@query
def phenotype_filter(spark, sf_dir):
    predicate = (
        "Data_Source = 'EUROPE' AND ( Pathology = 'BUILDING' OR Pathology = 'FURNITURE' )"
        " AND Sample_ID != '17'"
    )
    path = new_folder(spark, "phenotypes")
    customer_phenotypes(spark, sf_dir).write.parquet(path)
    return phenotype_io.read_phenotypes(spark, path, predicate)


@query
def phenotype_ingest(spark, sf_dir):
    """Records as an interface delivers them: other field names, two sources to leave out."""
    fields = ["source", "sample", "disease", "sex", "population"]
    source = F.when(F.col("Data_Source") == "ASIA", "UZ Brussel").otherwise(
        F.when(F.col("Data_Source") == "AFRICA", "").otherwise(F.col("Data_Source"))
    )
    raw = customer_phenotypes(spark, sf_dir).withColumn("Data_Source", source).toDF(*fields)
    json_path, path = new_folder(spark, "phenotype-json"), new_folder(spark, "phenotypes")
    raw.write.json(json_path)
    phenotype_io.ingest_phenotypes(spark, json_path, fields, path)
    return phenotype_io.read_phenotypes(spark, path)


@query
def phenotype_to_calls(spark, sf_dir):
    calls = cohorts.calls_of_phenotype(
        order_calls(spark, sf_dir),
        customer_phenotypes(spark, sf_dir),
        "Data_Source = 'ASIA' AND Pathology = 'MACHINERY'",
    )
    return by_gene(calls)


@query
def preview_unordered(spark, sf_dir):
    """A preview that is not sorted and holds all rows of the group."""
    rows = b.browse(order_calls(spark, sf_dir), ALL_CASE, max_rows=None, ordered=False)
    return rows.groupBy("gene_symbol").agg(F.count("*").alias("n_calls"), F.sum("pos").alias("pos"))


@query
def facet_values(spark, sf_dir):
    fields = ["Data_Source", "Pathology", "Gender", "Super_Population"]
    return b.facets(customer_phenotypes(spark, sf_dir), fields)


@query
def demo_cohort(spark, sf_dir):
    return phenotype_io.first_per_population(
        customer_phenotypes(spark, sf_dir), "EUROPE", ["NATION_3", "NATION_8"], 25
    )


@query
def blanked_population(spark, sf_dir):
    phenotypes = customer_phenotypes(spark, sf_dir)
    return filters.blank_where(
        phenotypes, "Super_Population", F.col("Data_Source") == "AMERICA"
    )


# --- browsing and filters -----------------------------------------------------------------------


@query
def browse_variants(spark, sf_dir):
    return b.browse(order_calls(spark, sf_dir), CASE)


@query
def browse_columns(spark, sf_dir):
    names = {"sample_id": "Sample", "gene_symbol": "Gene", "pos": "Position", "zygosity": "Dose"}
    return b.browse(order_calls(spark, sf_dir), CASE, names, max_rows=None)


@query
def browse_count(spark, sf_dir):
    return b.count_rows(order_calls(spark, sf_dir), CASE)


@query
def browse_blank_nulls(spark, sf_dir):
    shown = ["sample_id", "pos", "genotype_quality", "snpeff_effect", "read_depth"]
    rows = b.browse(order_calls(spark, sf_dir), CASE, shown, max_rows=None)
    return display.blank_nulls(rows)


@query
def scoring_columns(spark, sf_dir):
    rows = filters.apply_predicate(order_calls(spark, sf_dir), CASE)
    return scoring_projection(rows)


@query
def empty_predicate(spark, sf_dir):
    return by_gene(filters.apply_predicate(order_calls(spark, sf_dir), ""))


@query
def filter_quality(spark, sf_dir):
    kept = filters.quality(10, 70, states=["PASS"], above_confidence=5)
    return by_gene(order_calls(spark, sf_dir).where(kept))


@query
def filter_rarity_null(spark, sf_dir):
    return by_gene(order_calls(spark, sf_dir).where(filters.rare(0.01)))


@query
def filter_rarity_strict(spark, sf_dir):
    return by_gene(order_calls(spark, sf_dir).where(filters.rare(0.01, strict=True)))


@query
def filter_impact(spark, sf_dir):
    return by_gene(order_calls(spark, sf_dir).where(filters.impact("HIGH")))


@query
def filter_effect(spark, sf_dir):
    return by_gene(order_calls(spark, sf_dir).where(filters.effect_not("R", "X")))


@query
def filter_states(spark, sf_dir):
    kept = filters.filter_states(["PASS", "my_indel_filter"])
    return by_gene(order_calls(spark, sf_dir).where(kept))


@query
def filter_gene_panel(spark, sf_dir):
    return by_gene(order_calls(spark, sf_dir).where(filters.in_genes(PANEL)))


@query
def filter_gene_file(spark, sf_dir):
    """The genes of small parts, stored as a text file with one symbol per line."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size <= 5")
    path = new_folder(spark, "genes")
    part.select(F.concat_ws("/", "p_brand", "p_type").alias("value")).write.text(path)
    genes = call_io.read_gene_list(spark, path)
    return by_gene(filters.keep_listed(order_calls(spark, sf_dir), genes, "gene_symbol"))


@query
def filter_sample_list(spark, sf_dir):
    return by_gene(order_calls(spark, sf_dir).where(filters.samples_in("1,4,7, 10 ,13,16")))


@query
def inlist_normalised(spark, sf_dir):
    return scoring_projection(filters.apply_predicate(order_calls(spark, sf_dir), SAMPLE_TEXT))


@query
def exact_variant(spark, sf_dir):
    wanted = filters.exact_variant("chr5", 26, "G", "T")
    return scoring_projection(order_calls(spark, sf_dir).where(wanted))


@query
def numeric_range(spark, sf_dir):
    return by_gene(order_calls(spark, sf_dir).where(filters.id_range("read_depth", 20, 30)))


@query
def pivot_impact_by_group(spark, sf_dir):
    levels = ["HIGH", "MODERATE", "LOW", "MODIFIER"]
    rows = order_calls(spark, sf_dir)
    return b.pivot(rows, ["pathology"], "snpeff_impact", F.count(F.lit(1)), levels)


@query
def cross_totals(spark, sf_dir):
    """Depths by group and filter state against impact, with all margins."""
    depth = F.col("read_depth")
    return b.cross_table(
        order_calls(spark, sf_dir),
        ["pathology", "filters"],
        "snpeff_impact",
        ["HIGH", "MODERATE", "LOW"],
        lambda where: F.sum(F.when(where, depth)),
    )


@query
def pivot_totals(spark, sf_dir):
    rows = order_calls(spark, sf_dir)
    return b.totals(rows, ["pathology", "filters"], F.sum("read_depth").alias("depth"))


# --- keys and display ---------------------------------------------------------------------------


@query
def variant_key(spark, sf_dir):
    keyed = order_calls(spark, sf_dir).select(
        keys.variant_id().alias("variant_id"), "gene_symbol"
    )
    return keyed.groupBy("variant_id", "gene_symbol").agg(F.count("*").alias("n_calls"))


@query
def variant_key_split(spark, sf_dir):
    ids = order_calls(spark, sf_dir).select(keys.variant_id().alias("variant_id")).distinct()
    return keys.split_variant_id(ids)


@query
def genotype_dose(spark, sf_dir):
    """Both codings, with unknown zygosity among them."""
    calls = order_calls(spark, sf_dir)
    number = calls.withColumn("zygosity", F.nullif(F.col("zygosity"), F.lit(1)))
    words = F.when(calls["zygosity"] == 1, "Heterozygous").when(F.col("read_depth") > 25, "Homozygous")
    text = calls.withColumn("zygosity", words)

    def counted(df: DataFrame, coding: str) -> DataFrame:
        dose = keys.genotype_dose(df)
        return (
            df.select("zygosity", dose.alias("dose"), keys.carrier(dose).alias("carrier"))
            .groupBy(F.col("zygosity").cast("string").alias("zygosity"), "dose", "carrier")
            .agg(F.count("*").alias("n_calls"))
            .withColumn("coding", F.lit(coding))
        )

    return counted(number, "number").unionByName(counted(text, "text"))


@query
def pair_keys(spark, sf_dir):
    """Chromosome pairs of consecutive line items of an order, either way round."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"))
    two = line.select(
        "l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b")
    )
    low, high = keys.pair_key("a", "b")
    pairs = one.join(two, ["l_orderkey", "l_linenumber"])
    return pairs.groupBy(low.alias("low"), high.alias("high")).agg(F.count("*").alias("n"))


@query
def display_format(spark, sf_dir):
    spec = AnalysisSpec("display", CASE, CONTROL)
    ranked = rounded(score(order_calls(spark, sf_dir), spec))
    return display.results_table(ranked).withColumn(
        "Short_Link", display.shorten(F.col("Gene_Symbol"))
    )


@query
def display_variants(spark, sf_dir):
    spec = AnalysisSpec("display", CASE, CONTROL, scale="variant", top_k=100)
    ranked = rounded(score(order_calls(spark, sf_dir), spec))
    return display.results_table(ranked, links=False)


@query
def local_times(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    hour = 3600 * F.pmod("o_orderkey", F.lit(24))
    seconds = F.unix_timestamp("o_orderdate") + hour
    return orders.select("o_orderkey", display.local_time(seconds).alias("local_time"))


# --- drill-down ---------------------------------------------------------------------------------


@query
def drilldown_gene(spark, sf_dir):
    return drilldown.drill_down(
        order_calls(spark, sf_dir), CASE, CONTROL, ["Brand#12/SMALL"], "building", "machinery"
    )


@query
def drilldown_pair(spark, sf_dir):
    genes = ["Brand#12/SMALL", "Brand#21/LARGE"]
    return drilldown.drill_down(
        order_calls(spark, sf_dir), CASE, CONTROL, genes, "building", "machinery"
    )


@query
def drilldown_variant(spark, sf_dir):
    wanted = filters.exact_variant("chr5", 26, "G", "T")
    return drilldown.drill_down(
        order_calls(spark, sf_dir), ALL_CASE, ALL_CONTROL, wanted, "building", "machinery"
    )


@query
def drilldown_saved_groups(spark, sf_dir):
    """By the names of two saved groups, as a results explorer does it."""
    return group_io.drill_down_groups(
        order_calls(spark, sf_dir),
        saved_groups(spark),
        "building_rare",
        "machinery_rare",
        ["Brand#12/SMALL"],
    )


@query
def drilldown_ranking(spark, sf_dir):
    """The calls behind the ten best genes."""
    calls = order_calls(spark, sf_dir)
    best = score(calls, AnalysisSpec("best", CASE, CONTROL, top_k=10))
    return drilldown.drill_down(
        calls, CASE, CONTROL, drilldown.ranked_genes(best), "building", "machinery"
    )


@query
def annotate_lookup(spark, sf_dir):
    calls = order_calls(spark, sf_dir)
    known = (
        calls.where("consensus_maf IS NOT NULL")
        .groupBy(keys.variant_id().alias("variant_id"))
        .agg(F.max("consensus_maf").alias("max_maf"), F.min("dbsnp_id").alias("dbsnp_id"))
    )
    listed = case_exclusive_variants(calls, CASE, CONTROL)
    return b.annotate(listed, known)


# --- sources and sinks --------------------------------------------------------------------------


@query
def calls_parquet(spark, sf_dir):
    path = new_folder(spark, "calls")
    call_io.write_calls(order_calls(spark, sf_dir), path)
    return by_gene(call_io.read_calls(spark, path))


@query
def calls_bucketed(spark, sf_dir):
    """A ranking over a call table that is laid out by gene and sample."""
    name = f"calls_{uuid.uuid4().hex}"
    calls = order_calls(spark, sf_dir)
    call_io.write_calls_table(calls, name, new_folder(spark, "bucketed"), 8)
    spec = AnalysisSpec("bucketed", ALL_CASE, ALL_CONTROL, case_max_freq=0.005, control_max_freq=0.005)
    return rounded(score(call_io.read_calls_table(spark, name), spec))


@query
def calls_csv(spark, sf_dir):
    path = new_folder(spark, "calls-csv")
    synthetic.write_synthetic_csv(scoring_projection(order_calls(spark, sf_dir)), path)
    return by_gene(call_io.read_calls_csv(spark, path, partitions=16))


@query
def calls_sql_view(spark, sf_dir):
    call_io.register(order_calls(spark, sf_dir), "burdenlens_variants")
    calls = call_io.read_calls_table(spark, "burdenlens_variants")
    counted = spark.sql(
        "SELECT filters, count(*) AS n_sql FROM burdenlens_variants GROUP BY filters"
    )
    return calls.groupBy("filters").agg(F.count("*").alias("n_table")).join(counted, "filters")


@query
def column_generations(spark, sf_dir):
    """The same calls under the names of the two earlier table generations."""
    calls = order_calls(spark, sf_dir)
    first = calls.select(
        F.col("sample_id").alias("Patient"),
        "chr",
        "pos",
        F.col("ref").alias("Reference"),
        F.col("alt").alias("alternative"),
        "gene_symbol",
        "zygosity",
    )
    third = calls.select(
        "sample_id",
        "chr",
        F.col("pos").alias("position"),
        F.col("ref").alias("reference"),
        F.col("alt").alias("alternative"),
        "gene_ensembl",
        "zygosity",
    )
    both = by_gene(scoring_projection(canonical_calls(first))).unionByName(
        by_gene(scoring_projection(canonical_calls(third)))
    )
    return both


@query
def group_store(spark, sf_dir):
    """Create a store, save three groups, delete one, and count the calls of each that is left."""
    path = new_folder(spark, "groups")
    group_io.create_store(spark, path)
    group_io.save_groups(spark, path, spark.createDataFrame(SAVED, "Name string, SQL string"))
    group_io.delete_groups(spark, path, ["machinery_rare"])
    groups = group_io.load_groups(spark, path)
    calls = order_calls(spark, sf_dir)
    out = None
    for name in ("All", "building_rare", "samples"):
        rows = group_io.rows_of_group(calls, groups, name)
        one = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n_calls"))
        out = one if out is None else out.unionByName(one)
    return out


def saved_groups(spark) -> DataFrame:
    path = new_folder(spark, "groups")
    group_io.create_store(spark, path)
    group_io.save_groups(spark, path, spark.createDataFrame(SAVED, "Name string, SQL string"))
    return group_io.load_groups(spark, path)


@query
def saved_group_ranking(spark, sf_dir):
    """The analysis of two saved groups."""
    spec = group_io.analysis_of_groups(
        saved_groups(spark), "saved", "building_rare", "machinery_rare"
    )
    return rounded(score(order_calls(spark, sf_dir), spec))


@query
def results_roundtrip(spark, sf_dir):
    calls = order_calls(spark, sf_dir)
    spec = AnalysisSpec("saved", CASE, CONTROL, case_name="building", control_name="machinery")
    path = new_folder(spark, "analysis")
    results.run_analysis(calls, spec, path)
    analysis, scores, listed = results.read_analysis(spark, path)
    about = F.struct("analysis_name", "case_name", "control_name", "n_results")
    counts = F.struct(
        F.count_if("is_case").alias("listed_case"),
        F.count_if(~F.col("is_case")).alias("listed_control"),
    )
    saved = rounded(scores).withColumns(
        {"about": analysis.select(about).scalar(), "listed": listed.agg(counts).scalar()}
    )
    return saved.select("*", "about.*", "listed.*").drop("about", "listed")


@query
def results_empty(spark, sf_dir):
    """What is known of an analysis in which no gene scores high enough."""
    calls, path = order_calls(spark, sf_dir), new_folder(spark, "empty")
    spec = AnalysisSpec("empty", ALL_CASE, ALL_CONTROL, min_score=2.0)
    results.run_analysis(calls, spec, path)
    analysis, _, listed = results.read_analysis(spark, path)
    listed_count = listed.agg(F.count("*")).scalar().alias("n_listed")
    return analysis.select("n_case", "n_control", "ntests", "n_results", listed_count)


def saved_documents(spark, sf_dir) -> DataFrame:
    calls = order_calls(spark, sf_dir)
    folder = new_folder(spark, "documents")
    names = {"case_name": "building", "control_name": "machinery"}
    for spec in (
        AnalysisSpec("genes", CASE, CONTROL, **names),
        AnalysisSpec("pairs", CASE, CONTROL, scope="digenic", **names),
        AnalysisSpec("variants", ALL_CASE, ALL_CONTROL, scale="variant", top_k=None, **names),
    ):
        rows = group_rows(calls, spec)
        document = results.document_lines(
            score(calls, spec, rows),
            results.analysed_samples(calls, spec, rows),
            results.analysis_totals(calls, spec, rows),
            spec,
            1.5e9,
            1.5e9 + 12.344,
        )
        results.write_document(document, f"{folder}/{spec.name}")
    return results.read_lines(spark, f"{folder}/*")


@query
def document_scores(spark, sf_dir):
    scores = results.line_scores(saved_documents(spark, sf_dir))
    by_t = F.col("file_name") == "variants"
    shown = F.when(by_t, F.round("pvalue", 6)).otherwise(digits(F.col("pvalue")))
    return scores.withColumn("pvalue", shown)


@query
def document_headers(spark, sf_dir):
    headers = results.line_analyses(saved_documents(spark, sf_dir))
    return headers.select(
        "file_name", "analysis_name", "scale", "scope", "run_time", "n_case", "n_control", "control_name",
        "case_name", "ntests", "n_results",
        F.unix_timestamp("start_time").alias("start_epoch"),
        F.unix_timestamp("end_time").alias("end_epoch"),
        "start_local",
    )


@query
def document_samples(spark, sf_dir):
    """The samples listed in stored documents."""
    return results.line_samples(saved_documents(spark, sf_dir))


@query
def analysis_catalog(spark, sf_dir):
    """Names of the stored analyses, with the size of the ranking each was saved with."""
    calls = order_calls(spark, sf_dir)
    folder = new_folder(spark, "catalogue")
    for name, least in (("first", 0.0), ("second", -1.0)):
        spec = AnalysisSpec(name, ALL_CASE, ALL_CONTROL, top_k=None, min_score=least)
        rows = group_rows(calls, spec)
        ranked = score(calls, spec, rows)
        samples = results.analysed_samples(calls, spec, rows)
        totals = results.analysis_totals(calls, spec, rows)
        document = results.document_lines(ranked, samples, totals, spec, 0.0, 1.0)
        results.write_document(document, f"{folder}/{name}")
    names = results.list_documents(spark, f"{folder}/*")
    sizes = results.line_analyses(results.read_lines(spark, f"{folder}/*"))
    return names.join(sizes.select("file_name", "n_results"), "file_name")


@query
def export_csv(spark, sf_dir):
    path = new_folder(spark, "export")
    results.export_csv(customer_phenotypes(spark, sf_dir), path)
    return spark.read.option("header", True).csv(path)


@query
def export_scores(spark, sf_dir):
    spec = AnalysisSpec("export", CASE, CONTROL)
    csv, json = new_folder(spark, "scores-csv"), new_folder(spark, "scores-json")
    ranked = rounded(score(order_calls(spark, sf_dir), spec)).select("gene_symbol", "score", "pvalue")
    results.export_csv(ranked, csv, quote_all=False)
    results.write_scores_json(spark.read.option("header", True).schema(ranked.schema).csv(csv), json)
    return spark.read.schema(ranked.schema).json(json)


@query
def synthetic_table(spark, sf_dir):
    samples = customer_phenotypes(spark, sf_dir).select(F.col("Sample_ID").alias("sample_id"))
    calls = synthetic.synthetic_calls(samples, variants_per_gene=4, genes=5)
    return calls.groupBy("gene_symbol", "chr", "pos", "ref", "alt").agg(
        F.count("*").alias("n_calls"),
        F.min("zygosity").alias("min_dose"),
        F.max("zygosity").alias("max_dose"),
    )


@query
def chosen_columns(spark, sf_dir):
    names = {"Sample_ID": "Sample ID", "Pathology": "Pathology", "Super_Population": "Super population"}
    return choose_columns(customer_phenotypes(spark, sf_dir), names)
