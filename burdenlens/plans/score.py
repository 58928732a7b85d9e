"""Scoring: rank genes, variants or pairs of them by how they separate cases from controls.

A ranking of genes or variants is one lazy DataFrame plan. Group sizes and test counts are scalar
subqueries over the same de-duplicated rows as the scores, so Spark scans and shuffles the calls
once for all of them. A ranking of pairs reads its rows several times more and stores them first,
see :mod:`burdenlens.workspace`. P-values are computed after the ranking is cut: they do not decide
the order, and only the rows that are returned need one.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from burdenlens.functions import stats
from burdenlens.operators import burden, cohorts, frequency, pairs
from burdenlens.plans.spec import AnalysisSpec
from burdenlens.workspace import in_ranges, stored


def group_rows(calls: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """The rows of both groups, one per call, as a stored table.

    For an analysis of which more than the ranking is asked: :func:`score`, :func:`analysed_samples` and
    :func:`analysis_totals` take it as ``rows``, and the calls are read and shuffled once for all three.
    """
    return stored(_unique(_tagged(calls, spec), spec), "calls")


def score(calls: DataFrame, spec: AnalysisSpec, rows: DataFrame | None = None) -> DataFrame:
    """The ranking of an analysis.

    Columns: the key columns, ``score, pvalue, ratio_case, ratio_control, sum_case, sum_control,
    n_case, n_control, ntests`` and, for pairs, ``npairs``; best score first, ties by key. ``rows`` is
    what :func:`group_rows` stored of the calls.
    """
    rows, sizes = _prepare(calls, spec, rows)
    known = None
    if spec.scope == "digenic":
        known = _known(rows, sizes, spec)
        sizes = F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in known[0].asDict().items()])
    counted, tests = _count(rows, sizes, spec, known)
    tested = _with_pvalue(_rank(counted, sizes, spec), spec)
    return tested.select(
        *spec.key_columns,
        "score",
        "pvalue",
        "ratio_case",
        "ratio_control",
        "sum_case",
        "sum_control",
        "n_case",
        "n_control",
        *[column.alias(name) for name, column in tests.items()],
    )


def _limited(spec: AnalysisSpec) -> bool:
    return frequency.filters_anything(
        spec.case_max_freq, spec.control_max_freq, spec.strict_freq
    )


def _tagged(calls: DataFrame, spec: AnalysisSpec) -> DataFrame:
    if spec.cohort is None:
        return cohorts.tag_groups(calls, spec.case, spec.control)
    return cohorts.tag_by_list(calls, spec.case, spec.control, spec.cohort)


def _unique(tagged: DataFrame, spec: AnalysisSpec) -> DataFrame:
    return tagged if spec.deduplicated else cohorts.unique_calls(tagged)


def _roles(
    calls: DataFrame, spec: AnalysisSpec, rows: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of the groups, one per call, and the groups of every sample."""
    if rows is None:
        tagged = _tagged(calls, spec)
        if spec.scale == "gene" and spec.effective_test == "fisher" and not _limited(spec) and not spec.deduplicated:
            rows = burden.carriers(tagged, "gene_symbol")  # variants do not matter at all
        else:
            rows = _unique(tagged, spec)
        if spec.scope == "digenic":
            rows = stored(rows, "calls")
    if spec.cohort is None:
        return rows, cohorts.sample_roles(rows)
    listed = spec.cohort.where("sample_id IS NOT NULL").groupBy("sample_id")
    return rows, listed.agg(
        F.bool_or("is_case").alias("in_case"), F.bool_or(~F.col("is_case")).alias("in_control")
    )


def _prepare(
    calls: DataFrame, spec: AnalysisSpec, rows: DataFrame | None = None
) -> tuple[DataFrame, Column]:
    """Rows to score, and the group sizes as a scalar struct."""
    rows, roles = _roles(calls, spec, rows)
    sizes = cohorts.group_sizes(roles, spec.on_overlap)
    if spec.on_overlap == "exclude":
        rows = cohorts.drop_overlap(rows, roles)
    return rows, sizes.select(F.struct("n_case", "n_control")).scalar()


def analysed_samples(
    calls: DataFrame, spec: AnalysisSpec, rows: DataFrame | None = None
) -> DataFrame:
    """The samples behind an analysis, as its group sizes count them: ``sample_id, is_case``.

    A sample in both groups is in neither with ``on_overlap='exclude'`` and fails otherwise.
    """
    _, roles = _roles(calls, replace(spec, scope="monogenic"), rows)
    both = F.col("in_case") & F.col("in_control")
    if spec.on_overlap == "raise":
        failed = F.raise_error(F.lit(cohorts.OVERLAP_MESSAGE)).cast("boolean")
        both = F.when(both, failed).otherwise(F.lit(False))
    counted = roles.where((F.col("in_case") | F.col("in_control")) & ~both)
    return counted.select("sample_id", F.col("in_case").alias("is_case"))


def analysis_totals(
    calls: DataFrame, spec: AnalysisSpec, rows: DataFrame | None = None
) -> DataFrame:
    """One row, also where nothing is ranked: ``n_case, n_control, ntests`` of an analysis."""
    tests = number_of_tests(calls, spec, rows)
    names = {
        ("monogenic", "gene"): "tests_gene",
        ("monogenic", "variant"): "tests_variant",
        ("digenic", "gene"): "tests_gene_pair",
        ("digenic", "variant"): "tests_variant_pair",
    }
    return tests.select("n_case", "n_control", F.col(names[spec.scope, spec.scale]).alias("ntests"))


def _paired_item(spec: AnalysisSpec) -> str:
    return "gene_symbol" if spec.scale == "gene" else "variant_id"


def _known(rows: DataFrame, sizes: Column, spec: AnalysisSpec) -> tuple[Row, Column]:
    """Group sizes and number of items of a pair ranking, looked up now: its rows are stored and cheap
    to read, and values keep its plan small."""
    items = _distinct_count(rows, _paired_item(spec)).scalar()
    group, n = rows.sparkSession.range(1).select(sizes, items).head()
    return group, F.lit(n).cast("bigint")


def _count(
    rows: DataFrame, sizes: Column, spec: AnalysisSpec, known: tuple[Row, Column] | None
) -> tuple[DataFrame, dict[str, Column]]:
    """Totals per ranked item and group, of the variants within the frequency limits; and the
    number of tests, which counts the items before any limit."""
    limits = (spec.case_max_freq, spec.control_max_freq, spec.strict_freq)
    if (spec.scope, spec.scale) == ("monogenic", "variant"):
        counted = _count_variants(rows, spec)
        tests = {"ntests": counted.agg(F.count("*")).scalar()}
        if _limited(spec):
            names = ("n_carriers_case", "n_carriers_control")
            shares = frequency.with_ratios(counted, sizes, *names)
            counted = shares.where(~frequency.too_frequent(*limits)).select(*counted.columns)
        return counted, tests
    kept = rows
    if _limited(spec):
        frequencies = frequency.variant_frequencies(rows, sizes)
        kept = frequency.drop_frequent(rows, frequencies, *limits)
    if spec.scope == "digenic":
        item = _paired_item(spec)
        one, two = spec.key_columns
        if spec.scale == "variant":
            one, two = two, one  # pairs come larger first; variant pairs are reported smaller first
        tests = {"ntests": pairs.pair_tests(known[1]), "npairs": pairs.pair_count(known[1])}
        carrying = stored(burden.carriers(kept, item), "carriers")
        extent = pairs.measure(carrying, item)
        cores = rows.sparkSession.sparkContext.defaultParallelism
        if spec.top_k is not None and extent.to_form * 8 > pairs.FEW * cores:
            n_case, n_control = known[0]
            best = pairs.best_pairs(
                carrying, item, one, two, n_case, n_control, spec.top_k, spec.effective_min_score
            )
            if best is not None:
                return best, tests
        return pairs.shared_carriers(carrying, item, one, two, extent=extent), tests
    if spec.effective_test == "ttest":
        burdens = burden.gene_burden(kept, spec.burden)
        counted = burden.value_moments(burdens, F.col("burden"), "gene_symbol")
    else:
        counted = burden.carrier_counts(burden.carriers(kept, "gene_symbol"), "gene_symbol")
    # whichever is there already: one row per gene, or per variant of all genes
    genes = _distinct_count(frequencies if _limited(spec) else counted, "gene_symbol")
    return counted, {"ntests": genes.scalar()}


def _count_variants(rows: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """A variant's frequency and its totals come from the same rows: one aggregation, no join."""
    carrying = burden.carrier_columns("n_carriers_case", "n_carriers_control")
    if spec.effective_test == "ttest":
        totals = burden.moments(F.col("dose"))
    else:
        totals = burden.carrier_columns()
    return burden.counted(rows, totals + carrying, *spec.key_columns)


def _with_score(counted: DataFrame, sizes: Column) -> DataFrame:
    return frequency.with_ratios(counted, sizes).withColumn(
        "score", F.col("ratio_case") - F.col("ratio_control")
    )


def _rank(counted: DataFrame, sizes: Column, spec: AnalysisSpec) -> DataFrame:
    scored = _with_score(counted, sizes)
    if spec.effective_min_score is not None:
        scored = scored.where(F.col("score") > spec.effective_min_score)
    if spec.top_k is None:
        return scored
    return scored.orderBy(F.desc("score"), *spec.key_columns).limit(spec.top_k)


def _with_pvalue(ranked: DataFrame, spec: AnalysisSpec) -> DataFrame:
    counts = ["sum_case", "n_case", "sum_control", "n_control"]
    if spec.effective_test == "ttest":
        counts += ["sumsq_case", "sumsq_control"]
        tail = stats.t_halved if spec.t_tail == "halved" else stats.t_greater

        def tested(df: DataFrame) -> DataFrame:
            with_t = df.withColumn("t", stats.pooled_t())
            return with_t.withColumn("pvalue", tail("t", "n_case + n_control - 2")).drop("t")
    else:

        def tested(df: DataFrame) -> DataFrame:
            return df.withColumn(
                "pvalue", stats.fisher_greater(*counts, table=spec.fisher_table)
            )

    if spec.top_k is not None:
        return tested(ranked)
    # A test costs far more than its few bytes let adaptive execution expect, so an uncut list is
    # spread over all cores. Counts of carriers repeat a lot: each combination is tested once.
    # Moments hardly repeat and are tested where they are.
    cores = ranked.sparkSession.sparkContext.defaultParallelism
    if spec.effective_test == "ttest":
        spread = ranked.repartition(cores, *spec.key_columns)
        return tested(spread).orderBy(F.desc("score"), *spec.key_columns)
    tables = tested(ranked.select(*counts).distinct().repartition(cores, *counts))
    same = [F.col(c).eqNullSafe(F.col(f"tested_{c}")) for c in counts]
    tables = tables.withColumnsRenamed({c: f"tested_{c}" for c in counts})
    return ranked.join(tables, same, "left").orderBy(F.desc("score"), *spec.key_columns)


def _distinct_count(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys).distinct().agg(F.count("*"))


def number_of_tests(
    calls: DataFrame, spec: AnalysisSpec, rows: DataFrame | None = None
) -> DataFrame:
    """One row: group sizes and the number of tests of every mode over the same rows."""
    by_variant = replace(spec, scope="monogenic", scale="variant", test=None)
    rows, sizes = _prepare(calls, by_variant, rows)
    genes = _distinct_count(rows, "gene_symbol").scalar()
    variants = _distinct_count(rows, "variant_id", "gene_symbol").scalar()
    ids = _distinct_count(rows, "variant_id").scalar()
    return calls.sparkSession.range(1).select(
        sizes["n_case"].alias("n_case"),
        sizes["n_control"].alias("n_control"),
        genes.alias("tests_gene"),
        variants.alias("tests_variant"),
        pairs.pair_tests(genes).alias("tests_gene_pair"),
        pairs.pair_count(genes).alias("gene_pairs"),
        pairs.pair_tests(ids).alias("tests_variant_pair"),
        pairs.pair_count(ids).alias("variant_pairs"),
    )


def case_exclusive_variants(
    calls: DataFrame, case, control, top_k: int | None = None, on_overlap: str = "raise"
) -> DataFrame:
    """Variants no control carries, by number of case carriers. Samples in both groups fail or are
    left out, as in :class:`AnalysisSpec`."""
    spec = AnalysisSpec("exclusive", case, control, scale="variant", on_overlap=on_overlap)
    rows, sizes = _prepare(calls, spec)
    counted = burden.carrier_counts(rows, "variant_id", "gene_symbol")
    # reading the sizes is what makes a sample in both groups fail
    exclusive = counted.where("sum_control = 0 AND sum_case > 0").where(sizes["n_case"] >= 0)
    scored = exclusive.select(
        "variant_id", "gene_symbol", F.col("sum_case").alias("score"), "sum_case", "sum_control"
    )
    ranked = scored.orderBy(F.desc("score"), "variant_id", "gene_symbol")
    return ranked if top_k is None else ranked.limit(top_k)


def count_difference(
    calls: DataFrame,
    case,
    control,
    top_k: int | None = 1000,
    min_score: int = 1,
    on_overlap: str = "raise",
) -> DataFrame:
    """Genes by difference of carrier counts between the groups. Samples in both groups fail or are
    left out, as in :class:`AnalysisSpec`."""
    spec = AnalysisSpec(
        "difference", case, control, case_max_freq=1.0, control_max_freq=1.0, on_overlap=on_overlap
    )
    rows, sizes = _prepare(calls, spec)
    counted = burden.carrier_counts(burden.carriers(rows, "gene_symbol"), "gene_symbol")
    scored = counted.where(sizes["n_case"] >= 0).select(
        "gene_symbol",
        (F.col("sum_case") - F.col("sum_control")).alias("score"),
        "sum_case",
        "sum_control",
    ).where(F.col("score") >= min_score)
    ranked = scored.orderBy(F.desc("score"), "gene_symbol")
    return ranked if top_k is None else ranked.limit(top_k)


def with_rank(ranking: DataFrame, *keys: str, top_k: int | None = None) -> DataFrame:
    """A ranking with ``rank``, the position of each row from 1 on, in that order.

    All rows are numbered, or the best ``top_k``. The order is dealt out by range; each task numbers
    its range, and the numbers of the ranges before it are added.
    """
    order = [F.desc("score"), *keys]
    rows = ranking if top_k is None else ranking.orderBy(*order).limit(top_k)
    ranged = in_ranges(rows, order, "ranked")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    rank = F.col("start") + F.col("place") + 1
    numbered = ranged.join(starts, "part").withColumn("rank", rank)
    return numbered.drop("part", "place", "start").orderBy("rank")
