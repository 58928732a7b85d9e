"""The questions of :mod:`workload.queries` in ANSI SQL, written independently of the engine."""

from __future__ import annotations

from workload.groups import (
    ALL_CASE,
    ALL_CONTROL,
    CASE,
    CONTROL,
    HIGH,
    LOW,
    PANEL,
    SAMPLE_TEXT_EXPANDED,
)

ORACLE: dict[str, str] = {}

CALLS = """calls AS (
  SELECT cast(o_custkey AS varchar) AS sample_id,
    'chr' || cast(l_partkey % 22 + 1 AS varchar) AS chr, l_partkey AS pos,
    substr('ACGT', cast(l_partkey % 4 AS int) + 1, 1) AS ref,
    substr('CGTA', cast(l_partkey % 4 AS int) + 1, 1) AS alt,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS zygosity,
    cast(l_quantity AS int) AS read_depth, 60 + 5 * l_linenumber AS genotype_quality,
    CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'my_snp_filter'
      ELSE 'my_indel_filter' END AS filters,
    p_brand || '/' || p_type AS gene_symbol, p_type AS gene_ensembl,
    CASE WHEN l_discount = 0.05 THEN NULL ELSE l_discount END AS consensus_maf,
    nullif(l_returnflag, 'A') AS snpeff_effect,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'MODERATE'
      WHEN '3-MEDIUM' THEN 'LOW' ELSE 'MODIFIER' END AS snpeff_impact,
    'rs' || cast(l_partkey AS varchar) AS dbsnp_id, cast(p_size AS double) AS cadd_phred,
    l_tax * 100 AS variant_confidence_by_depth, c_mktsegment AS pathology
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey)"""

PHENOTYPES = """phenotypes AS (
  SELECT r_name AS "Data_Source", cast(c_custkey AS varchar) AS "Sample_ID",
    c_mktsegment AS "Pathology", CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS "Gender",
    n_name AS "Super_Population"
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

BROWSE = """sample_id, chr, pos, ref, alt, zygosity, read_depth, genotype_quality, filters,
  gene_symbol, gene_ensembl, consensus_maf, snpeff_effect, snpeff_impact, dbsnp_id, cadd_phred,
  variant_confidence_by_depth"""
SCORING = "sample_id, chr, pos, ref, alt, gene_symbol, zygosity"
ID = "chr || ':' || cast(pos AS varchar) || ':' || ref || ':' || alt"


def with_calls(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([CALLS, *ctes]) + "\n" + select


def by_gene(source: str) -> str:
    return f"""SELECT gene_symbol, count(*) AS n_calls, count(DISTINCT sample_id) AS n_samples,
  cast(sum(zygosity) AS bigint) AS sum_zygosity, cast(sum(pos) AS bigint) AS sum_pos,
  min(chr) AS first_chr, max(ref) AS last_ref, max(alt) AS last_alt
FROM {source} GROUP BY gene_symbol"""


def filtered(condition: str) -> str:
    return with_calls(by_gene("kept"), f"kept AS (SELECT * FROM calls WHERE {condition})")


# --- scoring ------------------------------------------------------------------------------------


def grouped(case: str, control: str | None) -> list[str]:
    """One row per (gene, variant, sample), and the group sizes."""
    in_control = "false" if control is None else f"coalesce({control}, false)"
    return [
        f"""tagged AS (
  SELECT {ID} AS variant_id, gene_symbol, sample_id, zygosity AS dose,
    coalesce({case}, false) AS in_case, {in_control} AS in_control
  FROM calls)""",
        """g AS (
  SELECT variant_id, gene_symbol, sample_id, max(dose) AS dose, bool_or(in_case) AS in_case,
    bool_or(in_control) AS in_control
  FROM tagged WHERE in_case OR in_control GROUP BY variant_id, gene_symbol, sample_id)""",
        """size AS (
  SELECT count(DISTINCT CASE WHEN in_case THEN sample_id END) AS n_case,
    count(DISTINCT CASE WHEN in_control THEN sample_id END) AS n_control FROM g)""",
    ]


FREQUENCY = """freq AS (
  SELECT variant_id, gene_symbol, count(CASE WHEN in_case THEN 1 END) AS sum_case,
    count(CASE WHEN in_control THEN 1 END) AS sum_control
  FROM g GROUP BY variant_id, gene_symbol),
vf AS (
  SELECT variant_id, gene_symbol, sum_case, sum_control, n_case, n_control,
    CASE WHEN n_case = 0 THEN 0 ELSE cast(sum_case AS double) / n_case END AS ratio_case,
    CASE WHEN n_control = 0 THEN 0 ELSE cast(sum_control AS double) / n_control END
      AS ratio_control
  FROM freq, size)"""


def kept(case_max: float, control_max: float, strict: bool = False) -> str:
    op = "<" if strict else "<="
    return f"""{FREQUENCY},
k AS (
  SELECT g.* FROM g JOIN vf ON g.variant_id = vf.variant_id AND g.gene_symbol = vf.gene_symbol
  WHERE vf.ratio_case {op} {case_max} AND vf.ratio_control {op} {control_max})"""


GENE_COUNTS = """counted AS (
  SELECT gene_symbol, count(DISTINCT CASE WHEN in_case THEN sample_id END) AS sum_case,
    count(DISTINCT CASE WHEN in_control THEN sample_id END) AS sum_control
  FROM k GROUP BY gene_symbol)"""


def scored(keys: str, extra: str = "") -> str:
    return f"""scored AS (
  SELECT {keys}, sum_case, sum_control, n_case, n_control{extra},
    CASE WHEN n_case = 0 THEN 0 ELSE cast(sum_case AS double) / n_case END AS ratio_case,
    CASE WHEN n_control = 0 THEN 0 ELSE cast(sum_control AS double) / n_control END
      AS ratio_control
  FROM counted, size),
ranked AS (SELECT *, ratio_case - ratio_control AS score FROM scored)"""


def fisher(r2: str = "n_control") -> str:
    def lf(n: str) -> str:
        return f"lgamma(cast({n} AS double) + 1)"

    a, r1, c = "sum_case", "n_case", "sum_control"
    m = f"({a} + {c})"
    n = f"({r1} + {r2})"
    terms = (
        f"exp({lf(r1)} - {lf('x')} - {lf(f'{r1} - x')} + {lf(r2)} - {lf(f'{m} - x')}"
        f" - {lf(f'{r2} - ({m} - x)')} - {lf(n)} + {lf(m)} + {lf(f'{n} - {m}')})"
    )
    total = f"list_sum(list_transform(range({a}, least({r1}, {m}) + 1), lambda x: {terms}))"
    return (
        f"CASE WHEN n_control > 0 THEN cast(printf('%.5e', least({total}, 1.0)) AS double) END AS pvalue"
    )


def t_statistic() -> str:
    def ss(s: str, q: str, n: str) -> str:
        return f"(cast({n} AS double) * {q} - cast({s} AS double) * {s}) / {n}"

    pooled = (
        f"({ss('sum_case', 'sumsq_case', 'n_case')}"
        f" + {ss('sum_control', 'sumsq_control', 'n_control')}) / (n_case + n_control - 2)"
    )
    return (
        f"CASE WHEN {pooled} > 0 THEN (ratio_case - ratio_control)"
        f" / sqrt({pooled} * (1.0::double / n_case + 1.0::double / n_control)) END"
    )


# Finite series of the t distribution for whole degrees of freedom.
T_INSIDE = """CASE WHEN df % 2 = 1 THEN
    2 / pi() * (theta + sin(theta) * cos(theta) * list_sum(list_transform(range(0, (df - 1) // 2),
      lambda i: sqrt(pi()) / 2 * exp(lgamma(i + 1) - lgamma(i + 1.5)) * pow(c2, i))))
  ELSE sin(theta) * list_sum(list_transform(range(0, df // 2),
      lambda i: exp(lgamma(i + 0.5) - lgamma(i + 1)) / sqrt(pi()) * pow(c2, i))) END"""


def t_tested(keys: str, tail: str, source: str = "ranked") -> str:
    p = "(1 - inside) / 2"
    value = p if tail == "halved" else f"CASE WHEN t >= 0 THEN {p} ELSE 1 - {p} END"
    return f"""with_t AS (SELECT *, {t_statistic()} AS t FROM {source}),
angle AS (
  SELECT *, n_case + n_control - 2 AS df, atan(abs(t) / sqrt(n_case + n_control - 2)) AS theta
  FROM with_t),
cosine AS (SELECT *, pow(cos(theta), 2) AS c2 FROM angle),
tail AS (SELECT *, {T_INSIDE} AS inside FROM cosine),
tested AS (
  SELECT {keys}, score, round({value}, 6) AS pvalue, ratio_case, ratio_control,
    sum_case, sum_control, n_case, n_control
  FROM tail)"""


MOMENTS = """cast(coalesce(sum(CASE WHEN in_case THEN v END), 0) AS bigint) AS sum_case,
    cast(coalesce(sum(CASE WHEN in_control THEN v END), 0) AS bigint) AS sum_control,
    cast(coalesce(sum(CASE WHEN in_case THEN v * v END), 0) AS bigint) AS sumsq_case,
    cast(coalesce(sum(CASE WHEN in_control THEN v * v END), 0) AS bigint) AS sumsq_control"""

STATS = "pvalue, ratio_case, ratio_control, sum_case, sum_control, n_case, n_control"


def gene_fisher(
    case: str = CASE,
    control: str | None = CONTROL,
    limits: tuple = (0.5, 0.5),
    strict: bool = False,
    where: str = "WHERE score > 0",
    r2: str = "n_control",
    size: str | None = None,
    drop: str | None = None,
    limit: int = 1000,
) -> str:
    ctes = grouped(case, control)
    if drop is not None:
        ctes[1:] = [ctes[1].replace("g AS (", "g0 AS (", 1), drop, ctes[2]]
    if size is not None:
        ctes[2] = size
    return with_calls(
        f"""SELECT gene_symbol, score, {fisher(r2)}, ratio_case, ratio_control, sum_case, sum_control,
  n_case, n_control, (SELECT count(DISTINCT gene_symbol) FROM g) AS ntests
FROM ranked {where} ORDER BY score DESC, gene_symbol LIMIT {limit}""",
        *ctes,
        kept(*limits, strict),
        GENE_COUNTS,
        scored("gene_symbol"),
    )


ORACLE["gene_monogenic"] = gene_fisher()
ORACLE["gene_monogenic_compat"] = gene_fisher(r2="(n_control + sum_control)")
ORACLE["gene_monogenic_rare"] = gene_fisher(ALL_CASE, ALL_CONTROL, (0.005, 0.005))
ORACLE["gene_monogenic_strict"] = gene_fisher(
    ALL_CASE, ALL_CONTROL, (0.012, 0.015), strict=True, where=""
)
ORACLE["gene_no_control"] = gene_fisher(control=None)
ORACLE["gene_overlap_excluded"] = gene_fisher(
    HIGH,
    LOW,
    where="",
    drop="""g AS (
  SELECT * FROM g0 WHERE sample_id NOT IN (
    SELECT sample_id FROM g0 GROUP BY sample_id HAVING bool_or(in_case) AND bool_or(in_control)))""",
)
ORACLE["gene_fixed_cohort"] = gene_fisher(
    size="""size AS (
  SELECT count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) AS n_case,
    count(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 END) AS n_control FROM customer)"""
)


def gene_t(value: str, tail: str, limit: str) -> str:
    return with_calls(
        f"""SELECT *, (SELECT count(DISTINCT gene_symbol) FROM g) AS ntests
FROM tested ORDER BY score DESC, gene_symbol {limit}""",
        *grouped(CASE, CONTROL),
        kept(0.5, 0.5),
        f"""per_sample AS (
  SELECT gene_symbol, sample_id, {value} AS v, bool_or(in_case) AS in_case,
    bool_or(in_control) AS in_control FROM k GROUP BY gene_symbol, sample_id)""",
        f"counted AS (SELECT gene_symbol, {MOMENTS} FROM per_sample GROUP BY gene_symbol)",
        scored("gene_symbol", ", sumsq_case, sumsq_control"),
        t_tested("gene_symbol", tail),
    )


ORACLE["gene_ttest"] = gene_t("sum(dose)", "halved", "LIMIT 1000")
ORACLE["gene_ttest_greater"] = gene_t("count(*)", "greater", "")

ORACLE["gene_count_difference"] = with_calls(
    """SELECT gene_symbol, sum_case - sum_control AS score, sum_case, sum_control
FROM counted WHERE sum_case - sum_control >= 1 ORDER BY score DESC, gene_symbol LIMIT 1000""",
    *grouped(CASE, CONTROL),
    "k AS (SELECT * FROM g)",
    GENE_COUNTS,
)


def variant_t(case: str, control: str, limit: str) -> str:
    order = f"ORDER BY score DESC, variant_id, gene_symbol {limit}"
    return with_calls(
        f"""SELECT *, (SELECT count(*) FROM (SELECT DISTINCT variant_id, gene_symbol FROM g)) AS ntests
FROM tested {order}""",
        *grouped(case, control),
        kept(0.5, 0.5),
        f"""counted AS (
  SELECT variant_id, gene_symbol, {MOMENTS} FROM (SELECT *, dose AS v FROM k)
  GROUP BY variant_id, gene_symbol)""",
        scored("variant_id, gene_symbol", ", sumsq_case, sumsq_control"),
        f"best AS (SELECT * FROM ranked {order})",
        t_tested("variant_id, gene_symbol", "halved", "best"),
    )


ORACLE["variant_monogenic"] = variant_t(CASE, CONTROL, "LIMIT 1000")
ORACLE["variant_monogenic_all"] = variant_t(ALL_CASE, ALL_CONTROL, "")

CASE_EXCLUSIVE = """exclusive AS (
  SELECT variant_id, gene_symbol, count(CASE WHEN in_case THEN 1 END) AS score,
    count(CASE WHEN in_case THEN 1 END) AS sum_case,
    count(CASE WHEN in_control THEN 1 END) AS sum_control
  FROM g GROUP BY variant_id, gene_symbol
  HAVING count(CASE WHEN in_control THEN 1 END) = 0 AND count(CASE WHEN in_case THEN 1 END) > 0)"""
ORACLE["variant_case_exclusive"] = with_calls(
    "SELECT * FROM exclusive", *grouped(CASE, CONTROL), CASE_EXCLUSIVE
)


def pairs(
    item: str, one: str, two: str, op: str, case: str, control: str, where: str, limit: str
) -> str:
    count = f"(SELECT count(DISTINCT {item}) FROM g)"
    return with_calls(
        f"""SELECT {one}, {two}, score, {fisher()}, ratio_case, ratio_control, sum_case, sum_control,
  n_case, n_control, {count} * ({count} + 1) // 2 AS ntests, {count} * ({count} - 1) // 2 AS npairs
FROM (SELECT * FROM ranked {where} ORDER BY score DESC, {one}, {two} {limit})""",
        *grouped(case, control),
        kept(0.5, 0.5),
        f"""carrying AS (
  SELECT {item} AS item, sample_id, bool_or(in_case) AS in_case, bool_or(in_control) AS in_control
  FROM k GROUP BY {item}, sample_id)""",
        f"""counted AS (
  SELECT a.item AS {one}, b.item AS {two}, count(CASE WHEN a.in_case THEN 1 END) AS sum_case,
    count(CASE WHEN a.in_control THEN 1 END) AS sum_control
  FROM carrying a JOIN carrying b ON a.sample_id = b.sample_id AND a.item {op} b.item
  GROUP BY a.item, b.item)""",
        scored(f"{one}, {two}"),
    )


GENES = ("gene_symbol", "gene_symbol1", "gene_symbol2", ">")
VARIANTS = ("variant_id", "variant_id1", "variant_id2", "<")
ORACLE["gene_digenic"] = pairs(*GENES, CASE, CONTROL, "WHERE score > 0", "LIMIT 1000")
ORACLE["gene_digenic_dense"] = pairs(*GENES, ALL_CASE, ALL_CONTROL, "WHERE score > 0", "")
ORACLE["variant_digenic"] = pairs(*VARIANTS, CASE, CONTROL, "", "LIMIT 1000")

ORACLE["variant_digenic_dense"] = pairs(*VARIANTS, ALL_CASE, ALL_CONTROL, "", "LIMIT 1000")

# '' stands for an unknown gene and ' ' for an empty name while pairs are formed
BLANKED = """CASE WHEN p_brand LIKE 'Brand#1%' THEN ' ' WHEN p_brand LIKE 'Brand#2%' THEN ''
      ELSE p_brand || '/' || p_type END AS gene_symbol"""
BLANKED_PAIRS = pairs(*GENES, ALL_CASE, ALL_CONTROL, "", "").replace(
    "p_brand || '/' || p_type AS gene_symbol", BLANKED
)
ORACLE["gene_digenic_unknown"] = f"""SELECT * REPLACE (
  CASE gene_symbol1 WHEN ' ' THEN '' WHEN '' THEN NULL ELSE gene_symbol1 END AS gene_symbol1,
  CASE gene_symbol2 WHEN ' ' THEN '' WHEN '' THEN NULL ELSE gene_symbol2 END AS gene_symbol2)
FROM ({BLANKED_PAIRS})"""


def without_overlap(case: str, control: str) -> list[str]:
    tagged_, rows, size = grouped(case, control)
    return [
        tagged_,
        rows.replace("g AS (", "g0 AS (", 1),
        """g AS (SELECT * FROM g0 WHERE sample_id NOT IN (
    SELECT sample_id FROM g0 GROUP BY sample_id HAVING bool_or(in_case) AND bool_or(in_control)))""",
        size,
    ]


ORACLE["variant_exclusive_overlap"] = with_calls(
    "SELECT * FROM exclusive", *without_overlap(HIGH, LOW), CASE_EXCLUSIVE
)
ORACLE["gene_difference_overlap"] = with_calls(
    """SELECT gene_symbol, sum_case - sum_control AS score, sum_case, sum_control FROM counted
WHERE sum_case - sum_control >= -1000""",
    *without_overlap(HIGH, LOW),
    "k AS (SELECT * FROM g)",
    GENE_COUNTS,
)

ORACLE["ntests"] = with_calls(
    """SELECT n_case, n_control, genes AS tests_gene, variants AS tests_variant,
  genes * (genes + 1) // 2 AS tests_gene_pair, genes * (genes - 1) // 2 AS gene_pairs,
  ids * (ids + 1) // 2 AS tests_variant_pair, ids * (ids - 1) // 2 AS variant_pairs
FROM size, (SELECT count(DISTINCT gene_symbol) AS genes, count(DISTINCT variant_id) AS ids FROM g),
  (SELECT count(*) AS variants FROM (SELECT DISTINCT variant_id, gene_symbol FROM g))""",
    *grouped(CASE, CONTROL),
)

TOP_GENES = [*grouped(CASE, CONTROL), kept(0.5, 0.5), GENE_COUNTS, scored("gene_symbol")]
ORACLE["ranked_positions"] = with_calls(
    """SELECT row_number() OVER (ORDER BY score DESC, gene_symbol) AS rank, gene_symbol, score
FROM ranked""",
    *grouped(ALL_CASE, ALL_CONTROL),
    kept(0.5, 0.5),
    GENE_COUNTS,
    scored("gene_symbol"),
)

# --- steps of scoring ---------------------------------------------------------------------------

ORACLE["unique_calls"] = with_calls(
    "SELECT gene_symbol, variant_id, sample_id, dose, in_case, in_control FROM g",
    *grouped(CASE, CONTROL),
)
ORACLE["variant_frequency"] = with_calls(
    """SELECT gene_symbol, variant_id, sum_case, sum_control, n_case, n_control, ratio_case,
  ratio_control FROM vf""",
    *grouped(ALL_CASE, ALL_CONTROL),
    FREQUENCY,
)
ORACLE["variant_frequency_filter"] = with_calls(
    "SELECT variant_id, gene_symbol, count(*) AS n_carriers FROM k GROUP BY variant_id, gene_symbol",
    *grouped(ALL_CASE, ALL_CONTROL),
    kept(0.01, 0.01),
)


def burden(value: str) -> str:
    return with_calls(
        f"""SELECT gene_symbol, sample_id, cast({value} AS bigint) AS burden,
  bool_or(in_case) AS in_case, bool_or(in_control) AS in_control
FROM g GROUP BY gene_symbol, sample_id""",
        *grouped(CASE, CONTROL),
    )


ORACLE["burden_variants"] = burden("count(*)")
ORACLE["burden_alleles"] = burden("sum(dose)")
ORACLE["gene_carriers"] = with_calls(
    "SELECT * FROM counted", *grouped(ALL_CASE, ALL_CONTROL), "k AS (SELECT * FROM g)", GENE_COUNTS
)
ORACLE["recurrent_blacklist"] = with_calls(
    by_gene("kept"),
    f"keyed AS (SELECT *, {ID} AS variant_id FROM calls)",
    """kept AS (SELECT * FROM keyed WHERE variant_id NOT IN (
  SELECT variant_id FROM keyed WHERE filters = 'PASS' GROUP BY variant_id HAVING count(*) > 12))""",
)
ORACLE["recurrent_one_scan"] = ORACLE["recurrent_blacklist"]
ORACLE["position_counts"] = with_calls(
    "SELECT chr, pos, count(*) AS n_calls FROM calls GROUP BY chr, pos"
)
ORACLE["case_control_counts"] = with_calls(
    f"""SELECT {ID} AS variant_id, count(CASE WHEN {CASE} THEN 1 END) AS n_case,
  count(CASE WHEN {CONTROL} THEN 1 END) AS n_control
FROM calls WHERE ({CASE}) OR ({CONTROL}) GROUP BY {ID}"""
)

# --- samples and groups -------------------------------------------------------------------------

ORACLE["sample_ids"] = with_calls(f"SELECT DISTINCT sample_id FROM calls WHERE {CASE}")
ORACLE["sample_overlap"] = with_calls(
    f"""SELECT sample_id FROM calls WHERE {HIGH} INTERSECT SELECT sample_id FROM calls WHERE {LOW}"""
)
ORACLE["group_sizes"] = with_calls("SELECT * FROM size", *grouped(CASE, CONTROL))
ORACLE["sample_list_text"] = f"""WITH {PHENOTYPES},
sized AS (SELECT DISTINCT "Pathology", "Sample_ID", strlen("Sample_ID") AS size FROM phenotypes),
dealt AS (
  SELECT "Pathology", "Sample_ID", cast((sum(size + 3) OVER (PARTITION BY "Pathology" ORDER BY "Sample_ID")
    - size - 3) // (900 - (SELECT max(size) FROM sized)) AS bigint) AS part
  FROM sized)
SELECT "Pathology", part, string_agg("Sample_ID", ' , ' ORDER BY "Sample_ID") AS sample_ids
FROM dealt GROUP BY "Pathology", part"""
ORACLE["stacked_groups"] = with_calls(
    f"""SELECT is_case, gene_symbol, count(*) AS n_calls FROM (
  SELECT *, true AS is_case FROM calls WHERE {CASE}
  UNION ALL SELECT *, false AS is_case FROM calls WHERE {CONTROL})
GROUP BY is_case, gene_symbol"""
)
ORACLE["labelled_samples"] = with_calls(
    """SELECT "Gender" = 'F' AS is_case, snpeff_impact, count(*) AS n_calls
FROM calls c JOIN phenotypes p ON c.sample_id = p."Sample_ID" GROUP BY 1, 2""",
    PHENOTYPES,
)

# --- phenotypes ---------------------------------------------------------------------------------

ORACLE["phenotype_filter"] = f"""WITH {PHENOTYPES}
SELECT * FROM phenotypes WHERE "Data_Source" = 'EUROPE'
  AND ("Pathology" = 'BUILDING' OR "Pathology" = 'FURNITURE') AND "Sample_ID" <> '17'"""
ORACLE["phenotype_ingest"] = f"""WITH {PHENOTYPES}
SELECT * FROM phenotypes WHERE "Data_Source" NOT IN ('ASIA', 'AFRICA')"""
ORACLE["phenotype_to_calls"] = with_calls(
    by_gene("kept"),
    PHENOTYPES,
    """kept AS (SELECT * FROM calls WHERE sample_id IN (SELECT "Sample_ID" FROM phenotypes
  WHERE "Data_Source" = 'ASIA' AND "Pathology" = 'MACHINERY'))""",
)
ORACLE["facet_values"] = f"WITH {PHENOTYPES}\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS field, "{c}" AS value, count(*) AS n_rows FROM phenotypes GROUP BY "{c}" """
    for c in ("Data_Source", "Pathology", "Gender", "Super_Population")
)
ORACLE["demo_cohort"] = f"""WITH {PHENOTYPES}
SELECT "Data_Source", "Sample_ID", "Pathology", "Gender", "Super_Population" FROM (
  SELECT *, row_number() OVER (PARTITION BY "Super_Population" ORDER BY "Sample_ID") AS n
  FROM phenotypes
  WHERE "Data_Source" = 'EUROPE' AND "Super_Population" IN ('NATION_3', 'NATION_8'))
WHERE n <= 25"""
ORACLE["blanked_population"] = f"""WITH {PHENOTYPES}
SELECT "Data_Source", "Sample_ID", "Pathology", "Gender",
  CASE WHEN "Data_Source" = 'AMERICA' THEN '' ELSE "Super_Population" END AS "Super_Population"
FROM phenotypes"""
ORACLE["export_csv"] = f"WITH {PHENOTYPES} SELECT * FROM phenotypes"
ORACLE["chosen_columns"] = f"""WITH {PHENOTYPES}
SELECT "Sample_ID" AS "Sample ID", "Pathology", "Super_Population" AS "Super population"
FROM phenotypes"""

# --- browsing and filters -----------------------------------------------------------------------

ORACLE["browse_variants"] = with_calls(
    f"""SELECT {BROWSE} FROM calls WHERE {CASE}
ORDER BY chr NULLS FIRST, pos, ref, alt, gene_symbol, sample_id, zygosity, read_depth,
  genotype_quality, filters, gene_ensembl, consensus_maf NULLS FIRST, snpeff_effect NULLS FIRST,
  snpeff_impact, dbsnp_id, cadd_phred, variant_confidence_by_depth LIMIT 1000"""
)
ORACLE["browse_columns"] = with_calls(
    f"""SELECT sample_id AS "Sample", gene_symbol AS "Gene", pos AS "Position", zygosity AS "Dose"
FROM calls WHERE {CASE}"""
)
ORACLE["browse_count"] = with_calls(
    f"""SELECT n AS n_records, n > 1000 AS truncated, CASE WHEN n > 1000 THEN
  'Warning: Query returns ' || cast(n AS varchar) || ' records. First 1000 retrieved.' ELSE '' END
  AS notice FROM (SELECT count(*) AS n FROM calls WHERE {CASE})"""
)
ORACLE["browse_blank_nulls"] = with_calls(
    f"""SELECT sample_id, cast(pos AS varchar) AS pos, cast(genotype_quality AS varchar) AS
  genotype_quality, coalesce(snpeff_effect, '') AS snpeff_effect, cast(read_depth AS varchar) AS
  read_depth FROM calls WHERE {CASE}"""
)
ORACLE["scoring_columns"] = with_calls(f"SELECT {SCORING} FROM calls WHERE {CASE}")
ORACLE["empty_predicate"] = with_calls(by_gene("calls"))
ORACLE["filter_quality"] = filtered(
    "read_depth >= 10 AND genotype_quality >= 70 AND filters = 'PASS'"
    " AND variant_confidence_by_depth > 5"
)
ORACLE["filter_rarity_null"] = filtered("consensus_maf <= 0.01 OR consensus_maf IS NULL")
ORACLE["filter_rarity_strict"] = filtered("consensus_maf < 0.01 OR consensus_maf IS NULL")
ORACLE["filter_impact"] = filtered("snpeff_impact = 'HIGH'")
ORACLE["filter_effect"] = filtered("snpeff_effect != 'R' AND snpeff_effect != 'X'")
ORACLE["filter_states"] = filtered("filters = 'PASS' OR filters = 'my_indel_filter'")
ORACLE["filter_gene_panel"] = filtered(
    "gene_symbol IN (" + ", ".join(f"'{g}'" for g in PANEL) + ")"
)
ORACLE["filter_gene_file"] = filtered(
    "gene_symbol IN (SELECT p_brand || '/' || p_type FROM part WHERE p_size <= 5)"
)
ORACLE["filter_sample_list"] = filtered("sample_id IN ('1', '4', '7', '10', '13', '16')")
ORACLE["inlist_normalised"] = with_calls(
    f"SELECT {SCORING} FROM calls WHERE {SAMPLE_TEXT_EXPANDED}"
)
ORACLE["exact_variant"] = with_calls(
    f"""SELECT {SCORING} FROM calls WHERE chr = 'chr5' AND pos = 26 AND ref = 'G' AND alt = 'T'"""
)
ORACLE["numeric_range"] = filtered("read_depth BETWEEN 20 AND 30")
ORACLE["pivot_impact_by_group"] = with_calls(
    "SELECT pathology, "
    + ", ".join(
        f'nullif(count(CASE WHEN snpeff_impact = \'{level}\' THEN 1 END), 0) AS "{level}"'
        for level in ("HIGH", "MODERATE", "LOW", "MODIFIER")
    )
    + " FROM calls GROUP BY pathology"
)
ORACLE["cross_totals"] = with_calls(
    "SELECT pathology, filters, "
    + ", ".join(
        f"cast(sum(CASE WHEN snpeff_impact = '{v}' THEN read_depth END) AS bigint) AS \"{v}\""
        for v in ("HIGH", "MODERATE", "LOW")
    )
    + """, cast(sum(read_depth) AS bigint) AS total,
  cast(grouping(pathology) * 2 + grouping(filters) AS bigint) AS level
FROM calls GROUP BY ROLLUP (pathology, filters)"""
)
ORACLE["pivot_totals"] = with_calls(
    """SELECT pathology, filters, cast(sum(read_depth) AS bigint) AS depth,
  cast(grouping(pathology) * 2 + grouping(filters) AS bigint) AS level
FROM calls GROUP BY CUBE (pathology, filters)"""
)

# --- keys and display ---------------------------------------------------------------------------

ORACLE["variant_key"] = with_calls(
    f"""SELECT {ID} AS variant_id, gene_symbol, count(*) AS n_calls FROM calls
GROUP BY {ID}, gene_symbol"""
)
ORACLE["variant_key_split"] = with_calls(
    f"SELECT DISTINCT {ID} AS variant_id, chr, pos, ref, alt FROM calls"
)
ORACLE["genotype_dose"] = with_calls(
    """SELECT z AS zygosity, dose, 1 AS carrier, count(*) AS n_calls, coding FROM (
  SELECT cast(nullif(zygosity, 1) AS varchar) AS z, CASE WHEN zygosity = 2 THEN 2 ELSE 1 END AS dose,
    'number' AS coding FROM calls
  UNION ALL
  SELECT CASE WHEN zygosity = 1 THEN 'Heterozygous' WHEN read_depth > 25 THEN 'Homozygous' END,
    CASE WHEN zygosity = 1 THEN 1 ELSE 2 END, 'text' FROM calls)
GROUP BY z, dose, coding"""
)
ORACLE["pair_keys"] = """SELECT least(a.l_partkey, b.l_partkey) AS low,
  greatest(a.l_partkey, b.l_partkey) AS high, count(*) AS n
FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1, 2"""


def three_digits(x: str) -> str:
    places = f"greatest(2 - CASE WHEN {x} = 0 THEN 0 ELSE floor(log10(abs({x}))) END, 0)"
    return f"regexp_replace(format('{{:.{{}}f}}', {x}, cast({places} AS int)), '\\.?0+$', '')"


def shown(pvalue: str = "pvalue") -> str:
    return f"""{three_digits('score')} AS "Ratio_Difference", format('{{:.2e}}', {pvalue}) AS "P_Value",
  {three_digits('ratio_case')} AS "Ratio_Case", {three_digits('ratio_control')} AS "Ratio_Control",
  sum_case AS "Score_Case", sum_control AS "Score_Control" """


LINK = """replace('<a href="http://www.ncbi.nlm.nih.gov/omim/?term=' || gene_symbol
  || '" target="_blank">' || gene_symbol || '</a>', '"', chr(39))"""
ORACLE["display_format"] = f"""SELECT {shown()}, link AS "Gene_Symbol",
  CASE WHEN length(link) > 15 THEN substr(link, 1, 11) || '...' ELSE link END AS "Short_Link"
FROM (SELECT *, {LINK} AS link FROM ({gene_fisher()}))"""
ORACLE["display_variants"] = f"""SELECT {shown()}, split_part(variant_id, ':', 1) AS "Chr",
  cast(split_part(variant_id, ':', 2) AS bigint) AS "Position",
  split_part(variant_id, ':', 3) AS "Reference", split_part(variant_id, ':', 4) AS "Alternative",
  gene_symbol AS "Gene_Symbol" FROM ({variant_t(CASE, CONTROL, "LIMIT 100")})"""
ORACLE["local_times"] = """SELECT o_orderkey, strftime(timezone('Europe/Brussels', timezone('UTC',
  o_orderdate + to_hours(cast(o_orderkey % 24 AS int)))), '%Y-%m-%d %H:%M:%S') AS local_time
FROM orders"""

# --- drill-down ---------------------------------------------------------------------------------


def drilled(
    condition: str,
    *ctes: str,
    case: str = CASE,
    control: str = CONTROL,
    names: tuple[str, str] = ("building", "machinery"),
) -> str:
    return with_calls(
        f"""SELECT '{names[1]}' AS "Group", {BROWSE} FROM calls WHERE ({control}) AND {condition}
UNION ALL SELECT '{names[0]}' AS "Group", {BROWSE} FROM calls WHERE ({case}) AND {condition}""",
        *ctes,
    )


ORACLE["drilldown_variant"] = drilled(
    "chr = 'chr5' AND pos = 26 AND ref = 'G' AND alt = 'T'", case=ALL_CASE, control=ALL_CONTROL
)
ORACLE["drilldown_saved_groups"] = drilled(
    "gene_symbol = 'Brand#12/SMALL'", names=("building_rare", "machinery_rare")
)
ORACLE["drilldown_gene"] = drilled("gene_symbol = 'Brand#12/SMALL'")
ORACLE["drilldown_pair"] = drilled(
    "(gene_symbol = 'Brand#12/SMALL' OR gene_symbol = 'Brand#21/LARGE')"
)
ORACLE["drilldown_ranking"] = drilled(
    """gene_symbol IN (SELECT gene_symbol FROM ranked WHERE score > 0
  ORDER BY score DESC, gene_symbol LIMIT 10)""",
    *TOP_GENES,
)
ORACLE["annotate_lookup"] = with_calls(
    "SELECT e.*, max_maf, dbsnp_id FROM exclusive e LEFT JOIN known USING (variant_id)",
    *grouped(CASE, CONTROL),
    CASE_EXCLUSIVE,
    f"""known AS (SELECT {ID} AS variant_id, max(consensus_maf) AS max_maf, min(dbsnp_id) AS dbsnp_id
  FROM calls WHERE consensus_maf IS NOT NULL GROUP BY {ID})""",
)

# --- sources and sinks --------------------------------------------------------------------------

ORACLE["calls_parquet"] = with_calls(by_gene("calls"))
ORACLE["calls_csv"] = with_calls(by_gene("calls"))
ORACLE["calls_sql_view"] = with_calls(
    "SELECT filters, count(*) AS n_table, count(*) AS n_sql FROM calls GROUP BY filters"
)
ORACLE["calls_bucketed"] = ORACLE["gene_monogenic_rare"]
ORACLE["column_generations"] = with_calls(
    by_gene("calls")
    + "\nUNION ALL\n"
    + by_gene(
        "(SELECT sample_id, chr, pos, ref, alt, gene_ensembl AS gene_symbol, zygosity FROM calls)"
    )
)
ORACLE["group_store"] = with_calls(
    f"""SELECT 'All' AS name, count(*) AS n_calls FROM calls
UNION ALL SELECT 'building_rare', count(*) FROM calls WHERE {CASE}
UNION ALL SELECT 'samples', count(*) FROM calls WHERE {SAMPLE_TEXT_EXPANDED}"""
)
ORACLE["saved_group_ranking"] = gene_fisher()
ORACLE["results_roundtrip"] = (
    "SELECT r.*, 'saved' AS analysis_name, 'building' AS case_name, 'machinery' AS control_name,"
    " count(*) OVER () AS n_results, n_case AS listed_case, n_control AS listed_control"
    f" FROM ({gene_fisher()}) r"
)


def document(name: str, scale: str, scope: str, keys: str, sql: str) -> str:
    stats = ", ".join(
        f"cast({c} AS double) AS {c}"
        for c in ("score", "pvalue", "ratio_case", "ratio_control", "sum_case", "sum_control")
    )
    return (
        f"SELECT '{name}' AS file_name, '{name}' AS analysis_name, '{scale}' AS scale,"
        f" '{scope}' AS scope, {keys}, {stats}, cast(row_number() OVER"
        f" (ORDER BY score DESC, key1, key2) AS bigint) AS rank FROM ({sql})"
    )


ORACLE["document_scores"] = "\nUNION ALL\n".join(
    [
        document("genes", "gene", "monogenic", "gene_symbol AS key1, NULL AS key2", gene_fisher()),
        document(
            "pairs",
            "gene",
            "digenic",
            "gene_symbol1 AS key1, gene_symbol2 AS key2",
            pairs(*GENES, CASE, CONTROL, "WHERE score > 0", "LIMIT 1000"),
        ),
        document(
            "variants",
            "variant",
            "monogenic",
            "variant_id AS key1, gene_symbol AS key2",
            variant_t(ALL_CASE, ALL_CONTROL, ""),
        ),
    ]
)


def header(name: str, scale: str, scope: str, case: str, control: str, tests: str, results: str) -> str:
    """The header of one document; its groups are named apart from those of the others."""
    return with_calls(
        f"""SELECT '{name}' AS file_name, '{name}' AS analysis_name, '{scale}' AS scale,
  '{scope}' AS scope, 12.34::double AS run_time, cast(n_case AS int) AS n_case,
  cast(n_control AS int) AS n_control, 'machinery' AS control_name, 'building' AS case_name,
  cast({tests} AS bigint) AS ntests, (SELECT count(*) FROM ({results})) AS n_results,
  cast(1500000000 AS bigint) AS start_epoch, cast(1500000012 AS bigint) AS end_epoch,
  '2017-07-14 04:40:00' AS start_local FROM size""",
        *grouped(case, control),
    )


N_GENES = "(SELECT count(DISTINCT gene_symbol) FROM g)"
ORACLE["document_headers"] = "\nUNION ALL\n".join(
    f"SELECT * FROM ({sql})"
    for sql in (
        header("genes", "gene", "monogenic", CASE, CONTROL, N_GENES, gene_fisher()),
        header(
            "pairs",
            "gene",
            "digenic",
            CASE,
            CONTROL,
            f"{N_GENES} * ({N_GENES} + 1) // 2",
            pairs(*GENES, CASE, CONTROL, "WHERE score > 0", "LIMIT 1000"),
        ),
        header(
            "variants",
            "variant",
            "monogenic",
            ALL_CASE,
            ALL_CONTROL,
            "(SELECT count(*) FROM (SELECT DISTINCT variant_id, gene_symbol FROM g))",
            variant_t(ALL_CASE, ALL_CONTROL, ""),
        ),
    )
)
ORACLE["document_samples"] = "\nUNION ALL\n".join(
    "SELECT * FROM ("
    + with_calls(
        f"SELECT DISTINCT '{name}' AS file_name, sample_id, in_case AS is_case FROM g",
        *grouped(case, control),
    )
    + ")"
    for name, case, control in (
        ("genes", CASE, CONTROL),
        ("pairs", CASE, CONTROL),
        ("variants", ALL_CASE, ALL_CONTROL),
    )
)
ORACLE["results_empty"] = with_calls(
    f"""SELECT n_case, n_control, {N_GENES} AS ntests, 0 AS n_results, n_case + n_control AS n_listed
FROM size""",
    *grouped(ALL_CASE, ALL_CONTROL),
)
ORACLE["preview_unordered"] = with_calls(
    f"""SELECT gene_symbol, count(*) AS n_calls, cast(sum(pos) AS bigint) AS pos
FROM calls WHERE {ALL_CASE} GROUP BY gene_symbol"""
)
ORACLE["analysis_catalog"] = with_calls(
    """SELECT 'first' AS file_name, count(*) AS n_results FROM ranked WHERE score > 0
UNION ALL SELECT 'second', count(*) FROM ranked WHERE score > -1""",
    *grouped(ALL_CASE, ALL_CONTROL),
    kept(0.5, 0.5),
    GENE_COUNTS,
    scored("gene_symbol"),
)
ORACLE["export_scores"] = f"SELECT gene_symbol, score, pvalue FROM ({gene_fisher()})"
ORACLE["synthetic_table"] = """SELECT cast((p - 1) // 4 + 1 AS varchar) AS gene_symbol, '1' AS chr,
  p AS pos, 'A' AS ref, 'C' AS alt, count(*) AS n_calls, 1 AS min_dose, 2 AS max_dose
FROM customer, range(1, 21) r(p) GROUP BY p"""
