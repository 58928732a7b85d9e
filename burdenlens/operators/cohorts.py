"""Case and control groups: tagging, duplicate calls, sample lists and group sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burdenlens.functions.keys import genotype_dose, variant_id
from burdenlens.operators.filters import apply_predicate, as_predicate, keep_listed
from burdenlens.workspace import in_ranges

_BETWEEN = " , "
OVERLAP_MESSAGE = "a sample is in the case and in the control group"


def tag_groups(
    calls: DataFrame, case: str | Column, control: str | Column | None
) -> DataFrame:
    """Rows of either group from a single scan, flagged ``in_case`` and ``in_control``.

    The empty predicate is every row; ``control=None`` is no control group. Both predicates reach
    the scan as one OR, whose common conjuncts Spark pushes down. The result has ``variant_id,
    gene_symbol, sample_id, dose`` and the flags.
    """
    in_case, in_control = group_flags(case, control)
    return calls.where((in_case | in_control) & F.col("sample_id").isNotNull()).select(
        variant_id().alias("variant_id"),
        F.col("gene_symbol"),
        F.col("sample_id"),
        genotype_dose(calls).alias("dose"),
        F.coalesce(in_case, F.lit(False)).alias("in_case"),
        F.coalesce(in_control, F.lit(False)).alias("in_control"),
    )


def group_flags(case: str | Column, control: str | Column | None) -> tuple[Column, Column]:
    """Conditions for a row to be in the case and in the control group."""
    in_case, in_control = as_predicate(case), as_predicate(control)
    return (
        F.lit(True) if in_case is None else in_case,
        F.lit(control is not None) if in_control is None else in_control,
    )


def tag_by_list(
    calls: DataFrame, case: str | Column, control: str | Column | None, cohort: DataFrame
) -> DataFrame:
    """As :func:`tag_groups`, the group of a sample being read from a list ``(sample_id, is_case)``.

    A row counts when it satisfies the predicate of the group its sample is listed in.
    """
    labelled = label_samples(calls, cohort)
    in_case, in_control = group_flags(case, control)
    return tag_groups(labelled, F.col("is_case") & in_case, ~F.col("is_case") & in_control)


def unique_calls(tagged: DataFrame) -> DataFrame:
    """One row per (gene, variant, sample): the largest dose of duplicated calls.

    Aggregated map-side first, so repeated copies of a call never travel.
    """
    unique = tagged.groupBy("gene_symbol", "variant_id", "sample_id").agg(
        F.max("dose").alias("dose"),
        F.bool_or("in_case").alias("in_case"),
        F.bool_or("in_control").alias("in_control"),
    )
    # Holds for every row. Naming all aggregates here gives each branch of a plan that reads this
    # table (group sizes, test counts, scores) the same shuffle, which Spark then runs only once.
    return unique.where("dose > 0 AND (in_case OR in_control)")


def sample_roles(tagged: DataFrame) -> DataFrame:
    """One row per sample with the groups it occurs in."""
    return tagged.groupBy("sample_id").agg(
        F.bool_or("in_case").alias("in_case"), F.bool_or("in_control").alias("in_control")
    )


def group_sizes(roles: DataFrame, on_overlap: str = "raise") -> DataFrame:
    """One row: number of case and of control samples.

    With ``raise`` the query fails when a sample is in both groups; with ``exclude`` such samples
    count in neither.
    """
    both = F.col("in_case") & F.col("in_control")
    if on_overlap == "raise":
        in_case = F.when(both, F.raise_error(F.lit(OVERLAP_MESSAGE)).cast("boolean")).otherwise(
            F.col("in_case")
        )
    elif on_overlap == "exclude":
        in_case = F.col("in_case") & ~F.col("in_control")
    else:
        raise ValueError("on_overlap must be 'raise' or 'exclude'")
    return roles.agg(
        F.count_if(in_case).alias("n_case"),
        F.count_if(F.col("in_control") & ~F.col("in_case")).alias("n_control"),
    )


def overlapping_samples(case: DataFrame, control: DataFrame) -> DataFrame:
    """Sample ids that occur in both groups."""
    return case.select("sample_id").intersect(control.select("sample_id"))


def drop_overlap(calls: DataFrame, roles: DataFrame) -> DataFrame:
    """Calls without the samples that are in both groups."""
    both = roles.where("in_case AND in_control").select("sample_id")
    return calls.join(both, "sample_id", "left_anti")


def sample_ids(calls: DataFrame) -> DataFrame:
    """Distinct sample ids, sorted."""
    return calls.select("sample_id").distinct().orderBy("sample_id")


def stack_groups(control: DataFrame, case: DataFrame) -> DataFrame:
    """Rows of the control group and of the case group with ``is_case``."""
    return control.withColumn("is_case", F.lit(False)).unionByName(
        case.withColumn("is_case", F.lit(True))
    )


def label_samples(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Look the group of each call up in a sample list ``(sample_id, is_case)``; others drop out.

    A sample listed several times counts once in each group it is listed in. No hint: the list is
    broadcast when its size allows it and shuffled when not.
    """
    listed = samples.select("sample_id", "is_case").distinct()
    return calls.join(listed, "sample_id")


def calls_of_phenotype(calls: DataFrame, phenotypes: DataFrame, predicate) -> DataFrame:
    """Calls of the samples whose phenotype satisfies a predicate."""
    return keep_listed(calls, apply_predicate(phenotypes, predicate), "sample_id", "Sample_ID")


def sample_list_text(
    samples: DataFrame, by: list[str], column: str = "sample_id", max_bytes: int = 1 << 20
) -> DataFrame:
    """The sample ids of each selection as texts, ``' , '`` between them, to copy elsewhere.

    Ids are in order over the numbered texts of a selection, and no text is above ``max_bytes``, however
    large a selection is: sums of the sizes before an id, over ranges of the order, choose its text.
    """
    selection = [f"by{k}" for k in range(len(by))]
    distinct = samples.where(F.col(column).isNotNull()).select(
        *[F.col(c).alias(n) for c, n in zip(by, selection)], F.col(column).alias("sample_id")
    ).distinct()
    sized = distinct.withColumn("size", F.octet_length("sample_id") + len(_BETWEEN))
    ranged = in_ranges(sized, [*selection, "sample_id"], "sample-list")
    so_far = Window.partitionBy("part", *selection).orderBy("place").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # a row for each range and selection in it
    sums = ranged.groupBy("part", *selection).agg(F.sum("size").alias("in_part"))
    earlier = Window.partitionBy(*selection).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("start"),
        *[F.col(c).alias(f"_{c}") for c in ("part", *selection)],
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("part", *selection)]
    local = F.coalesce(F.sum("size").over(so_far), F.lit(0))
    room = max_bytes - ranged.agg(F.max("size") - len(_BETWEEN)).scalar()
    small = F.raise_error(F.lit("max_bytes leaves no room beside the longest id")).cast("long")
    room = F.when(room < 1, small).otherwise(room)
    placed = ranged.withColumn("local", local).join(starts, same)
    dealt = placed.withColumn("text", F.floor((F.col("start") + F.col("local")) / room))
    listed = F.array_join(F.sort_array(F.collect_list("sample_id")), _BETWEEN)
    return dealt.groupBy(*selection, "text").agg(listed.alias("sample_ids")).select(
        *[F.col(n).alias(c) for c, n in zip(by, selection)], F.col("text").alias("part"), "sample_ids"
    )
