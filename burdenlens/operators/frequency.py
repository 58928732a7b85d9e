"""Carrier counts and frequencies of variants within the two groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burdenlens.functions.keys import variant_id
from burdenlens.operators.burden import carrier_counts

VARIANT_KEY = ["gene_symbol", "variant_id"]


def ratio(total: Column, size: Column) -> Column:
    """Share of a group; 0 for an empty group."""
    return F.coalesce(F.try_divide(total.cast("double"), size.cast("double")), F.lit(0.0))


def with_ratios(
    counted: DataFrame, sizes: Column, case: str = "sum_case", control: str = "sum_control"
) -> DataFrame:
    """Add the group sizes and the share of each group; ``sizes`` is a scalar struct."""
    sized = counted.withColumn("sizes", sizes)
    n_case, n_control = F.col("sizes.n_case"), F.col("sizes.n_control")
    return sized.select(
        *counted.columns,
        n_case.alias("n_case"),
        n_control.alias("n_control"),
        ratio(F.col(case), n_case).alias("ratio_case"),
        ratio(F.col(control), n_control).alias("ratio_control"),
    )


def variant_frequencies(genotypes: DataFrame, sizes: Column) -> DataFrame:
    """Carriers of each (gene, variant) per group and their share of the group.

    ``genotypes`` holds one row per (gene, variant, sample), so plain conditional counts are
    distinct counts and combine map-side.
    """
    return with_ratios(carrier_counts(genotypes, *VARIANT_KEY), sizes)


def too_frequent(max_case: float, max_control: float, strict: bool = False) -> Column:
    """Whether a variant is too common in either group. ``strict`` also rejects equality."""
    case, control = F.col("ratio_case"), F.col("ratio_control")
    if strict:
        return (case >= max_case) | (control >= max_control)
    return (case > max_case) | (control > max_control)


def filters_anything(max_case: float, max_control: float, strict: bool = False) -> bool:
    """Whether a frequency limit can reject a variant at all (shares never exceed 1)."""
    return max_case < 1 or max_control < 1 or strict


def drop_frequent(
    genotypes: DataFrame,
    frequencies: DataFrame,
    max_case: float,
    max_control: float,
    strict: bool = False,
) -> DataFrame:
    """Genotypes without the variants that are too common in either group.

    ``frequencies`` comes from :func:`variant_frequencies`. The join is against the *rejected*
    variants: each of them is carried by a fixed share of a group, so there are at most
    (calls per sample) / (limit) of them, far fewer than variants. Spark broadcasts them where
    they fit; otherwise adaptive execution splits the rows of a variant that fills a partition.
    """
    rejected = frequencies.where(too_frequent(max_case, max_control, strict)).select(
        *[F.col(k).alias(f"rejected_{k}") for k in VARIANT_KEY]
    )
    same = [F.col(k).eqNullSafe(F.col(f"rejected_{k}")) for k in VARIANT_KEY]
    return genotypes.join(rejected, same, "left_anti")


def recurrent_variants(calls: DataFrame, more_than: int = 40, state: str = "PASS") -> DataFrame:
    """Variants with more than so many calls in a filter state over the whole table."""
    counted = (
        calls.where(F.col("filters") == state)
        .groupBy(variant_id().alias("variant_id"))
        .agg(F.count("*").alias("n_calls"))
    )
    return counted.where(F.col("n_calls") > more_than)


def drop_variants(calls: DataFrame, listed: DataFrame) -> DataFrame:
    """Calls whose variant is not in a list of variant ids."""
    keyed = calls.withColumn("variant_id", variant_id())
    return keyed.join(listed.select("variant_id"), "variant_id", "left_anti")


def drop_recurrent(
    calls: DataFrame, more_than: int = 40, state: str = "PASS", shares: int = 8
) -> DataFrame:
    """Calls of the variants with at most so many calls in a filter state, from one scan.

    Calls are shuffled once, by variant and share, a hash of the sample; so a variant with a third of
    all calls is dealt to ``shares`` tasks. Each counts its part, the parts are added up by variant, one
    row each, and the shares of recurrent variants meet the calls where these already are. Where the
    list of recurrent variants is small, :func:`recurrent_variants` and :func:`drop_variants` scan
    twice but shuffle no calls; this is for long lists and costly sources.
    """
    share = F.pmod(F.xxhash64("sample_id"), F.lit(shares)).cast("int")
    keyed = calls.withColumn("variant_id", variant_id())
    dealt = keyed.withColumns(
        {"_variant": F.coalesce("variant_id", F.lit("")), "_share": share}
    ).repartition("_variant", "_share")
    # The largest hash decides nothing, as every long is at least the least one. It names all columns,
    # so that counting reads the same shuffle as the calls; and an outer join on keys that are never
    # null, unlike an anti-join, moves nothing below the shuffle. The calls that stay name all columns too,
    # in one condition with the list, so that a reader of a few columns still shares the shuffle; such a
    # reader should select these before.
    found = (F.col("filters") == state) & F.col("variant_id").isNotNull()
    counted = dealt.groupBy("_variant", "_share").agg(
        F.count_if(found).alias("_n"), F.max(F.xxhash64(*dealt.columns)).alias("_any")
    )
    total = F.sum("_n").over(Window.partitionBy("_variant"))
    recurrent = counted.withColumn("_total", total).where(
        (F.col("_total") > more_than) & (F.col("_any") >= F.lit(-(2**63)))
    )
    listed = recurrent.select("_variant", "_share", F.lit(True).alias("_listed"))
    whole = F.xxhash64(*dealt.columns) < F.lit(-(2**63))  # never
    kept = dealt.join(listed, ["_variant", "_share"], "left").where(~F.coalesce("_listed", whole))
    return kept.drop("_variant", "_share", "_listed")


def position_counts(calls: DataFrame) -> DataFrame:
    """Number of calls per chromosome position."""
    return calls.groupBy("chr", "pos").agg(F.count("*").alias("n_calls"))
