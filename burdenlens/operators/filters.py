"""Predicates on calls and phenotypes, and the presets the saved groups are made of."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_IN_LIST = re.compile(r"\bIN\s*\(\s*'((?:[^']|'')*)'\s*\)", re.IGNORECASE)


def normalise_in_lists(predicate: str) -> str:
    """Expand the shorthand ``IN('a , b')`` to ``IN('a','b')``.

    Only a single quoted text inside ``IN (...)`` is touched, and spaces around its commas are
    trimmed; doubled quotes in it stay doubled. A list of several quoted values is quoted value by
    value already and stays as it is, commas within a value included.
    """

    def expand(match: re.Match) -> str:
        values = [v.strip() for v in match.group(1).split(",")]
        return "IN(" + ",".join(f"'{v}'" for v in values) + ")"

    return _IN_LIST.sub(expand, predicate)


def as_predicate(predicate: str | Column | None) -> Column | None:
    """A Column from SQL predicate text, or None where it keeps every row."""
    if predicate is None or isinstance(predicate, Column):
        return predicate
    text = predicate.strip()
    return F.expr(normalise_in_lists(text)) if text else None


def apply_predicate(df: DataFrame, predicate: str | Column | None) -> DataFrame:
    """Rows that satisfy a saved predicate; the empty predicate keeps all."""
    condition = as_predicate(predicate)
    return df if condition is None else df.where(condition)


def all_of(*conditions: Column) -> Column:
    """Conjunction of conditions."""
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def samples_in(samples: Iterable[str] | str, column: str = "sample_id") -> Column:
    """Membership in a sample list, given as values or as one comma-separated text."""
    if isinstance(samples, str):
        samples = [s.strip() for s in samples.split(",") if s.strip()]
    return F.col(column).isin(list(samples))


def quality(
    min_depth: int = 10,
    min_quality: int = 70,
    states: Iterable[str] | None = None,
    above_confidence: float | None = None,
) -> Column:
    """Read depth and genotype quality at least so high, and optionally filter states and a
    confidence that must be exceeded."""
    condition = (F.col("read_depth") >= min_depth) & (F.col("genotype_quality") >= min_quality)
    if states is not None:
        condition = condition & filter_states(states)
    if above_confidence is not None:
        condition = condition & (F.col("variant_confidence_by_depth") > above_confidence)
    return condition


def filter_states(states: Iterable[str]) -> Column:
    """Any of the given filter states."""
    return F.col("filters").isin(list(states))


def rare(max_frequency: float, strict: bool = False, column: str = "consensus_maf") -> Column:
    """Population frequency at most (strict: below) a limit; unknown counts as rare."""
    value = F.col(column)
    below = value < max_frequency if strict else value <= max_frequency
    return below | value.isNull()


def impact(*levels: str) -> Column:
    """Any of the given impact levels."""
    return F.col("snpeff_impact").isin(list(levels))


def effect_not(*effects: str) -> Column:
    """None of the given effects; rows with an unknown effect are dropped, as in a chain of !=."""
    return ~F.col("snpeff_effect").isin(list(effects))


def in_genes(genes: Iterable[str]) -> Column:
    """Membership in a gene panel given as values."""
    return F.col("gene_symbol").isin(list(genes))


def keep_listed(df: DataFrame, listed: DataFrame, column: str, listed_column: str | None = None):
    """Rows whose column value occurs in a list held as a DataFrame (samples or genes).

    A left-semi join without a hint: Spark broadcasts the list where its measured size is under
    the session's threshold and shuffles it otherwise.
    """
    name = listed_column or listed.columns[0]
    return df.join(listed.select(F.col(name).alias(column)), column, "left_semi")


def exact_variant(chrom: str, pos: int, ref: str, alt: str) -> Column:
    """One variant by its four parts."""
    return (
        (F.col("chr") == chrom)
        & (F.col("pos") == pos)
        & (F.col("ref") == ref)
        & (F.col("alt") == alt)
    )


def id_range(column: str, low, high) -> Column:
    """Inclusive range of a numeric id."""
    return F.col(column).between(low, high)


def blank_where(df: DataFrame, column: str, condition: Column) -> DataFrame:
    """Empty text in a column where a condition holds."""
    return df.withColumn(column, F.when(condition, F.lit("")).otherwise(F.col(column)))
