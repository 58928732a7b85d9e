"""Keys and recodings of a genotype call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def variant_id(chrom="chr", pos="pos", ref="ref", alt="alt") -> Column:
    """``chr:pos:ref:alt``; NULL when any part is NULL, so a half-known variant never matches."""
    parts = [F.col(c).cast("string") for c in (chrom, pos, ref, alt)]
    return F.concat(parts[0], F.lit(":"), parts[1], F.lit(":"), parts[2], F.lit(":"), parts[3])


def variant_parts(column: str = "variant_id") -> dict[str, Column]:
    """The four parts of a variant id."""
    parts = F.split(F.col(column), ":")
    return {
        "chr": F.get(parts, 0),
        "pos": F.get(parts, 1).try_cast("bigint"),
        "ref": F.get(parts, 2),
        "alt": F.get(parts, 3),
    }


def split_variant_id(df: DataFrame, column: str = "variant_id") -> DataFrame:
    """Put the four parts of a variant id next to it."""
    return df.withColumns(variant_parts(column))


def genotype_dose(calls: DataFrame, column: str = "zygosity") -> Column:
    """Allele dose 1 or 2 under either zygosity coding.

    Text: ``Heterozygous`` is 1 and everything else, NULL included, is 2.
    Number: 2 is 2 and everything else, NULL included, is 1.
    """
    zygosity = F.col(column)
    if isinstance(calls.schema[column].dataType, T.StringType):
        return F.when(zygosity == "Heterozygous", 1).otherwise(2)
    return F.when(zygosity == 2, 2).otherwise(1)


def carrier(dose) -> Column:
    """1 when the dose is above zero, otherwise 0."""
    return F.when(dose > 0, 1).otherwise(0)


def pair_key(a, b) -> list[Column]:
    """The two members of an unordered pair, smaller first."""
    return [F.least(a, b), F.greatest(a, b)]
