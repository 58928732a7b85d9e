"""Per-sample burden of genes and its per-group totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gene_burden(genotypes: DataFrame, by: str = "variants") -> DataFrame:
    """Burden of each (gene, sample): variants carried, or alleles carried.

    ``genotypes`` holds one row per (gene, variant, sample), so the number of variants is a row
    count.
    """
    if by == "variants":
        burden = F.count("*")
    elif by == "alleles":
        burden = F.sum("dose")
    else:
        raise ValueError("burden must be 'variants' or 'alleles'")
    return genotypes.groupBy("gene_symbol", "sample_id").agg(
        burden.cast("bigint").alias("burden"),
        F.bool_or("in_case").alias("in_case"),
        F.bool_or("in_control").alias("in_control"),
    )


def carriers(rows: DataFrame, item: str) -> DataFrame:
    """One row per (item, sample) that carries it, whatever the number of calls behind it."""
    carrying = rows.groupBy(item, "sample_id").agg(
        F.bool_or("in_case").alias("in_case"), F.bool_or("in_control").alias("in_control")
    )
    # holds for every row; keeps the shuffle the same for all readers, see unique_calls
    return carrying.where("in_case OR in_control")


def carrier_columns(case: str = "sum_case", control: str = "sum_control") -> list[Column]:
    """Aggregates over one row per (item, sample): carriers per group."""
    return [F.count_if("in_case").alias(case), F.count_if("in_control").alias(control)]


def counted(rows: DataFrame, aggregates: list[Column], *item: str) -> DataFrame:
    """Aggregates of rows per item. Rows are in a group, so no item has only zeros.

    The condition says just that. It names every aggregate, so that a count of the items and the
    scores of the items share one shuffle.
    """
    out = rows.groupBy(*item).agg(*aggregates)
    return out.where(" + ".join(c for c in out.columns if c not in item) + " > 0")


def carrier_counts(carrying: DataFrame, *item: str) -> DataFrame:
    """Carriers of each item per group, from one row per (item, sample)."""
    return counted(carrying, carrier_columns(), *item)


def moments(value: Column) -> list[Column]:
    """Aggregates over one row per (item, sample): sum and sum of squares per group."""

    def total(v: Column, group: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(group), v)), F.lit(0)).cast("bigint")

    return [
        total(value, "in_case").alias("sum_case"),
        total(value, "in_control").alias("sum_control"),
        total(value * value, "in_case").alias("sumsq_case"),
        total(value * value, "in_control").alias("sumsq_control"),
    ]


def value_moments(rows: DataFrame, value: Column, *item: str) -> DataFrame:
    """Sum and sum of squares of a value per item and group, from one row per (item, sample)."""
    return counted(rows, moments(value), *item)
