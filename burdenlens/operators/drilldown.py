"""From ranked items back to the calls behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burdenlens.operators.cohorts import group_flags
from burdenlens.operators.filters import in_genes, keep_listed
from burdenlens.schema import browse_projection


def drill_down(
    calls: DataFrame,
    case: str | Column,
    control: str | Column | None,
    selection: list[str] | Column | DataFrame,
    case_name: str = "case",
    control_name: str = "control",
) -> DataFrame:
    """All calls of both groups in what was selected, labelled with the name of their group.

    The selection is the names of a gene or of the genes of a pair, or a condition such as one
    variant (:func:`burdenlens.operators.filters.exact_variant`), both of which reach the scan as a
    filter; or a DataFrame with one gene per row. A call that both predicates select comes out
    under each name.
    """
    in_case, in_control = group_flags(case, control)
    rows = calls.where(in_case | in_control)
    if isinstance(selection, DataFrame):
        rows = keep_listed(rows, selection, "gene_symbol")
    elif isinstance(selection, Column):
        rows = rows.where(selection)
    else:
        rows = rows.where(in_genes(selection))
    labels = F.array_compact(
        F.array(F.when(in_control, F.lit(control_name)), F.when(in_case, F.lit(case_name)))
    )
    shown = browse_projection(calls).columns
    return rows.select(F.explode(labels).alias("Group"), *shown)


def ranked_genes(ranking: DataFrame) -> DataFrame:
    """The genes of a ranking of genes or gene pairs, one per row."""
    columns = [c for c in ranking.columns if c.startswith("gene_symbol")]
    return ranking.select(F.explode(F.array(*columns)).alias("gene_symbol")).distinct()


def case_control_counts(calls: DataFrame, case, control, key: Column, name: str) -> DataFrame:
    """Case and control calls of each key next to each other, zero where a group has none."""
    in_case, in_control = group_flags(case, control)
    return (
        calls.where(in_case | in_control)
        .groupBy(key.alias(name))
        .agg(
            F.count_if(in_case).alias("n_case"),
            F.count_if(in_control).alias("n_control"),
        )
    )
