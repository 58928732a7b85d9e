"""Browsing: counts, previews, facets, pivots and lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burdenlens.operators.filters import apply_predicate
from burdenlens.schema import browse_projection, choose_columns

MAX_ROWS = 1000
MAX_TAKEN = 10_000
# Fixed value: the notice users know.
NOTICE = "Warning: Query returns %d records. First %d retrieved."
_ORDER = ["chr", "pos", "ref", "alt", "gene_symbol", "sample_id"]


def browse(
    calls: DataFrame,
    predicate: str | Column | None = None,
    columns: dict[str, str] | list[str] | None = None,
    max_rows: int | None = MAX_ROWS,
    ordered: bool = True,
) -> DataFrame:
    """Browse columns of the rows of a group, at most ``max_rows`` of them (None: all).

    ``ordered`` makes the preview the same every time, by a top-k over the matching rows. Without it
    the rows are taken now, and Spark reads one partition, then a few more, until it has enough; they
    pass through the driver, so no more than ``MAX_TAKEN`` can be asked for.
    """
    rows = browse_projection(apply_predicate(calls, predicate))
    if max_rows is not None and not ordered:
        if max_rows > MAX_TAKEN:
            raise ValueError(f"an unordered preview has at most {MAX_TAKEN} rows")
        rows = rows.sparkSession.createDataFrame(rows.take(max_rows), rows.schema)
    elif max_rows is not None:
        # total order over the shown columns, position first
        first = [c for c in _ORDER if c in rows.columns]
        rows = rows.orderBy(*first, *[c for c in rows.columns if c not in first]).limit(max_rows)
    return rows if columns is None else choose_columns(rows, columns)


def count_rows(
    calls: DataFrame, predicate: str | Column | None = None, max_rows: int = MAX_ROWS
) -> DataFrame:
    """One row: how many rows a group has, whether a preview cuts them, and the notice to show."""
    n = F.col("n_records")
    notice = F.format_string(NOTICE, n, F.lit(max_rows))
    return (
        apply_predicate(calls, predicate)
        .agg(F.count("*").alias("n_records"))
        .select(
            n,
            (n > max_rows).alias("truncated"),
            F.when(n > max_rows, notice).otherwise("").alias("notice"),
        )
    )


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each categorical column with their row counts, in one pass."""
    tall = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "field", "value"
    )
    return tall.groupBy("field", "value").agg(F.count("*").alias("n_rows"))


def pivot(
    df: DataFrame, rows: list[str], column: str, measure: Column, values: list | None = None
) -> DataFrame:
    """Cross table of a measure. With the column's values given, no extra pass looks them up."""
    return df.groupBy(*rows).pivot(column, values).agg(measure)


def totals(df: DataFrame, dimensions: list[str], measure: Column) -> DataFrame:
    """The measure over every combination of dimensions, subtotals and grand total included.

    ``level`` tells a subtotal (bit set for each dimension left out) from a NULL value.
    """
    return df.cube(*dimensions).agg(measure, F.grouping_id().alias("level"))


def cross_table(
    df: DataFrame, rows: list[str], column: str, values: list, measure: Callable[[Column], Column]
) -> DataFrame:
    """Cross table with margins, in one aggregation.

    A column for each of the given values of ``column`` and ``total`` over all values, given or not; a
    row for each combination of ``rows``, its subtotals from the left, and the grand total. ``level``
    tells a margin from a NULL, as in :func:`totals`. ``measure`` makes the aggregate over the rows that
    a condition selects.
    """
    cells = [measure(F.col(column).eqNullSafe(F.lit(v))).alias(str(v)) for v in values]
    return df.rollup(*rows).agg(
        *cells, measure(F.lit(True)).alias("total"), F.grouping_id().alias("level")
    )


def annotate(rows: DataFrame, annotations: DataFrame, on: str = "variant_id") -> DataFrame:
    """Add the columns of an annotation table with one row per key; unmatched rows get NULL."""
    return rows.join(annotations, on, "left")
