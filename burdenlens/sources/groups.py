"""Saved groups: named predicates in a small table, one row a name.

The store is a Parquet folder, so any text is kept as it is. A change adds one file of new versions and
touches no other: a name is what its latest version says, and a deleted name has a version that says so.
A file becomes visible as a whole, so a reader during a change sees the old or the new groups, and a
crash leaves the old ones; the last of two writers wins, and neither loses what the other says of
another name.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenlens.operators.drilldown import drill_down
from burdenlens.operators.filters import as_predicate
from burdenlens.plans.spec import AnalysisSpec

# Every store starts with the group of all rows.
ALL = ("All", "")
_SCHEMA = "Name string, SQL string"
_VERSIONS = f"{_SCHEMA}, version bigint, deleted boolean"


def _format(io):
    quoting = io.option("quote", '"').option("escape", "\\").option("multiLine", True)
    return quoting.option("sep", "\t").option("header", True)


def read_group_file(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file of groups with header ``Name``, ``SQL``, values quoted; a predicate may
    run over several lines."""
    groups = _format(spark.read).schema(_SCHEMA).csv(path)
    return groups.select("Name", F.coalesce("SQL", F.lit("")).alias("SQL"))


def create_store(spark: SparkSession, path: str) -> None:
    """A new store with the group of all rows."""
    _versions(spark.createDataFrame([ALL], _SCHEMA), 0).write.parquet(path)


def load_groups(spark: SparkSession, path: str) -> DataFrame:
    """The groups of a store."""
    latest = F.max_by(F.struct("SQL", "deleted"), F.coalesce("version", F.lit(0)))
    known = spark.read.schema(_VERSIONS).parquet(path).groupBy("Name").agg(latest.alias("latest"))
    return known.where("NOT coalesce(latest.deleted, false)").select("Name", "latest.SQL")


def save_groups(spark: SparkSession, path: str, groups: DataFrame) -> None:
    """Add groups; one of a name that is there takes its place. A name given twice is refused."""
    twice = groups.groupBy("Name").count().where("count > 1").head()
    if twice:
        raise ValueError(f"two groups are named {twice['Name']!r}")
    _add(groups.select("Name", "SQL"), path)


def delete_groups(spark: SparkSession, path: str, names: list[str]) -> None:
    """Delete groups by name."""
    _add(spark.createDataFrame([(n, None) for n in names], _SCHEMA), path, deleted=True)


def compact_store(spark: SparkSession, path: str, to: str) -> None:
    """The groups of a store as a new store of one file."""
    _versions(load_groups(spark, path), 0).write.parquet(to)


def _versions(groups: DataFrame, version: int, deleted: bool = False) -> DataFrame:
    """Rows to add to a store; one file, as a change is seen as a whole."""
    said = groups.withColumns({"version": F.lit(version).cast("long"), "deleted": F.lit(deleted)})
    return said.coalesce(1)


def _add(groups: DataFrame, path: str, deleted: bool = False) -> None:
    spark = groups.sparkSession
    (last,) = spark.read.schema(_VERSIONS).parquet(path).agg(F.max("version")).head()
    _versions(groups, max(time.time_ns(), (last or 0) + 1), deleted).write.mode("append").parquet(path)


def group_named(groups: DataFrame, name: str) -> str:
    """The predicate text saved under a name."""
    found = groups.where(F.col("Name") == name).select("SQL").head(1)
    if not found:
        raise KeyError(f"no group named {name!r}")
    return found[0]["SQL"] or ""


def rows_of_group(df: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """Rows of a table that a saved group selects."""
    condition: Column | None = as_predicate(group_named(groups, name))
    return df if condition is None else df.where(condition)


def analysis_of_groups(
    groups: DataFrame, name: str, case_name: str, control_name: str | None, **options
) -> AnalysisSpec:
    """The analysis that compares two saved groups; see :class:`AnalysisSpec` for the options."""
    control = None if control_name is None else group_named(groups, control_name)
    return AnalysisSpec(
        name,
        group_named(groups, case_name),
        control,
        case_name=case_name,
        control_name=control_name or "NULL",
        **options,
    )


def drill_down_groups(
    calls: DataFrame, groups: DataFrame, case_name: str, control_name: str | None, selection
) -> DataFrame:
    """The calls of two saved groups behind a selected item of their ranking."""
    spec = analysis_of_groups(groups, "drill-down", case_name, control_name)
    return drill_down(
        calls, spec.case, spec.control, selection, spec.case_name, spec.control_name
    )
