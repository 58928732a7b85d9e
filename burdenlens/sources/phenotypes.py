"""Phenotype tables: reader, JSON ingest and the demo cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burdenlens.operators.filters import apply_predicate
from burdenlens.schema import PHENOTYPE_FIELDS

# Sources whose rows ingest leaves out.
EXCLUDED_SOURCES = ["UZ Brussel", ""]
# The demo cohort.
DEMO_SOURCE = "1000 Genomes"
DEMO_POPULATIONS = ["EUR", "EAS"]
DEMO_SIZE = 25


def read_phenotypes(
    spark: SparkSession, path: str, predicate: str | Column | None = None
) -> DataFrame:
    """The phenotype table, filtered by a saved predicate."""
    return apply_predicate(spark.read.parquet(path), predicate)


def clean_phenotypes(raw: DataFrame, excluded=tuple(EXCLUDED_SOURCES)) -> DataFrame:
    """Canonical column names for the five columns, in order, without rows of excluded sources.

    Rows of unknown (NULL) source go too, as under a comparison with !=.
    """
    named = raw.toDF(*PHENOTYPE_FIELDS)
    return named.where(~F.col("Data_Source").isin(list(excluded)))


def ingest_phenotypes(spark: SparkSession, json_path: str, columns: list[str], path: str) -> None:
    """Load phenotypes from JSON records and replace the phenotype table.

    ``columns`` names the JSON fields of the five columns, in their order: JSON objects carry no
    column order Spark could rely on.
    """
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).json(json_path)
    clean_phenotypes(raw.select(*columns)).write.mode("overwrite").parquet(path)


def first_per_population(
    phenotypes: DataFrame, source: str, populations: list[str], size: int
) -> DataFrame:
    """The first samples of each given population of a source, by sample id."""
    in_order = Window.partitionBy("Super_Population").orderBy("Sample_ID")
    return (
        phenotypes.where(
            (F.col("Data_Source") == source) & F.col("Super_Population").isin(populations)
        )
        .withColumn("position", F.row_number().over(in_order))
        .where(F.col("position") <= size)
        .drop("position")
    )


def demo_cohort(phenotypes: DataFrame) -> DataFrame:
    """The 25 first European and East Asian samples of the public source."""
    return first_per_population(phenotypes, DEMO_SOURCE, DEMO_POPULATIONS, DEMO_SIZE)
