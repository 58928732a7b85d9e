"""Synthetic genotype table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of a synthetic call.
CHROMOSOME, REFERENCE, ALTERNATIVE = "1", "A", "C"


def numbered_samples(spark: SparkSession, samples: int) -> DataFrame:
    """Sample ids 1 to n."""
    return spark.range(1, samples + 1).select(F.col("id").cast("string").alias("sample_id"))


def synthetic_calls(
    samples: DataFrame, variants_per_gene: int, genes: int, seed: int = 42
) -> DataFrame:
    """Every sample of a list carries every variant of every gene, with dose 1 or 2 at random.

    Each sample row is expanded in place, so nothing is joined or shuffled. The dose is a hash of
    sample, position and seed and so does not change when a task runs again.
    """
    positions = F.sequence(F.lit(1).cast("bigint"), F.lit(variants_per_gene * genes).cast("bigint"))
    calls = samples.select("sample_id", F.explode(positions).alias("pos"))
    dose = F.pmod(F.xxhash64("sample_id", "pos", F.lit(seed)), F.lit(2)) + 1
    return calls.select(
        "sample_id",
        F.lit(CHROMOSOME).alias("chr"),
        "pos",
        F.lit(REFERENCE).alias("ref"),
        F.lit(ALTERNATIVE).alias("alt"),
        (F.floor((F.col("pos") - 1) / variants_per_gene) + 1).cast("string").alias("gene_symbol"),
        dose.cast("int").alias("zygosity"),
    )


def write_synthetic_csv(calls: DataFrame, path: str) -> None:
    """Header-less CSV, the format :func:`burdenlens.sources.calls.read_calls_csv` reads."""
    calls.write.mode("overwrite").option("header", False).csv(path)
