"""Variant-call tables: readers, registration and writers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from burdenlens.schema import SCORING_SCHEMA, canonical_calls
from burdenlens.workspace import stored


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """A call table in Parquet, its text being text whatever the writer made of it.

    Old files keep their text as plain binary, which is cast; and a chromosome that is a directory
    name is read as text, so that 01 does not become 1. No setting of the session is touched.
    """
    found = spark.read.parquet(path).schema
    in_files = spark.read.option("recursiveFileLookup", True).parquet(path).columns
    fields = [
        f if f.name in in_files else StructField(f.name, StringType()) for f in found.fields
    ]
    calls = spark.read.schema(StructType(fields)).parquet(path)
    text = {
        f.name: F.col(f"`{f.name}`").cast("string")
        for f in fields
        if isinstance(f.dataType, BinaryType)
    }
    return canonical_calls(calls.withColumns(text))


def read_calls_csv(
    spark: SparkSession, path: str, partitions: int | None = None, schema=SCORING_SCHEMA
) -> DataFrame:
    """A header-less call table in CSV, read with an explicit schema."""
    calls = canonical_calls(spark.read.schema(schema).csv(path))
    return calls if partitions is None else calls.repartition(partitions)


def read_calls_table(spark: SparkSession, name: str) -> DataFrame:
    """A call table of the session's catalog (warehouse table or view)."""
    return canonical_calls(spark.table(name))


#: Calls of one bucket, about: a task sorts them, and another groups them when they are read.
BUCKET_ROWS = 1 << 20


def write_calls_table(
    calls: DataFrame, name: str, path: str, buckets: int, bucket_rows: int = BUCKET_ROWS
) -> None:
    """Store a call table in the catalog, laid out for repeated analyses: rows of a gene and sample are
    in one of so many buckets, sorted.

    Rankings, burdens and frequencies group by gene and sample first, and find rows where they need
    them. A gene with a third of all calls is spread over all buckets by its samples. ``buckets`` is the
    least number: a table with more than ``bucket_rows`` calls for each has more of them, so that no task
    grows with the table. The calls are stored once before, and counted there.
    """
    calls = stored(calls, "calls")
    buckets = max(buckets, math.ceil(calls.count() / bucket_rows))
    dealt = calls.repartition(buckets, "gene_symbol", "sample_id")  # one file a bucket
    writer = dealt.write.mode("overwrite").bucketBy(buckets, "gene_symbol", "sample_id")
    writer.sortBy("gene_symbol", "sample_id").option("path", path).saveAsTable(name)


def read_calls_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
    **options: str,
) -> DataFrame:
    """A call table behind JDBC; with a partition column it is read by many tasks at once."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column is not None:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    return canonical_calls(reader.options(**options).load())


def register(calls: DataFrame, name: str = "variants") -> DataFrame:
    """Make a table visible to SQL under a name."""
    calls.createOrReplaceTempView(name)
    return calls


def write_calls(calls: DataFrame, path: str) -> None:
    """Store a call table as Parquet in one directory per chromosome.

    Rows are rebalanced by chromosome, so adaptive execution writes files of even size however
    unequal the chromosomes are, and sorted by gene within a file, so a gene panel or a drill-down
    skips row groups.
    """
    balanced = calls.hint("rebalance", "chr").sortWithinPartitions("chr", "gene_symbol", "pos")
    balanced.write.mode("overwrite").partitionBy("chr").parquet(path)


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """Gene symbols of a text file, one per line; use with
    :func:`burdenlens.operators.filters.keep_listed`."""
    lines = spark.read.text(path).select(F.trim("value").alias("gene_symbol"))
    return lines.where(F.col("gene_symbol") != "").distinct()
