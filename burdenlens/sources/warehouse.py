"""Calls and phenotypes derived from order/line-item warehouse tables.

Customers play the samples, parts the variants and part families the genes. It gives the queries
and benchmarks a call table that grows with the given data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The columns read, so that no job has to look the schema up first.
_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double,"
    " l_discount double, l_tax double, l_returnflag string, l_linestatus string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per line item."""
    line = _read(spark, sf_dir, "lineitem")
    orders = _read(spark, sf_dir, "orders")
    part = _read(spark, sf_dir, "part")
    customer = _read(spark, sf_dir, "customer")
    # orders of the customers first: a condition on these then leaves fewer line items to shuffle again
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = line.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    base = F.pmod("l_partkey", F.lit(4)).cast("int") + 1
    state = (
        F.when(F.col("o_orderstatus") == "F", "PASS")
        .when(F.col("o_orderstatus") == "O", "my_snp_filter")
        .otherwise("my_indel_filter")
    )
    level = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "HIGH")
        .when(F.col("o_orderpriority") == "2-HIGH", "MODERATE")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "LOW")
        .otherwise("MODIFIER")
    )
    return joined.select(
        F.col("o_custkey").cast("string").alias("sample_id"),
        F.concat(F.lit("chr"), (F.pmod("l_partkey", F.lit(22)) + 1).cast("string")).alias("chr"),
        F.col("l_partkey").alias("pos"),
        F.substring(F.lit("ACGT"), base, F.lit(1)).alias("ref"),
        F.substring(F.lit("CGTA"), base, F.lit(1)).alias("alt"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("zygosity"),
        F.col("l_quantity").cast("int").alias("read_depth"),
        (60 + 5 * F.col("l_linenumber")).alias("genotype_quality"),
        state.alias("filters"),
        F.concat_ws("/", "p_brand", "p_type").alias("gene_symbol"),
        F.col("p_type").alias("gene_ensembl"),
        F.when(F.col("l_discount") != 0.05, F.col("l_discount")).alias("consensus_maf"),
        F.nullif(F.col("l_returnflag"), F.lit("A")).alias("snpeff_effect"),
        level.alias("snpeff_impact"),
        F.concat(F.lit("rs"), F.col("l_partkey").cast("string")).alias("dbsnp_id"),
        F.col("p_size").cast("double").alias("cadd_phred"),
        (F.col("l_tax") * 100).alias("variant_confidence_by_depth"),
        F.col("c_mktsegment").alias("pathology"),
    )


def customer_phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One phenotype row per customer."""
    customer = _read(spark, sf_dir, "customer")
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return joined.select(
        F.col("r_name").alias("Data_Source"),
        F.col("c_custkey").cast("string").alias("Sample_ID"),
        F.col("c_mktsegment").alias("Pathology"),
        F.when(F.pmod("c_custkey", F.lit(2)) == 0, "F").otherwise("M").alias("Gender"),
        F.col("n_name").alias("Super_Population"),
    )
