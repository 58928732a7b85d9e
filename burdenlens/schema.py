"""Column contracts of the call, phenotype and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns a browse query returns, with the types we read them as.
BROWSE_FIELDS: dict[str, T.DataType] = {
    "sample_id": T.StringType(),
    "chr": T.StringType(),
    "pos": T.LongType(),
    "ref": T.StringType(),
    "alt": T.StringType(),
    "zygosity": T.IntegerType(),
    "read_depth": T.IntegerType(),
    "genotype_quality": T.IntegerType(),
    "filters": T.StringType(),
    "gene_symbol": T.StringType(),
    "gene_ensembl": T.StringType(),
    "consensus_maf": T.DoubleType(),
    "consensus_mac": T.LongType(),
    "snpeff_effect": T.StringType(),
    "snpeff_impact": T.StringType(),
    "allelic_depth_proportion_ref": T.DoubleType(),
    "allelic_depth_proportion_alt": T.DoubleType(),
    "downsampled": T.BooleanType(),
    "mapping_quality_zero_reads": T.IntegerType(),
    "allele_num": T.IntegerType(),
    "change_type": T.StringType(),
    "transcript_ensembl": T.StringType(),
    "num_genes": T.IntegerType(),
    "clinvar_rs": T.StringType(),
    "dbsnp_id": T.StringType(),
    "cadd_phred": T.DoubleType(),
    "cadd_raw": T.DoubleType(),
    "vest_score": T.DoubleType(),
    "pph2_hdiv_score": T.DoubleType(),
    "pph2_hdiv_pred": T.StringType(),
    "pph2_hvar_score": T.DoubleType(),
    "pph2_hvar_pred": T.StringType(),
    "sift_score": T.DoubleType(),
    "sift_pred": T.StringType(),
    "short_tandem_repeat": T.BooleanType(),
    "variant_confidence_by_depth": T.DoubleType(),
}

#: The seven columns scoring reads; everything else in a call table is only there to be filtered on.
SCORING_FIELDS = ["sample_id", "chr", "pos", "ref", "alt", "gene_symbol", "zygosity"]

CALL_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in BROWSE_FIELDS.items()])

#: Schema of a header-less scoring CSV.
SCORING_SCHEMA = T.StructType([CALL_SCHEMA[n] for n in SCORING_FIELDS])

# Column names of earlier table generations and what they are called now.
RENAMES = {
    "patient": "sample_id",
    "position": "pos",
    "reference": "ref",
    "alternative": "alt",
}

# The phenotype table.
PHENOTYPE_FIELDS = ["Data_Source", "Sample_ID", "Pathology", "Gender", "Super_Population"]
PHENOTYPE_SCHEMA = T.StructType([T.StructField(n, T.StringType(), True) for n in PHENOTYPE_FIELDS])


def canonical_calls(df: DataFrame) -> DataFrame:
    """Bring any generation of call table to the current column names.

    Names are lower-cased, earlier names replaced, and a table that only carries
    ``gene_ensembl`` is scored by that column. Types are kept as read: ``zygosity`` may be
    the string or the integer coding, see :func:`burdenlens.functions.keys.genotype_dose`.
    """
    lowered = [c.lower() for c in df.columns]
    renamed = [RENAMES.get(c, c) if RENAMES.get(c) not in lowered else c for c in lowered]
    out = df.toDF(*renamed)
    if "gene_symbol" not in renamed and "gene_ensembl" in renamed:
        out = out.withColumn("gene_symbol", F.col("gene_ensembl"))
    return out


def scoring_projection(calls: DataFrame) -> DataFrame:
    """The seven scoring columns."""
    return calls.select(*SCORING_FIELDS)


def browse_projection(calls: DataFrame) -> DataFrame:
    """All browse columns the table has, in their fixed order."""
    present = set(calls.columns)
    return calls.select(*[c for c in BROWSE_FIELDS if c in present])


def choose_columns(df: DataFrame, columns: dict[str, str] | list[str]) -> DataFrame:
    """Select columns by name, or by ``{column: display name}``."""
    if isinstance(columns, dict):
        return df.select(*[F.col(f"`{c}`").alias(label) for c, label in columns.items()])
    return df.select(*[F.col(f"`{c}`") for c in columns])
