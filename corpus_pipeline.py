"""A corpus pipeline of five stages over the documents.

Each stage gets what the one before it kept, as a table with the columns of documents. Texts that the
toxicity model rejects go; later copies of repeated runs of lines are cut out, and a document of which
nothing is left goes; of each group of near duplicates the smallest id stays; documents that hold a
benchmark item go; what is left is encoded, decoded and handed on with its ids.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenlens.llm import bpe, decontaminate, jaccard, lines, toxicity
from burdenlens.llm.common import shared_folder
from burdenlens.llm.queries import toxicity_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model of the labelled ones."""
    model = toxicity_model(spark, docs, sf_dir)
    return toxicity.score(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; emptied ones go, ``n_chars`` follows."""
    cut = lines.dedup(docs.select(*COLUMNS)).where("n_deleted = 0 OR text <> ''")
    counted = F.when(F.col("n_deleted") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", counted.cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest id. Repeated rows of an id are one document; rows
    without an id stay only if no group of theirs has one."""
    found = jaccard.groups(docs).where("component_id <=> doc_id")
    stay = found.select(F.col("doc_id").alias("_id")).distinct()
    return docs.select(*COLUMNS).join(stay, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs.select(*COLUMNS), items)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids and whether these decode to the text."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(docs.select(*COLUMNS), ranks), ranks)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.withColumn("round_trip", same).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: The toxicity model is learned, so SQL cannot say the rows; tests/llm/test_pipeline.py checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents.

    What each stage keeps is written as Parquet to the shared folder and read again, so a lost executor
    does not take a run back beyond the stage it is in. Repeated rows stay rows, and an empty table gives
    an empty one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
