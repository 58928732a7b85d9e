"""Benchmark decontamination: MinHash containment search with size-partitioned sketches.

A test item is found in a document if the document holds at least 75 % of the item's distinct runs of
five words. Items are partitioned by the number of their runs, in powers of two. An item's sketch is
its runs with the smallest hashes (bottom-k MinHash); the length is set for each partition so that a
document which lacks every run of the sketch lacks more than a quarter of the item. So the search
misses nothing, whatever the length of the document, and needs no sketch of the documents: their runs
are looked up in the index of sketches. Exact containment of the words themselves decides.

The index is broadcast only while its counted size allows; beyond that it is joined by hash. A pair of
document and item is one row, so a passage in a third of all documents makes as many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burdenlens.llm.common import grams, words

RUN, PERCENT = 5, 75
#: Rows of the index of sketches up to which it is broadcast: 16 bytes each.
BROADCAST_ROWS = 200_000


def _spelled(words_, size: int = RUN):
    """Distinct runs of words as text; fewer words make one run."""
    count = F.greatest(F.size(words_) - size, F.lit(0))
    runs = F.transform(
        F.sequence(F.lit(0), count), lambda i: F.array_join(F.slice(words_, i + 1, size), " ")
    )
    return F.when(F.size(words_) > 0, F.array_distinct(runs)).otherwise(
        F.array().cast("array<string>")
    )


def _lost(size):
    """Runs an item of this many may lack, plus one: the sketch that no match can miss."""
    return size - F.ceil(size * PERCENT / 100) + 1


def sketches(items: DataFrame) -> DataFrame:
    """``item_id, hash``: the index, one row for each run of each item's sketch."""
    hashed = (
        items.select("item_id", words(F.col("text")).alias("words"))
        .select("item_id", F.sort_array(F.array_distinct(grams(F.col("words")))).alias("runs"))
        .where("size(runs) > 0")
    )
    # partition of the size: up to the next power of two, whose need covers every size in it
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.size("runs").cast("double")))).cast("int")
    length = _lost(upper).cast("int")
    return hashed.select("item_id", F.explode(F.slice("runs", F.lit(1), length)).alias("hash"))


def contained(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment`` of every item found in a document.

    Items or documents without words (null or empty texts) are never found or matched. Items of fewer
    than five words are one run and are found in texts of exactly these words. Repeated rows of either
    table make one pair; of rows with one id the largest overlap counts. A null id is an id of its
    own. Other columns are left out.
    """
    index = sketches(items).distinct()
    if index.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    hashes = documents.select("doc_id", words(F.col("text")).alias("words")).select(
        "doc_id", F.explode(grams(F.col("words"))).alias("hash")
    )
    candidates = hashes.join(index, "hash").select("doc_id", "item_id").distinct()
    spelled = (
        items.select("item_id", words(F.col("text")).alias("words"))
        .select(F.col("item_id").alias("_item"), _spelled(F.col("words")).alias("item_runs"))
        .distinct()
    )
    pairs = candidates.join(spelled, F.col("item_id").eqNullSafe(F.col("_item")))
    texts = documents.select(F.col("doc_id").alias("_doc"), "text")
    held = (
        pairs.join(texts, F.col("doc_id").eqNullSafe(F.col("_doc")))
        .select("doc_id", "item_id", "item_runs", words(F.col("text")).alias("words"))
        .select("doc_id", "item_id", "item_runs", _spelled(F.col("words")).alias("runs"))
    )
    counted = held.select(
        "doc_id",
        "item_id",
        F.size("item_runs").cast("long").alias("n_item"),
        F.size(F.array_intersect("item_runs", "runs")).cast("long").alias("n_shared"),
    )
    best = counted.groupBy("doc_id", "item_id").agg(
        F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_item", "n_shared")).alias("b")
    )
    return best.select("doc_id", "item_id", "b.n_item", "b.n_shared").where(
        f"100 * n_shared >= {PERCENT} * n_item"
    ).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all columns, in whose text no item was found; a null id is kept apart as above."""
    found = contained(documents, items).select(F.col("doc_id").alias("_found")).distinct()
    return documents.join(found, F.col("doc_id").eqNullSafe(F.col("_found")), "left_anti")
