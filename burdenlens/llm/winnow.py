"""Document fingerprints by winnowing.

Hashes of all runs of five words roll over the text; of every four neighbouring ones the smallest is
kept, the rightmost of equal ones, with its position. Any run of eight words that two texts share is
therefore seen in both fingerprints, whatever stands around it. A hash and its position are packed into
one number so that the smallest number is the smallest hash at the rightmost position.

A fingerprint needs one text only, so no data moves for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burdenlens.llm.common import grams, words

RUN, WINDOW = 5, 4
_PLACES = (1 << 31) - 1


def fingerprint(text: Column, frame: DataFrame, to: str) -> DataFrame:
    """The frame with ``to``: ``array<bigint>`` of packed hashes and positions, in text order.

    ``hashes`` and ``positions`` take it apart. Texts of fewer than five words have one run; texts
    without words, and null, have an empty fingerprint.
    """
    packed = F.transform(
        "_grams",
        lambda h, i: F.shiftleft(h.bitwiseAND(0xFFFFFFFF), 31).bitwiseOR(F.lit(_PLACES) - i),
    )
    last = F.greatest(F.size("_packed") - WINDOW, F.lit(0))
    least = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.least(*(F.get("_packed", i + k) for k in range(WINDOW))),
    )
    kept = F.when(F.size("_packed") > 0, F.array_distinct(least)).otherwise(
        F.array().cast("array<bigint>")
    )
    return (
        frame.withColumn("_words", words(text))
        .withColumn("_grams", grams(F.col("_words"), RUN))
        .drop("_words")
        .withColumn("_packed", packed)
        .drop("_grams")
        .withColumn(to, kept)
        .drop("_packed")
    )


def hashes(print_: Column) -> Column:
    return F.array_distinct(F.transform(print_, lambda x: F.shiftright(x, 31)))


def positions(print_: Column) -> Column:
    return F.transform(print_, lambda x: F.lit(_PLACES) - x.bitwiseAND(_PLACES))


def likeness(one: Column, other: Column) -> Column:
    """Share of all hashes of two fingerprints that both hold; 1 if both are empty."""
    both = F.size(F.array_intersect(hashes(one), hashes(other)))
    every = F.size(F.array_union(hashes(one), hashes(other)))
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def with_next(documents: DataFrame, *carried) -> DataFrame:
    """``doc_id, text`` (null as empty), ``carried(frame)`` columns and ``next_*`` of all of them.

    The next document is the next larger id; rows of one id follow each other by a hash of their
    text; after the last comes the first. Ids are dealt into ranges of about equal counts, and the
    first document of each range goes to the range before it as well, so only neighbours meet.
    """
    spark = documents.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    steps = [k / ranges for k in range(1, ranges)]
    bounds = documents.agg(F.percentile_approx("doc_id", steps, 10 * ranges)).first()[0] or []
    bounds = F.array(*(F.lit(b) for b in sorted(set(bounds)))) if bounds else F.array()
    place = F.size(F.filter(bounds.cast("array<bigint>"), lambda b: b < F.col("doc_id")))
    placed = rows.withColumn("_hash", F.xxhash64("text")).withColumn(
        "_range", F.coalesce(F.greatest(place, F.lit(0)), F.lit(0))
    )
    key = F.struct("doc_id", "_hash")
    before = Window.orderBy("_range")  # one row for each range
    firsts = placed.groupBy("_range").agg(F.min(key).alias("_first"))
    lasts = firsts.withColumn(
        "_before",
        F.coalesce(F.lag("_range").over(before), F.max("_range").over(Window.partitionBy())),
    )
    given = F.when(
        F.col("_first").eqNullSafe(key),
        F.array(
            F.struct(F.col("_range").alias("r"), F.lit(False).alias("g")),
            F.struct(F.col("_before").alias("r"), F.lit(True).alias("g")),
        ),
    ).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("g"))))
    dealt = (
        placed.join(F.broadcast(lasts), "_range")
        .withColumn("_to", F.explode(given))
        .select("doc_id", "text", "_hash", F.col("_to.r").alias("_range"), F.col("_to.g").alias("_given"))
    )
    order = ["_range", "_given", "doc_id", "_hash"]
    ordered = dealt.repartition("_range").sortWithinPartitions(*order)
    names = ["doc_id", "text"]
    for add, name in carried:
        ordered = add(ordered)
        names.append(name)
    window = Window.partitionBy("_range").orderBy(*order[1:])
    nexts = [F.lead(n).over(window).alias(f"next_{n}") for n in names]
    return ordered.select(*names, "_given", *nexts).where(~F.col("_given")).drop("_given")


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, text, edited`` and the fingerprints ``print, edited_print, next_print``.

    ``edited`` is the text with its last half (code points, rounded down) replaced by as much of the
    next document's beginning, or all of it. Null texts are empty; repeated rows follow each other; a
    single document is its own next one. Other columns are left out.
    """
    paired = with_next(documents, (lambda f: fingerprint(F.col("text"), f, "print"), "print"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.char_length("text") - half)
    edited = paired.withColumn("edited", F.concat(kept, F.substring("next_text", F.lit(1), half)))
    return fingerprint(F.col("edited"), edited.drop("next_text", "next_doc_id"), "edited_print")
