"""Line dedup: repeated runs of lines by prefix doubling over line ids, later copies deleted.

The corpus is a sequence of line ids, document after document. Prefix doubling ranks the suffixes of
that sequence by their first 1, 2, 4, ... lines: a rank is the number of suffixes that sort before, and
comes from the counts of distinct pairs of ranks, sorted by range and summed up. So each round is a
suffix array to that depth, held as ranks. Suffixes that no other one equals are left out of further
rounds, as are all that contain them, so the work shrinks to what is repeated.

A run of m lines is an interval of the suffix array in which neighbours have a common prefix of at
least m lines. It is named by the ranks, at the largest power of two not above m, of its first and of
its last lines: two suffixes share the run if and only if both ranks agree. Runs of at least
``min_words`` words are looked at from each line forwards and backwards, as short as possible; every
maximal repeated run of that size is covered by them. The first copy in the corpus stays, and the
lines of later ones are deleted.

Everything is joins, aggregations and range sorts. Counts and first copies are combined before they
are shuffled, so a line in a third of all documents is one row of each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burdenlens.llm.common import kept, running_sum

MIN_WORDS = 50
_WORD = "[^\\x20\\x09-\\x0D]+"
_DOC = ("doc_id", "hash")


def _with_words(text: Column) -> Column:
    """Lines that have words, with their words and their place among all lines."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda x, i: F.struct(x.alias("line"), i.alias("at"), F.regexp_count(x, F.lit(_WORD)).alias("n")),
    )
    return F.filter(lines, lambda x: x["n"] > 0)


def _same(one: DataFrame, other: DataFrame, *names: str) -> Column:
    """Equal names, a null id equal to a null id."""
    return F.expr(" AND ".join(f"a.{n} <=> b.{n}" for n in names))


def _ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows that share their keys with another one, with ``rank``: rows that sort before."""
    classes = rows.groupBy(*keys).agg(F.count("*").alias("same")).where("same > 1")
    sums = running_sum(classes, "same", "end", *keys)
    ranks = sums.select(*keys, (F.col("end") - F.col("same")).alias("rank"))
    return rows.join(ranks, list(keys))


def suffix_ranks(lines: DataFrame, depth: int) -> list[DataFrame]:
    """For 1, 2, 4, ... up to ``depth`` lines: ``doc_id, hash, p, rank`` of all repeated runs.

    ``lines`` has ``doc_id, hash, p, id``. Ranks order the suffixes by so many lines, in the order of
    line ids; runs that occur once have no row.
    """
    place = [*_DOC, "p"]
    levels = [kept(_ranked(lines, "id").select(*place, "rank"))]
    size = 1
    while 2 * size <= depth:
        now = levels[-1]
        later = now.select(*_DOC, (F.col("p") - size).alias("p"), F.col("rank").alias("second"))
        pairs = (
            now.alias("a")
            .join(later.alias("b"), _same(now, later, *place))
            .select(*(f"a.{c}" for c in place), F.col("a.rank").alias("first"), "b.second")
        )
        levels.append(kept(_ranked(pairs, "first", "second").select(*place, "rank")))
        size *= 2
    return levels


def _shortest(lines: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, hash, p, m``: from each line on, and up to each line, the shortest run with enough
    words, if all its lines are among the given ones."""
    doc = Window.partitionBy(*_DOC)
    summed = lines.withColumn("upto", F.sum("n").over(doc.orderBy("p"))).withColumn(
        "before", F.col("upto") - F.col("n")
    )
    ahead = doc.orderBy("before").rangeBetween(0, min_words - 1)
    back = doc.orderBy("upto").rangeBetween(-(min_words - 1), 0)
    runs = summed.select(
        *_DOC,
        "p",
        F.struct(
            F.col("p").alias("p"),
            F.count("*").over(ahead).cast("int").alias("m"),
            F.max("p").over(ahead).alias("end"),
            (F.max("upto").over(ahead) - F.col("before")).alias("words"),
        ).alias("a"),
        F.struct(
            F.min("p").over(back).alias("p"),
            F.count("*").over(back).cast("int").alias("m"),
            F.col("p").alias("end"),
            (F.col("upto") - F.min("before").over(back)).alias("words"),
        ).alias("b"),
    )
    return (
        runs.select(*_DOC, F.explode(F.array("a", "b")).alias("r"))
        .where(f"r.words >= {min_words} AND r.end - r.p + 1 = r.m")
        .select(*_DOC, "r.p", "r.m")
        .distinct()
    )


def later_copies(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, hash, p, m``: runs (first line and number, among lines with words) to delete."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = rows.select(
        "doc_id", F.xxhash64("text").alias("hash"), F.posexplode(_with_words(F.col("text")))
    ).select(
        *_DOC, F.col("pos").alias("p"), F.unhex(F.md5("col.line")).alias("id"), F.col("col.n").alias("n")
    )
    often = lines.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    repeated = kept(lines.join(often, "id", "left_semi").dropDuplicates([*_DOC, "p"]))
    runs = kept(_shortest(repeated, min_words))
    longest = runs.agg(F.max("m")).first()[0]
    if longest is None:
        return runs
    levels = suffix_ranks(repeated.select(*_DOC, "p", "id"), longest)
    ranks = None
    for k, level in enumerate(levels):
        level = level.withColumn("k", F.lit(k))
        ranks = level if ranks is None else ranks.unionByName(level)
    # the largest power of two not above m
    k = F.floor(F.log2(F.col("m").cast("double"))).cast("int")
    named = runs.withColumn("k", k).withColumn(
        "q", (F.col("p") + F.col("m") - F.pow(F.lit(2), F.col("k"))).cast("int")
    )
    first = ranks.withColumnRenamed("rank", "head")
    last = ranks.withColumnRenamed("rank", "tail").withColumnRenamed("p", "q")
    named = (
        named.alias("a")
        .join(first.alias("b"), _same(named, first, *_DOC, "k", "p"))
        .select("a.*", "b.head")
        .alias("a")
        .join(last.alias("b"), _same(named, last, *_DOC, "k", "q"))
        .select("a.*", "b.tail")
    )
    # one interval of the suffix array for each of these keys
    interval = ["m", "head", "tail"]
    place = F.struct(*_DOC, "p")
    firsts = named.groupBy(*interval).agg(F.min(place).alias("first"))
    copies = named.join(firsts, interval).where(~F.col("first").eqNullSafe(place))
    # a copy that overlaps the first one leaves it its lines
    own = F.lit(True)
    for c in _DOC:
        own = own & F.col(c).eqNullSafe(F.col(f"first.{c}"))
    over = F.when(own, F.greatest(F.col("first.p") + F.col("m") - F.col("p"), F.lit(0))).otherwise(0)
    return copies.withColumn("_over", over.cast("int")).select(
        *_DOC, (F.col("p") + F.col("_over")).alias("p"), (F.col("m") - F.col("_over")).alias("m")
    )


def dedup(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of the documents, the text without later copies, and ``n_lines, n_deleted``.

    A run of lines with at least ``min_words`` words that also occurs before, by id, then a hash of
    the text, then position, is deleted; of a run that overlaps its first copy, only the lines beyond
    that one. Lines without words are no part of runs; they stay, except in a
    text of which nothing else is left, which becomes empty. A null text stays null and has no
    lines; an empty one has one line without words. Rows that agree in id and text are one document
    and get the same result, one by one. Columns named n_lines or n_deleted are replaced.
    """
    copies = later_copies(documents, min_words)
    places = F.flatten(
        F.transform(
            "_runs", lambda r: F.transform(F.sequence(F.lit(0), r["m"] - 1), lambda i: r["p"] + i)
        )
    )
    deleted = (
        copies.groupBy(*_DOC)
        .agg(F.collect_list(F.struct("p", "m")).alias("_runs"))  # at most two for each line of a text
        .select(F.col("doc_id").alias("_id"), F.col("hash").alias("_own"), F.array_distinct(places).alias("_gone"))
    )
    hashed = documents.drop("n_lines", "n_deleted").withColumn(
        "_hash", F.xxhash64(F.coalesce("text", F.lit("")))
    )
    joined = hashed.join(
        deleted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_own")), "left"
    )
    every = F.split("text", "\n")
    worded = F.transform(_with_words(F.col("text")), lambda x: x["at"])
    gone = F.transform("_gone", lambda p: F.get(F.col("_worded"), p))
    rest = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_at"))
    left = F.array_join(F.transform(rest, lambda i: F.get(F.col("_lines"), i)), "\n")
    out = (
        joined.withColumn("_lines", F.when(F.col("_gone").isNotNull(), every))
        .withColumn("_worded", F.when(F.col("_gone").isNotNull(), worded))
        .withColumn("_at", gone)
    )
    text = F.when(F.col("_gone").isNull(), F.col("text")).when(
        F.size("_gone") < F.size("_worded"), left
    )
    emptied = F.when(F.col("_gone").isNotNull(), F.lit(""))
    counted = out.withColumn("n_lines", F.coalesce(F.size(every), F.lit(0)).cast("long"))
    return counted.withColumn("text", F.coalesce(text, emptied)).withColumn(
        "n_deleted", F.coalesce(F.size("_gone"), F.lit(0)).cast("long")
    ).select(*hashed.drop("_hash").columns, "n_lines", "n_deleted")
