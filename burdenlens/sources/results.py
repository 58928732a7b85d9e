"""Analysis results: tables written and read by Spark, and the older positional documents."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burdenlens.functions.display import local_time
from burdenlens.plans.score import analysed_samples, analysis_totals, group_rows, score
from burdenlens.plans.spec import AnalysisSpec
from burdenlens.workspace import stored

STATISTICS = ["score", "pvalue", "ratio_case", "ratio_control", "sum_case", "sum_control"]


# --- tables -------------------------------------------------------------------------------------


def analysis_row(
    ranking: DataFrame,
    totals: DataFrame,
    spec: AnalysisSpec,
    start_epoch: float,
    end_epoch: float,
) -> DataFrame:
    """One row about a finished analysis; ``totals`` has its group sizes and number of tests, which
    a ranking without rows cannot tell."""
    counted = totals.withColumn("n_results", ranking.agg(F.count("*")).scalar())
    return counted.select(
        F.lit(spec.name).alias("analysis_name"),
        F.lit(spec.scale).alias("scale"),
        F.lit(spec.scope).alias("scope"),
        F.timestamp_seconds(F.lit(start_epoch)).alias("start_time"),
        F.timestamp_seconds(F.lit(end_epoch)).alias("end_time"),
        F.round(F.lit(end_epoch - start_epoch), 2).alias("run_time"),
        F.lit(spec.control_name).alias("control_name"),
        F.lit(spec.case_name).alias("case_name"),
        "n_case",
        "n_control",
        "ntests",
        "n_results",
    )


def run_analysis(calls: DataFrame, spec: AnalysisSpec, path: str) -> None:
    """Score and save an analysis as three tables below ``path``: scores, samples and analysis.

    The times of the analysis are those of computing and writing its scores.
    """
    start = time.time()
    rows = group_rows(calls, spec)  # read and shuffle the calls once for all three
    score(calls, spec, rows).write.mode("overwrite").parquet(f"{path}/scores")
    end = time.time()
    analysed_samples(calls, spec, rows).write.mode("overwrite").parquet(f"{path}/samples")
    saved = calls.sparkSession.read.parquet(f"{path}/scores")  # do not score again
    totals = analysis_totals(calls, spec, rows)
    analysis_row(saved, totals, spec, start, end).write.mode("overwrite").parquet(f"{path}/analysis")


def read_analysis(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Analysis, scores and samples of a saved analysis."""
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("analysis", "scores", "samples"))


def write_scores_json(ranking: DataFrame, path: str) -> None:
    """The ranking as JSON lines."""
    ranking.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str, quote_all: bool = True) -> None:
    """A table as CSV with header; ``quote_all=False`` quotes only where CSV needs it."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).csv(path)


# --- documents ----------------------------------------------------------------------------------
# One JSON array per file, by position: name, scale, scope, start, end, run time, scores, case ids,
# control ids, control name, case name and, in newer ones, number of tests.


def document_lines(
    ranking: DataFrame,
    samples: DataFrame,
    totals: DataFrame,
    spec: AnalysisSpec,
    start_epoch: float,
    end_epoch: float,
) -> DataFrame:
    """The document of an analysis, line by line: ``section, position, key, value``.

    Each ranked item and each sample is a line of its own, so no list is ever held in one row and a
    document may be of any size. ``position`` and ``key`` order the lines of a section. A line tells by
    itself what it is, see :func:`read_lines`; controls begin with a space, which JSON does not mind.

    Ranking, samples and totals are stored first: the first line of a section is looked up, and the
    ranges of :func:`write_document` are chosen, by reading them again.
    """
    ranking, samples, totals = stored(ranking, "ranking"), stored(samples, "samples"), stored(totals, "totals")
    keys = [F.col(c) for c in spec.key_columns]
    key = F.to_json(F.array(*keys))
    if spec.scope == "monogenic" and spec.scale == "gene":
        key = _bare(F.to_json(F.array(keys[0])))
    numbers = F.concat_ws(
        ", ", *[F.coalesce(F.col(c).cast("double").cast("string"), F.lit("NaN")) for c in STATISTICS]
    )
    if spec.scope == "digenic":
        numbers = F.concat(F.to_json(F.array(*keys)), F.lit(", "), numbers)
    entry = F.concat(F.lit("["), key, F.lit(", ["), numbers, F.lit("]]"))
    entries = ranking.select((-F.col("score")).cast("double").alias("position"), F.array(*keys).alias("key"), entry.alias("value"))

    def ids(wanted: Column) -> DataFrame:
        name = F.col("sample_id")
        return samples.where(wanted).select(
            F.lit(0.0).alias("position"), F.array(name).alias("key"), _bare(F.to_json(F.array(name))).alias("value")
        )

    def separated(rows: DataFrame, section: int) -> DataFrame:
        """A comma before every line but the first."""
        first = rows.agg(F.min(F.struct("position", "key"))).scalar()
        comma = F.when(F.struct("position", "key").eqNullSafe(first), F.lit("")).otherwise(F.lit(", "))
        lead = F.lit(" " if section == 5 else "")
        return rows.select(
            F.lit(section).alias("section"), "position", "key", F.concat(lead, comma, "value").alias("value")
        )

    def quoted(value: str) -> Column:
        return _bare(F.to_json(F.array(F.lit(value))))

    def line(section: int, value: Column, table: DataFrame | None = None) -> DataFrame:
        one = ranking.sparkSession.range(1) if table is None else table
        empty = F.array().cast("array<string>")
        return one.select(
            F.lit(section).alias("section"),
            F.lit(0.0).alias("position"),
            empty.alias("key"),
            value.alias("value"),
        )

    times = [F.lit(repr(float(t))) for t in (start_epoch, end_epoch, end_epoch - start_epoch)]
    head = F.concat_ws(", ", quoted(spec.name), quoted(spec.scale), quoted(spec.scope), *times)
    tail = F.concat_ws(
        ", ", quoted(spec.control_name), quoted(spec.case_name), F.col("ntests").cast("string")
    )
    return (
        line(0, F.concat(F.lit("["), head, F.lit(", [")))
        .unionByName(separated(entries, 1))
        .unionByName(line(2, F.lit("], [")))
        .unionByName(separated(ids(F.col("is_case")), 3))
        .unionByName(line(4, F.lit("], [")))
        .unionByName(separated(ids(~F.col("is_case")), 5))
        .unionByName(line(6, F.concat(F.lit("], "), tail, F.lit("]")), totals))
    )


def _bare(array: Column) -> Column:
    """The JSON of the only value of an array."""
    return array.substr(F.lit(2), F.length(array) - 2)


def write_document(lines: DataFrame, path: str) -> None:
    """Save a document as a text folder. Lines are dealt out by range and sorted within it, so many
    tasks write, and the files in the order of their names are the document from end to end."""
    order = ["section", "position", "key"]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("value").write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the documents that :func:`write_document` saved in folders: ``file_name, kind, value``
    and the place ``file, block, line`` of a line within its folder, file and split of a file.

    A line is a ``head``, an ``entry``, a ``case``, a ``control``, a ``tail`` or a ``mark`` between
    them, and says so by its first and last signs; so no task needs to see more than its lines.
    """
    text = spark.read.text(path)
    value = F.col("value")
    bare = F.regexp_replace(value, "^ ?(, )?", "")
    kind = (
        F.when(bare == "], [", "mark")
        .when(bare.startswith("["), F.when(bare.endswith(", ["), "head").otherwise("entry"))
        .when(bare.startswith('"'), F.when(value.startswith(" "), "control").otherwise("case"))
        .otherwise("tail")
    )
    place = F.col("_metadata.file_path")
    return text.select(
        _document_name(place).alias("file_name"),
        kind.alias("kind"),
        bare.alias("value"),
        place.alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def line_analyses(lines: DataFrame) -> DataFrame:
    """What :func:`document_analyses` says of documents, without the lists of samples."""

    def only(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("value")))

    counted = lines.groupBy("file_name").agg(
        only("head").alias("head"),
        only("tail").alias("tail"),
        F.count_if(F.col("kind") == "case").alias("n_case"),
        F.count_if(F.col("kind") == "control").alias("n_control"),
        F.count_if(F.col("kind") == "entry").alias("n_results"),
    )
    head = F.from_json(F.concat("head", F.lit("]]")), "array<string>")
    tail = F.from_json(F.concat(F.lit("["), F.col("tail").substr(F.lit(4), F.length("tail"))), "array<string>")
    items = F.concat(F.slice(head, 1, 6), F.array_repeat(F.lit(None).cast("string"), 3), tail)
    known = counted.withColumn("items", items)
    return known.select(*_header(known, F.col("n_case").cast("int"), F.col("n_control").cast("int")), "n_results")


def line_samples(lines: DataFrame) -> DataFrame:
    """The samples of documents, a row each: ``file_name, sample_id, is_case``."""
    listed = lines.where(F.col("kind").isin("case", "control"))
    name = F.get(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>"), F.lit(0))
    return listed.select("file_name", name.alias("sample_id"), (F.col("kind") == "case").alias("is_case"))


def line_scores(lines: DataFrame) -> DataFrame:
    """What :func:`document_scores` says of documents.

    Ranks are numbers of entries: each split of a file is numbered by itself, and what the splits
    before it hold, of which there is one row each, is added.
    """
    about = line_analyses(lines).select(
        F.col("file_name").alias("document"), "analysis_name", "scale", "scope"
    )
    entries = lines.where("kind = 'entry'").select(
        "file_name", "file", "block", "line", F.from_json("value", "array<string>").alias("entry")
    )
    entries = stored(entries, "entries")  # numbers of lines hold for one reading only
    split = ["file_name", "file", "block"]
    counted = entries.groupBy(*split).agg(F.min("line").alias("first"), F.count("*").alias("n"))
    # a row for each split of a document
    before = Window.partitionBy("file_name").orderBy("file", "block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counted.select(
        *split, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start")
    )
    placed = entries.join(starts, split).join(about, F.col("file_name") == F.col("document"))
    return _decoded(placed.withColumn("position", F.col("line") + F.col("start")))


def _document_name(path: Column) -> Column:
    """File name without ending; for a folder Spark wrote, the name of the folder."""
    parts = F.split(path, "/")
    file = F.element_at(parts, -1)
    name = F.when(file.startswith("part-"), F.element_at(parts, -2)).otherwise(file)
    return F.regexp_replace(name, r"\.txt$", "")


def read_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Documents of a folder: ``file_name`` and the ``items`` of the outer array as texts.

    For documents of earlier tools, which are one file and one line; such a document is read as one
    text. What :func:`write_document` saved is read by :func:`read_lines`."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(
        _document_name(F.col("_metadata.file_path")).alias("file_name"),
        F.from_json("value", "array<string>").alias("items"),
    )


def document_analyses(documents: DataFrame) -> DataFrame:
    """One row per document: what the header says, and the sizes of the two groups."""

    def ids(i: int) -> Column:
        return F.from_json(F.get(F.col("items"), F.lit(i)), "array<string>")

    listed = documents.withColumns({"case_ids": ids(7), "control_ids": ids(8)})
    return listed.select(
        *_header(listed, F.size("case_ids"), F.size("control_ids")), "case_ids", "control_ids"
    )


def _header(documents: DataFrame, n_case: Column, n_control: Column) -> list[Column]:
    def item(i: int) -> Column:
        return F.get(documents["items"], F.lit(i))

    return [
        documents["file_name"],
        item(0).alias("analysis_name"),
        item(1).alias("scale"),
        item(2).alias("scope"),
        F.timestamp_seconds(item(3).cast("double")).alias("start_time"),
        F.timestamp_seconds(item(4).cast("double")).alias("end_time"),
        local_time(item(3).cast("double")).alias("start_local"),
        local_time(item(4).cast("double")).alias("end_local"),
        F.round(item(5).cast("double"), 2).alias("run_time"),
        n_case.alias("n_case"),
        n_control.alias("n_control"),
        item(9).alias("control_name"),
        item(10).alias("case_name"),
        item(11).cast("bigint").alias("ntests"),
    ]


def document_scores(documents: DataFrame) -> DataFrame:
    """One row per ranked item of every document, whatever the layout of its scores.

    Three values are score and sums; six are all statistics; seven are a pair and the statistics.
    """
    entries = documents.select(
        "file_name",
        F.get("items", 0).alias("analysis_name"),
        F.get("items", 1).alias("scale"),
        F.get("items", 2).alias("scope"),
        F.posexplode(F.from_json(F.get("items", 6), "array<string>")).alias("position", "entry"),
    ).withColumn("entry", F.from_json("entry", "array<string>"))
    return _decoded(entries)


def _decoded(entries: DataFrame) -> DataFrame:
    """Keys and statistics of entries, whatever their layout; ``position`` counts from 0."""
    parts = entries.select(
        *[c for c in entries.columns if c != "entry"],
        F.get("entry", 0).alias("key"),
        F.from_json(F.get("entry", 1), "array<string>").alias("payload"),
    )
    size = F.size("payload")
    names = F.when(size == 7, F.get("payload", 0)).when(F.col("key").startswith("["), F.col("key"))
    keys = F.coalesce(F.from_json(names, "array<string>"), F.array("key"))
    numbers = F.transform(
        F.when(size == 7, F.slice("payload", 2, 6)).otherwise(F.col("payload")),
        lambda text: text.try_cast("double"),
    )
    decoded = parts.select("*", keys.alias("keys"), numbers.alias("numbers"))
    short = F.size("numbers") == 3
    places = {name: i for i, name in enumerate(STATISTICS)}
    in_short = {"score": 0, "sum_case": 1, "sum_control": 2}

    def statistic(name: str) -> Column:
        full = F.get("numbers", places[name])
        if name in in_short:
            return F.when(short, F.get("numbers", in_short[name])).otherwise(full)
        return F.when(~short, full)

    return decoded.select(
        "file_name",
        "analysis_name",
        "scale",
        "scope",
        (F.col("position") + 1).cast("long").alias("rank"),
        F.get("keys", 0).alias("key1"),
        F.get("keys", 1).alias("key2"),
        *[statistic(name).alias(name) for name in STATISTICS],
    )


def list_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Names of the analyses stored in a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(_document_name(F.col("path")).alias("file_name")).distinct()
