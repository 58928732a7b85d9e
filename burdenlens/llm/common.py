"""Helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the word rule other than the space itself.
BREAKS = "\t\n\x0b\x0c\r"

#: Bytes of text that one numpy step takes on at a time; longer texts are taken alone.
PIECE_BYTES = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local session without it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def kept(frame: DataFrame) -> DataFrame:
    """The frame, computed once into the shared folder; lost executors do not repeat what came before."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def arrow(frame: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` by tasks that get this package from the driver, wherever they run."""
    context = frame.sparkSession.sparkContext
    if not getattr(context, "_burdenlens_sent", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="package-"), "burdenlens.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for folder, _, files in os.walk(package):
                for file in files:
                    if file.endswith(".py"):
                        full = os.path.join(folder, file)
                        archive.write(full, os.path.relpath(full, os.path.dirname(package)))
        context.addPyFile(path)
        context._burdenlens_sent = True

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds nothing

    return frame.mapInArrow(lean, schema)


def added(frame: DataFrame, field: str) -> str:
    """Schema of the frame with a field at the end; one of that name is replaced."""
    name = field.split()[0].lower()
    return ", ".join([*(f"`{c}` {t}" for c, t in frame.dtypes if c.lower() != name), field])


def replaced(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    """The batch with a column at the end; one of that name is replaced."""
    names = [n for n in batch.schema.names if n.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], [*names, name])


#: Counts in one block of a large array of counts.
BLOCK = 1 << 15


def blocks_of(counts: np.ndarray) -> pa.RecordBatch:
    """Rows of ``block`` and ``counts`` for an array of counts, without the blocks that are all 0."""
    padded = np.zeros(-(-len(counts) // BLOCK) * BLOCK, np.int64)
    padded[: len(counts)] = counts
    some = [(k, c) for k, c in enumerate(padded.reshape(-1, BLOCK)) if c.any()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _ in some], pa.int32()),
            pa.array([c.astype(np.int32).tobytes() for _, c in some], pa.binary()),
        ],
        ["block", "counts"],
    )


def summed(blocks: DataFrame, size: int) -> np.ndarray:
    """The array of ``size`` counts that the blocks of all tasks add up to.

    Blocks are dealt by their number to as many tasks as there are blocks or cores for them, each of
    which holds one array for a block; only the sums, of fixed size, come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            numbers = batch.column("block").to_pylist()
            for block, counts in zip(numbers, batch.column("counts"), strict=True):
                own = np.frombuffer(counts.as_buffer(), np.int32)
                sums[block] = sums.get(block, 0) + own.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sums), pa.int32()),
                    pa.array([c.tobytes() for c in sums.values()], pa.binary()),
                ],
                ["block", "counts"],
            )

    cores = blocks.sparkSession.sparkContext.defaultParallelism
    dealt = blocks.repartition("block").coalesce(min(-(-size // BLOCK), 2 * cores))
    added_up = arrow(dealt, run, "block int, counts binary")
    total = np.zeros(-(-size // BLOCK) * BLOCK, np.int64)
    for row in added_up.toLocalIterator():
        start = row["block"] * BLOCK
        total[start : start + BLOCK] = np.frombuffer(row["counts"], np.int64)
    return total[:size]


def words(text: Column) -> Column:
    """Words of a text, A to Z in lower case; null and blank texts have none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + BREAKS, UPPER.lower() + " " * 5)
    return F.array_remove(F.split(spaced, " "), "")


def numbered(frame: DataFrame, *order: str) -> DataFrame:
    """Rows in the given total order with ``_part``, ``_row`` (place in the part) and ``_number``.

    The order is dealt out by range, so no task sees more than its range; ``_number`` counts from 0
    over all parts. The order must be total for the numbers to be the same in every run.
    """
    ranged = kept(
        frame.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    # one row for each part: as many as there are tasks, whatever the input
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        ranged.join(F.broadcast(starts), "_part")
        .withColumn("_number", F.col("_start") + F.col("_row"))
        .drop("_start")
    )


def running_sum(frame: DataFrame, value: str, to: str, *order: str) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row of a total order, dealt out by range."""
    rows = numbered(frame, *order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    starts = parts.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    local = F.sum(value).over(
        Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn(to, local)
        .join(F.broadcast(starts), "_part")
        .withColumn(to, F.col(to) + F.col("_base"))
        .drop("_base")
    )


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column on end, and their bounds; a null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows so that a piece has ``PIECE_BYTES`` of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = utf8(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            fits = int(np.searchsorted(bounds, bounds[start] + PIECE_BYTES, "right")) - 1
            stop = min(max(fits, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def grams(words: Column, size: int = 5) -> Column:
    """Hashes of all runs of ``size`` words in order; fewer words make one run, none make none.

    ``words`` must be a plain column, as it is read for every run.
    """

    def run(start: Column) -> Column:
        return F.xxhash64(*(F.get(words, start + k) for k in range(size)))

    count = F.greatest(F.size(words) - size, F.lit(0))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), count), run)).otherwise(
        F.array().cast("array<bigint>")
    )
