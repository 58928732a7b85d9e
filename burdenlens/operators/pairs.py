"""Pairs of items (genes or variants) carried together by the same sample."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burdenlens.operators.frequency import ratio
from burdenlens.workspace import stored

#: Samples of one group that share a row when samples are packed, 64 to a word.
WORDS = 8
CELL = 64 * WORDS
#: A sample (or cell) with more items than this is spread over several join keys.
SPLIT_ABOVE = 1024
#: Samples are numbered within hash buckets of about this size, so no task numbers them all.
_BUCKET = 16 * CELL
#: Items of the first block of a cut ranking; each further block ends at so many times as many items.
LEADING = 1000
GROWTH = 4
#: Rows that a core forms in about the time of a round; a cut ranking that forms an eighth of that from
#: both groups looks at all pairs.
FEW = 1 << 20
#: Rows of pairs that a task adds up, and carriers of an item above which its pairs go to several tasks.
PER_TASK, HOT = 1 << 20, 1 << 12


class Extent(NamedTuple):
    """Counts of a table of (item, sample) rows."""

    samples: int
    items: int
    most: int  # items of one sample
    by_sample: float  # rows a join sample by sample forms, twice that
    by_cell: float  # the same, at most, for packed samples

    @property
    def to_form(self) -> float:
        """Rows the cheaper way forms, about."""
        return min(self.by_sample, self.by_cell) / 2


def measure(carrying: DataFrame, item: str) -> Extent:
    """The extent of a stored table, by two small aggregations at once."""
    n_items = F.col("n_items")
    by_sample = _items_per_sample(carrying).agg(
        F.struct(
            F.count("*"),
            F.coalesce(F.max(n_items), F.lit(0)),
            F.coalesce(F.sum(n_items.cast("double") * n_items), F.lit(0.0)),
        )
    )
    by_item = carrying.select(item).distinct().agg(F.count("*"))
    one = carrying.sparkSession.range(1)
    (samples, most, squares), items = one.select(by_sample.scalar(), by_item.scalar()).head()
    return Extent(samples, items, most, squares, (samples / CELL + 2.0) * items * items)


def shared_carriers(
    carrying: DataFrame,
    item: str,
    first: str,
    second: str,
    packed: bool | None = None,
    split_above: int = SPLIT_ABOVE,
    extent: Extent | None = None,
) -> DataFrame:
    """Number of samples per group that carry both members of a pair.

    ``carrying`` holds one row per (item, sample), each sample being in one group; it is read
    several times and should be a stored table. Every pair with at least one common carrier comes
    out once, as ``first > second``, with ``sum_case`` and ``sum_control``.

    Pairs are the result here, so they have to be formed; they are formed by an equi-join, so that
    pairs nobody shares cost nothing, and are added up map-side before they are shuffled.

    * Where samples carry a large part of all items, joining sample by sample would form each pair
      once per common carrier. There, 512 samples of a group are packed into one cell, one bit
      each: a pair is then formed once per cell and its common carriers are counted by
      ``bit_count(a & b)``. The extent of the table (see :func:`measure`) tells which way forms
      fewer rows; ``packed`` forces one.
    * A sample or cell with many items is cut into blocks of about ``split_above`` items and
      joined block by block, under the key (sample, higher block, lower block). One sample holding
      a large part of all rows is thus worked on by many tasks, and no pair is lost or counted
      twice. Blocks are only joined with themselves and with lower ones, so each pair of items of
      different blocks is formed once.

    An unknown item (NULL) is an item of its own, smaller than any other, the empty name included.
    """
    named = F.struct(
        F.col(item).isNotNull().alias("known"), F.coalesce(F.col(item), F.lit("")).alias("name")
    )
    carrying = carrying.select(named.alias("item"), "sample_id", "in_case")
    samples = _items_per_sample(carrying)
    extent = extent or measure(carrying, "item")
    if packed is None:
        packed = extent.by_cell < extent.by_sample
    if packed:
        unit = ["in_case", "bucket", "cell"]
        words = [f"w{k}" for k in range(WORDS)]
        rows = _packed(carrying, samples, extent.samples, unit, words, ["item"])
        blocks = F.lit(max(1, math.ceil(extent.items / split_above)))
        common = F.expr(" + ".join(f"bit_count(a_{w} & b_{w})" for w in words))
    else:
        unit, words, rows = ["sample_id", "in_case"], [], carrying
        blocks, common = F.lit(1), F.lit(1)
        if extent.most > split_above:
            rows, blocks = _with_blocks(rows, samples, split_above), F.col("blocks")
    block = F.pmod(F.xxhash64("item"), blocks).cast("int")
    left = rows.select(
        F.col("item").alias("x"),
        *unit,
        block.alias("block1"),
        F.explode(F.sequence(F.lit(0), block)).alias("block2"),
        *[F.col(w).alias(f"a_{w}") for w in words],
    )
    right = rows.select(
        F.col("item").alias("y"),
        *unit,
        F.explode(F.sequence(block, blocks.cast("int") - 1)).alias("block1"),
        block.alias("block2"),
        *[F.col(w).alias(f"b_{w}") for w in words],
    )
    together = (
        left.join(right, [*unit, "block1", "block2"])
        .where("block1 > block2 OR x > y")
        .select(
            F.greatest("x", "y").alias("x"),
            F.least("x", "y").alias("y"),
            "in_case",
            common.cast("bigint").alias("n"),
        )
        .where("n > 0")
    )
    summed = together.groupBy("x", "y").agg(
        F.sum(F.when(F.col("in_case"), F.col("n")).otherwise(0)).alias("sum_case"),
        F.sum(F.when(F.col("in_case"), 0).otherwise(F.col("n"))).alias("sum_control"),
    )
    return summed.select(
        F.when(F.col("x.known"), F.col("x.name")).alias(first),
        F.when(F.col("y.known"), F.col("y.name")).alias(second),
        "sum_case",
        "sum_control",
    )


class _Bound(NamedTuple):
    """The last item of a block, in the order of falling case carriers, then id."""

    n_case: int
    id: int

    def holds(self, n_case: str = "n_case", id: str = "id") -> Column:
        own, key = F.col(n_case), F.col(id)
        return (own > self.n_case) | ((own == self.n_case) & (key <= self.id))


def best_pairs(
    carrying: DataFrame,
    item: str,
    first: str,
    second: str,
    n_case: int,
    n_control: int,
    top_k: int,
    above: float | None = None,
    packed: bool | None = None,
    split_above: int = SPLIT_ABOVE,
    leading: int | None = None,
) -> DataFrame | None:
    """The pairs that can be among the ``top_k`` by difference of shares, ties included.

    As :func:`shared_carriers`, but only of pairs that score at least as the ``top_k``-th best does.
    None if these cannot be told without forming all pairs: fewer score 0 or more, and those below 0
    (``above`` is None or negative) are asked for as well.

    No pair scores above its share of the cases, and that is no larger than the share of either member.
    So items are dealt into blocks by falling case share, and pairs are formed block by block: those of
    an item of the block with any before it. What the best pairs found so far score bounds what is left
    to do, in three ways: pairs count their common controls only if their cases alone reach that score;
    a block takes only items whose case share reaches it; and the rounds end when no item outside does.
    A round costs a few jobs, so one round takes all items where case carriers form few pairs.

    Items without a case carrier are in no pair that scores 0 or more, and are left out from the start.
    Common controls are looked up pair by pair, or by joining control carriers of the block where that
    forms fewer rows.
    """
    spark = carrying.sparkSession
    positive = above is not None and above >= 0
    if top_k < 1:
        return None
    named = F.struct(
        F.col(item).isNotNull().alias("known"), F.coalesce(F.col(item), F.lit("")).alias("name")
    )
    rows = carrying.select(named.alias("item"), "sample_id", "in_case")
    counted = rows.groupBy("item").agg(F.count_if("in_case").alias("n_case"))
    items = stored(
        counted.where("n_case > 0").withColumn("id", F.monotonically_increasing_id()), "items"
    )
    placed = stored(
        rows.join(items, "item").select("id", "n_case", "sample_id", "in_case"), "placed"
    )
    cases, controls = _units(placed, items.count(), packed, split_above)
    shares = ratio(F.col("sum_case"), F.lit(n_case))
    score = shares - ratio(F.col("sum_control"), F.lit(n_control))

    def scored(pairs: DataFrame, n: int) -> DataFrame:
        out = controls.counted(pairs, n, done, bound).withColumn("score", score)
        return out if above is None else out.where(F.col("score") > above)

    def kth(pairs: DataFrame) -> float:
        """What the ``top_k``-th best scores; -infinity where there are fewer."""
        best = pairs.select("score").orderBy(F.desc("score")).limit(top_k)
        reached, worst = best.agg(F.count("*"), F.min("score")).head()
        return worst if reached == top_k else -math.inf

    found, done, least = None, None, -math.inf  # the last item taken so far, the score to reach
    at_once = FEW * spark.sparkContext.defaultParallelism
    size = leading or (LEADING if cases.extent.to_form > at_once else None)
    while True:
        bound = _next_bound(items, done, size, ratio(F.col("n_case"), F.lit(n_case)) >= least)
        if bound is None:
            break
        new = cases.pairs(done, bound).withColumnRenamed("n", "sum_case").where(shares >= least)
        new = stored(new, "case-pairs")
        if least == -math.inf:  # bound it by the pairs with most cases
            least = kth(stored(scored(new.orderBy(F.desc("sum_case")).limit(top_k), top_k), "scored"))
            new = new.where(shares >= least)
        found_now = scored(new, new.count())
        found = found_now if found is None else found.unionByName(found_now)
        if size is None:
            break
        found = stored(found, "scored")
        least = max(least, kth(found))
        found = found.where(F.col("score") >= least)
        done, size = bound, size * GROWTH
    if not positive and least < 0:
        return None
    if found is None:
        found = spark.createDataFrame([], "x bigint, y bigint, sum_case bigint, sum_control bigint")
    for end in ("x", "y"):
        names = items.select(F.col("id").alias(end), F.col("item").alias(f"{end}_item"))
        found = found.join(names, end)
    upper, lower = F.greatest("x_item", "y_item"), F.least("x_item", "y_item")
    return found.select(upper.alias("a"), lower.alias("b"), "sum_case", "sum_control").select(
        F.when(F.col("a.known"), F.col("a.name")).alias(first),
        F.when(F.col("b.known"), F.col("b.name")).alias(second),
        "sum_case",
        "sum_control",
    )


class _Units(NamedTuple):
    """Carriers of one group: a row for each item and sample, or for each item and cell of samples."""

    rows: DataFrame  # id, n_case, unit columns, blocks and words
    unit: list[str]
    words: list[str]
    extent: Extent
    carriers: int

    def _common(self) -> Column:
        if not self.words:
            return F.lit(1).cast("bigint")
        return F.expr(" + ".join(f"bit_count(a_{w} & b_{w})" for w in self.words)).cast("bigint")

    def pairs(self, done: _Bound | None, bound: _Bound) -> DataFrame:
        """``x, y, n``: common carriers of the items of a block with each other and those before."""
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
        rows = self.rows.where(bound.holds())
        left = rows if done is None else rows.where(~done.holds())
        x = left.select(
            F.col("id").alias("x"), F.col("n_case").alias("x_case"), *self.unit,
            own.alias("block1"), every.alias("block2"), *[F.col(w).alias(f"a_{w}") for w in self.words],
        )
        y = rows.select(
            F.col("id").alias("y"), F.col("n_case").alias("y_case"), *self.unit,
            every.alias("block1"), own.alias("block2"), *[F.col(w).alias(f"b_{w}") for w in self.words],
        )
        if not self.words:
            return self._pairs_of_lists(x, y)
        met = x.join(y, [*self.unit, "block1", "block2"]).where(
            "y_case > x_case OR (y_case = x_case AND y < x)"
        )
        common = met.select("x", "y", self._common().alias("n")).where("n > 0")
        return common.groupBy("x", "y").agg(F.sum("n").alias("n"))

    def _pairs_of_lists(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """The same for single samples, where few pairs have a second common carrier.

        Adding them up before the shuffle would hold, and spill, nearly every one. So what is shuffled is
        a list for each item and sample: the other items it forms pairs with. Lists are dealt by item, those
        of an item with many carriers by parts of the other items, and only there laid out and added up,
        about ``PER_TASK`` rows in a task.
        """
        keys = [*self.unit, "block1", "block2"]
        others = y.groupBy(*keys).agg(F.collect_list(F.struct("y_case", "y")).alias("ys"))
        before = "filter(ys, o -> o.y_case > x_case OR (o.y_case = x_case AND o.y < x))"
        lists = x.join(others, keys).select(
            "x", F.expr(f"transform({before}, o -> o.y)").alias("ys"), F.expr(f"int(x_case div {HOT}) + 1").alias("parts")
        )
        lists = lists.where("size(ys) > 0")
        dealt = lists.select("x", "ys", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        own = F.expr("if(parts = 1, ys, filter(ys, o -> pmod(xxhash64(o), parts) = part))")
        tasks = max(math.ceil(self.extent.to_form / PER_TASK), x.sparkSession.sparkContext.defaultParallelism)
        lists = dealt.select("x", "part", own.alias("ys")).repartition(tasks, "x", "part")
        laid_out = lists.select("x", "part", F.explode("ys").alias("y"))
        return laid_out.groupBy("x", "part", "y").agg(F.count("*").alias("n")).select("x", "y", "n")

    def counted(
        self, pairs: DataFrame, n_pairs: int, done: _Bound | None, bound: _Bound
    ) -> DataFrame:
        """Adds ``sum_control``, the common carriers of this group, to pairs of a block."""
        if self.words:
            rows_of_item = self.extent.samples / CELL + 1
        else:
            rows_of_item = self.carriers / max(self.extent.items, 1)
        if n_pairs * rows_of_item > self.extent.to_form:
            common = self.pairs(done, bound)
        else:
            a, b = ([F.col(w).alias(f"{c}_{w}") for w in self.words] for c in "ab")
            x = self.rows.select(F.col("id").alias("x"), *self.unit, *a)
            y = self.rows.select(F.col("id").alias("y"), *self.unit, *b)
            met = pairs.select("x", "y").join(x, "x").join(y, ["y", *self.unit])
            common = met.groupBy("x", "y").agg(F.sum(self._common()).alias("n"))
        both = pairs.join(common, ["x", "y"], "left")
        return both.select("x", "y", "sum_case", F.coalesce("n", F.lit(0)).alias("sum_control"))


def _units(
    placed: DataFrame, items: int, packed: bool | None, split_above: int
) -> tuple[_Units, _Units]:
    """Carriers of the cases and of the controls; one look at the samples decides how both are kept."""
    samples = _items_per_sample(placed)
    n_items = F.col("n_items")
    looked = samples.groupBy("in_case").agg(
        F.count("*").alias("samples"),
        F.max(n_items).alias("most"),
        F.sum(n_items.cast("double") * n_items).alias("squares"),
        F.sum(n_items).alias("carriers"),
    )
    extents = {r.in_case: r for r in looked.collect()}  # two rows

    def of(in_case: bool) -> _Units:
        own, own_samples = placed.where(F.col("in_case") == in_case), samples.where(F.col("in_case") == in_case)
        if in_case not in extents:
            return _Units(own.withColumn("blocks", F.lit(1)), ["sample_id"], [], Extent(0, 0, 0, 0.0, 0.0), 0)
        e = extents[in_case]
        extent = Extent(e.samples, items, e.most, e.squares, (e.samples / CELL + 1.0) * items * items)
        if extent.by_cell < extent.by_sample if packed is None else packed:
            unit, words = ["in_case", "bucket", "cell"], [f"w{k}" for k in range(WORDS)]
            cells = _packed(own, own_samples, e.samples, unit, words, ["id", "n_case"])
            rows = stored(cells.withColumn("blocks", F.lit(max(1, math.ceil(items / split_above)))), "cells")
        else:
            unit, words, rows = ["sample_id"], [], own.withColumn("blocks", F.lit(1))
            if e.most > split_above:
                rows = _with_blocks(own, own_samples, split_above)
        return _Units(rows.select("id", "n_case", *unit, "blocks", *words), unit, words, extent, e.carriers)

    return of(True), of(False)


def _next_bound(
    items: DataFrame, done: _Bound | None, size: int | None, able: Column
) -> _Bound | None:
    """The last of the next ``size`` items that are able to be in the ranking (None: of all)."""
    if size is None:
        return _Bound(0, 0)
    left = items.where(able) if done is None else items.where(able & ~done.holds())
    order = F.struct(-F.col("n_case"), F.col("id"))
    (last,) = left.orderBy(F.desc("n_case"), "id").limit(size).agg(F.max(order)).head()
    return None if last is None else _Bound(-last[0], last[1])


def _items_per_sample(carrying: DataFrame) -> DataFrame:
    return carrying.groupBy("sample_id", "in_case").agg(F.count("*").alias("n_items"))


def _with_blocks(rows: DataFrame, samples: DataFrame, split_above: int) -> DataFrame:
    """Number of blocks of each sample, more than one where it has many items."""
    many = samples.where(F.col("n_items") > split_above).select(
        "sample_id", F.ceil(F.col("n_items") / split_above).cast("int").alias("blocks")
    )
    return rows.join(many, "sample_id", "left").withColumn(
        "blocks", F.coalesce(F.col("blocks"), F.lit(1))
    )


def _packed(
    carrying: DataFrame,
    samples: DataFrame,
    n_samples: int,
    unit: list[str],
    words: list[str],
    item: list[str],
) -> DataFrame:
    """One row per item and cell: the samples of the cell that carry the item, as bits."""
    buckets = max(1, math.ceil(n_samples / _BUCKET))
    in_bucket = Window.partitionBy("bucket", "in_case").orderBy("sample_id")
    placed = (
        samples.withColumn("bucket", F.pmod(F.xxhash64("sample_id"), F.lit(buckets)).cast("int"))
        .withColumn("number", F.row_number().over(in_bucket) - 1)
        .selectExpr("sample_id", "bucket", f"number div {CELL} AS cell", f"number % {CELL} AS place")
    )

    def word(k: int) -> Column:
        bit = f"if(place div 64 = {k}, shiftleft(1L, place % 64), 0L)"
        return F.bit_or(F.expr(bit)).alias(words[k])

    cells = carrying.join(placed, "sample_id").groupBy(*item, *unit)
    return cells.agg(*[word(k) for k in range(len(words))])


def pair_count(n: Column) -> Column:
    """Number of distinct pairs of n items."""
    n = n.cast("bigint")
    even = F.pmod(n, F.lit(2)) == 0
    return F.when(even, F.shiftright(n, 1) * (n - 1)).otherwise(n * F.shiftright(n - 1, 1))


def pair_tests(n: Column) -> Column:
    """Number of tests reported for pairs of n items, n (n + 1) / 2."""
    return pair_count(n + 1)
