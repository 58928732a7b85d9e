"""Merkle manifest of a dataset: checkpointed trees, and proofs that recompute what is not stored.

Rows are leaves of one tree for each value of a column; the subroots of all trees are the leaves of
one more tree, whose root stands for the whole dataset. Three consecutive nodes become one, until one
is left; the last run of a level may be shorter.

Only every ``STEP``-th level is stored, as rows of aligned subtrees: the up to ``BLOCK`` neighbouring
nodes below one node of the next stored level. Levels between are computed when nodes climb, and again
when proofs are taken: each stored subtree regenerates its interior, hands every node below it its
siblings, and forgets it. So a manifest costs little more than its leaves, a proof is made where its
subtree is stored, and what goes down from level to level is one row for each subtree.

Places in a tree come from a sort by range, so a tree with a third of all rows is shared out evenly.
Texts are read once, by the hashes; only hashes and ids are shuffled.

* A null is a value of its own in every field, so also in the column that deals rows into trees, where
  it comes first. Empty text differs from null.
* Rows with equal ids are leaves of their own, in the order of their hashes.
* No rows make an empty manifest: no subroots, no root, no proofs.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burdenlens.workspace import new_folder, stored

FAN = 3
#: Levels from one stored level to the next.
STEP = 4
#: Nodes of a stored level below one node of the next.
BLOCK = FAN**STEP


class Manifest(NamedTuple):
    """Stored levels of the trees of rows, and of the tree of their subroots."""

    rows: list[DataFrame]
    subroots: list[DataFrame]

    @property
    def root(self) -> Column:
        """The root as a scalar subquery; null for a manifest without rows."""
        return _finished(self.subroots).agg(F.max("node")).scalar()


def leaf_hash(*fields: Column) -> Column:
    """Hex SHA-256 of the fields: each is its length in bytes, a colon and the value, or ``-``."""

    def spelled(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(spelled, fields)), 256)


def build(leaves: DataFrame, folder: str | None = None) -> Manifest:
    """The manifest of ``tree, id, leaf`` and columns that travel along, written below a folder.

    ``tree`` and ``id`` may have any type that sorts, ``leaf`` is a hash in hex. Without a folder
    one below the shared folder of the session is taken.
    """
    spark = leaves.sparkSession
    folder = folder or new_folder(spark, "merkle")
    rows = _climb(leaves, f"{folder}/rows")
    tops = _finished(rows).select(
        F.lit(0).alias("tree"), F.col("tree").alias("id"), F.col("node").alias("leaf"), "level"
    )
    return Manifest(rows, _climb(tops, f"{folder}/subroots"))


def load(spark: SparkSession, folder: str) -> Manifest:
    """A manifest that :func:`build` has written."""

    def levels(part: str) -> list[DataFrame]:
        depth = spark.read.parquet(f"{folder}/{part}/depth").head()["depth"]
        return [spark.read.parquet(f"{folder}/{part}/{k * STEP}") for k in range(depth)]

    return Manifest(levels("rows"), levels("subroots"))


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf with its proof: ``tree, id, leaf, subroot, path`` and the columns that came along.

    ``path`` has an entry for each level up to the root, with the siblings ``before`` and ``after``
    the node, each on end.
    """
    empty = F.array().cast("array<struct<before: string, after: string>>")
    top = _finished(manifest.subroots).select("tree", "level", F.col("node").alias("subroot"))
    sources = _descend(manifest.subroots, top.withColumn("path", empty))
    return _descend(
        manifest.rows, sources.select(F.col("id").alias("tree"), "level", F.col("leaf").alias("subroot"), "path")
    )


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a proof lead to."""
    return F.aggregate(
        path, node, lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]), 256)
    )


def siblings(path: Column) -> Column:
    """All siblings of a proof on end, from the leaf's to the root's children, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


# --- trees --------------------------------------------------------------------------------------


def _climb(leaves: DataFrame, folder: str) -> list[DataFrame]:
    """Stored levels of the trees: ``tree, size, block, members``; members are ordered and have a
    ``node``. ``size`` counts the nodes of the tree on that level. Trees end where it is one block."""
    spark = leaves.sparkSession
    placed = _placed(leaves).withColumnRenamed("leaf", "node")
    (most,) = placed.agg(F.coalesce(F.max("size"), F.lit(1))).head()
    depth = max(1, math.ceil(math.log(most, BLOCK) - 1e-12))
    while BLOCK**depth < most:
        depth += 1
    levels = []
    for k in range(depth):
        members = [c for c in placed.columns if c not in ("tree", "size", "place")]
        blocks = placed.groupBy("tree", "size", F.expr(f"place div {BLOCK}").alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("place", "node", *[c for c in members if c != "node"])))
            .alias("members")
        )
        path = f"{folder}/{k * STEP}"
        blocks.write.parquet(path)
        levels.append(spark.read.schema(blocks.schema).parquet(path))
        placed = _interior(levels[-1].where(F.col("size") > BLOCK)).select(
            "tree",
            F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("size"),
            F.col("block").alias("place"),
            _top().alias("node"),
        )
    spark.range(1).select(F.lit(depth).alias("depth")).write.parquet(f"{folder}/depth")
    return levels


def _placed(leaves: DataFrame) -> DataFrame:
    """Adds ``place``, from 0 in each tree by id, and ``size`` of the tree.

    Ranges of one global order are numbered by themselves; what one range holds of one tree is then
    shifted by what ranges before it hold, of which there is one row for each range and tree.
    """
    order = ["tree", "id", "leaf"]
    once = stored(leaves, "merkle-leaves")  # the sort samples its input: do not read texts for that
    ranged = stored(
        once.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "merkle-order",
    )
    runs = ranged.groupBy("_part", "tree").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(
        F.col("_part").alias("_range"),
        F.col("tree").alias("_tree"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(tree).alias("size"),
    )
    same = (F.col("_part") == F.col("_range")) & F.col("tree").eqNullSafe(F.col("_tree"))
    return (
        ranged.join(shifts, same)
        .withColumn("place", F.col("_row") + F.col("_shift"))
        .drop("_part", "_row", "_range", "_tree", "_shift")
    )


def _steps() -> Column:
    """Levels from a stored node up to the next stored level or to the root of its tree."""
    steps = F.lit(STEP)
    for k in reversed(range(STEP)):
        steps = F.when(F.col("size") <= FAN**k, F.lit(k)).otherwise(steps)
    return steps


def _interior(blocks: DataFrame) -> DataFrame:
    """Adds ``interior``: the nodes of a block by level, from the stored ones to those that are left
    of it at the next stored level."""

    def risen(nodes: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
        return F.transform(
            runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * FAN + 1, FAN), ""), 256)
        )

    climbed = F.aggregate(
        F.slice(F.sequence(F.lit(1), F.lit(STEP)), F.lit(1), _steps()),
        F.array(F.col("members.node")),
        lambda levels, _: F.concat(levels, F.array(risen(F.element_at(levels, -1)))),
    )
    return blocks.withColumn("interior", climbed)


def _top() -> Column:
    return F.element_at(F.element_at("interior", -1), 1)


def _finished(levels: list[DataFrame]) -> DataFrame:
    """``tree, node, level``: the root of each tree and the number of the stored level that ends it."""
    found = [
        _interior(blocks.where(F.col("size") <= BLOCK)).select(
            "tree", _top().alias("node"), F.lit(k).alias("level")
        )
        for k, blocks in enumerate(levels)
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _descend(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The members of the lowest stored level with what lies above them.

    ``roots`` has ``tree, level, subroot, path``: the path above the root of each tree. A stored level
    gets the paths above its blocks from the members of the next one, or from the roots.
    """
    powers = F.array(*[F.lit(FAN**k) for k in range(STEP)])

    def own(place: Column) -> Column:
        """Siblings of a member within its block."""

        def at(k: Column) -> Column:
            nodes = F.element_at("interior", k + 1)
            node = F.floor(place / F.element_at(powers, k + 1)).cast("int")
            branch = node % FAN
            before = F.slice(nodes, node - branch + 1, branch)
            after = F.slice(nodes, node + 2, FAN - 1 - branch)
            return F.struct(
                F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after")
            )

        return F.transform(F.slice(F.sequence(F.lit(0), F.lit(STEP - 1)), F.lit(1), _steps()), at)

    down = None
    for k in reversed(range(len(levels))):
        above = roots.where(F.col("level") == k).select(
            F.col("tree").alias("_tree"), F.lit(0).cast("bigint").alias("_block"), "subroot", "path"
        )
        if down is not None:
            above = above.unionByName(
                down.select(
                    F.col("tree").alias("_tree"),
                    F.col("member.place").alias("_block"),
                    "subroot",
                    "path",
                )
            )
        same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))
        down = (
            _interior(levels[k].join(above, same))
            .select("tree", "size", "subroot", "path", "interior", F.posexplode("members").alias("at", "member"))
            .select("tree", "member", "subroot", F.concat(own(F.col("at")), "path").alias("path"))
        )
    fields = [f.name for f in levels[0].schema["members"].dataType.elementType.fields]
    carried = [F.col(f"member.{f}").alias(f) for f in fields if f not in ("place", "node")]
    return down.select("tree", F.col("member.node").alias("leaf"), "subroot", "path", *carried)
