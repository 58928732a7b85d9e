"""Manifest trees against a plain recursion, in all sizes around the stored levels."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from burdenlens.llm import merkle


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def climbed(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[k : k + 3]) for k in range(0, len(last), 3)])
    return levels


def sides(levels, k):
    out = []
    for level in levels[:-1]:
        run = range(k // 3 * 3, min(k // 3 * 3 + 3, len(level)))
        out.append(("".join(level[x] for x in run if x < k), "".join(level[x] for x in run if x > k)))
        k //= 3
    return out


def brute(leaves):
    """(tree, id, leaf) to subroot, path, and the root."""
    trees = {}
    for tree, key, leaf in sorted(leaves, key=lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or 0, x[2])):
        trees.setdefault(tree, []).append((key, leaf))
    forests = {t: climbed([leaf for _, leaf in rows]) for t, rows in trees.items()}
    top = climbed([levels[-1][0] for levels in forests.values()])
    out = []
    for place, (tree, rows) in enumerate(trees.items()):
        for k, (key, leaf) in enumerate(rows):
            path = sides(forests[tree], k) + sides(top, place)
            out.append((tree, key, leaf, forests[tree][-1][0], path))
    return out, top[-1][0] if leaves else None


def comparable(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("sizes", [[1], [3, 1], [2, 81, 82, 1], [244, 9, 1, 28] + [1] * 90, [6600, 4]])
def test_equals_plain_recursion(spark, sizes, tmp_path):
    rnd = random.Random(len(sizes))
    leaves = [
        (None if t == 0 else f"tree {'é' * (t % 3)}{t}", k * 7 % 1009 + (k // 1009) * 1009, sha(str(t), str(k)))
        for t, n in enumerate(sizes)
        for k in range(n)
    ]
    rnd.shuffle(leaves)
    frame = spark.createDataFrame(leaves, "tree string, id long, leaf string").withColumn("size_", F.lit(1))
    folder = str(tmp_path / "manifest")
    merkle.build(frame, folder)
    manifest = merkle.load(spark, folder)
    expected, root = brute(leaves)
    found = merkle.proofs(manifest).withColumn("root", manifest.root).withColumn(
        "folded", merkle.fold(F.col("leaf"), F.col("path"))
    ).withColumn("others", merkle.siblings(F.col("path"))).collect()
    assert comparable(
        (r.tree, r.id, r.leaf, r.subroot, [tuple(s) for s in r.path]) for r in found
    ) == comparable(expected)
    assert all(r.root == root and r.folded == root for r in found)
    paths = {(r.tree, r.id): "".join(a + b for a, b in r.path) for r in found}
    assert all(r.others == paths[r.tree, r.id] for r in found)


def test_only_every_few_levels_are_stored(spark, tmp_path):
    folder = tmp_path / "manifest"
    leaves = spark.range(7000).select(F.lit("t").alias("tree"), "id", F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    manifest = merkle.build(leaves, str(folder))
    assert sorted(p.name for p in (folder / "rows").iterdir()) == ["0", "4", "8", "depth"]
    nodes = [level.select(F.sum(F.size("members"))).head()[0] for level in manifest.rows]
    assert nodes == [7000, 87, 2]
    assert all(level.select(F.max(F.size("members"))).head()[0] <= merkle.BLOCK for level in manifest.rows)


def test_odd_rows(spark):
    """Nulls, repeated ids and rows, long text, and a change of any field."""
    rows = [(None, None, None), (None, None, None), (1, "", "s"), (1, None, "s"), (1, "x" * 300_000, "s"), (2, "é", "")]
    frame = spark.createDataFrame(rows, "id long, text string, tree string")
    leaves = frame.select("tree", "id", merkle.leaf_hash(F.col("id"), F.col("tree"), F.col("text")).alias("leaf"))

    def spelled(*values):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    hashes = [(t, k, spelled(k, t, x)) for k, x, t in rows]
    expected, root = brute(hashes)
    manifest = merkle.build(leaves)
    found = merkle.proofs(manifest).withColumn("root", manifest.root).collect()
    assert comparable(
        (r.tree, r.id, r.leaf, r.subroot, [tuple(s) for s in r.path]) for r in found
    ) == comparable(expected)
    assert {r.root for r in found} == {root}
    changed = merkle.proofs(manifest).select(
        merkle.fold(F.sha2(F.lit("other"), 256), F.col("path")).alias("folded")
    )
    assert all(r.folded != root for r in changed.collect())


def test_no_rows(spark):
    manifest = merkle.build(spark.createDataFrame([], "tree string, id long, leaf string"))
    assert merkle.proofs(manifest).collect() == []
    assert spark.range(1).select(manifest.root.alias("root")).head()["root"] is None
