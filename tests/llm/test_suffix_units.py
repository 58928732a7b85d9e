"""Units of the suffix tree: written once, and told and found again without loss."""

import numpy as np
from pyspark.sql import functions as F

from burdenlens.llm import suffix_tree


def test_units_of_texts_are_dealt_and_not_stored_besides(spark, monkeypatch):
    rows = [(k, f"the {k % 7} cats sat on the {k % 5} mats") for k in range(60)]
    frame = spark.createDataFrame([*rows, (None, None), (3, "a row of the same id")], "doc_id long, text string")
    stored, kept = [], suffix_tree.kept
    monkeypatch.setattr(suffix_tree, "kept", lambda f: stored.append(f.columns) or kept(f))
    monkeypatch.setattr(suffix_tree, "UNIT", 300)
    got = suffix_tree.scores(frame, F.col("doc_id") % 5 != 1).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted([*range(60), 3])
    assert [(r["train"], r["n_tokens"]) for r in got if r["doc_id"] is None] == [(None, 1)]
    assert not any("stream" in columns for columns in stored)


def test_grams_and_chances_are_read_as_written():
    rnd = np.random.default_rng(3)
    for size in (1, 2, 1000):
        context = np.sort(rnd.integers(0, 1 << 63, size).astype(np.uint64) >> np.uint64(rnd.integers(0, 50)))
        sign, count = rnd.integers(0, 256, size).astype(np.uint8), rnd.integers(0, 1 << 20, size)
        back = suffix_tree._read(suffix_tree._written(context, sign, count))
        assert all((x == y).all() for x, y in zip(back, (context, sign, count), strict=True))
        found = rnd.integers(0, 3, size).astype(np.float32)
        assert (suffix_tree._values(suffix_tree._runs(found)) == found).all()


def test_places_by_hash_tables():
    codes = np.unique(np.random.default_rng(4).integers(0, 1 << 63, 5000).astype(np.uint64))
    codes = np.append(np.arange(3000, dtype=np.uint64), codes + np.uint64(3000))
    place = np.random.default_rng(5).integers(0, len(codes), 20_000)
    assert (suffix_tree._located(codes[place], codes, suffix_tree._tables(codes)) == place).all()
