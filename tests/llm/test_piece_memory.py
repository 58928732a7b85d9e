"""What a task holds at a time while it goes through many small texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from burdenlens.llm import common, shingles, toxicity


def test_steps_over_many_texts_take_little_memory():
    rnd = np.random.default_rng(1)
    texts = ["".join(map(chr, rnd.integers(97, 123, 2000))) for _ in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    for piece in common.pieces(iter([batch]), "text"):
        data, bounds = common.utf8(piece.column("text"))
        assert sum(map(len, toxicity.features(data, bounds))) > 0
        assert len(shingles.runs(data, bounds)[0]) > 0
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 48 << 20
