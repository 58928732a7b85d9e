"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed byte n-grams of its lower-cased form. One pass over all
labelled texts counts, for either class, the texts that hold a feature; counts add up over tasks. The
log-count ratio of each feature scales it, and a logistic regression on the scaled features gives the
weights. Regression takes the features whose ratio is most certain, and fits on a bounded number of
labelled rows (``fit_rows``), chosen by a hash of the id. The model is one weight per bucket, of fixed
size, and goes to the tasks that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burdenlens.llm.common import added, arrow, blocks_of, pieces, replaced, summed, utf8

BUCKETS = 1 << 20
GRAMS = (3, 4, 5, 6)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32
_SEED = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def features(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct buckets of every text; a text shorter than the shortest n-gram has none."""
    signs = _SEED[_LOWER[data]]
    hashes = []
    rolled = np.zeros(len(signs), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if n > len(signs):
            break
        rolled = rolled[: len(signs) - n + 1] * _STEP + signs[n - 1 :]
        if n in GRAMS:
            mixed = (rolled ^ (rolled >> np.uint64(29))) * _STEP
            hashes.append((n, (mixed >> np.uint64(64 - 20)).astype(np.int32)))
    place = np.zeros(BUCKETS, np.int32)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = [h[a : b - n + 1] for n, h in hashes if b - a >= n]
        if not own:
            yield np.zeros(0, np.int32)
            continue
        every = np.concatenate(own)
        order = np.arange(len(every), dtype=np.int32)
        place[every] = order  # one place is left for each bucket
        yield every[place[every] == order]


@dataclass(frozen=True)
class Model:
    """Weights of the buckets, of which most are 0, and the constant."""

    weights: np.ndarray
    constant: float

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = [self.weights[f].sum(dtype=np.float64) for f in features(data, bounds)]
        return 1 / (1 + np.exp(-np.clip(self.constant + np.array(sums), -500, 500)))


def marks(labels: DataFrame, label: str = "toxic") -> DataFrame:
    """``doc_id, label``: one label of 0 or 1 an id. Of several the largest counts; a null label or id
    is left out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    known = known.where("label IN (0, 1) AND doc_id IS NOT NULL")
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def _counts(rows: DataFrame) -> np.ndarray:
    """Texts of each class that hold each bucket, over all rows: a 2 x BUCKETS array."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, BUCKETS), np.int32)
        some = False
        for piece in pieces(batches, "text"):
            label = piece.column("label").to_numpy(zero_copy_only=False)
            for own, f in zip(label, features(*utf8(piece.column("text"))), strict=True):
                found[own, f] += 1
            some = True
        if some:
            yield blocks_of(found.ravel())

    parts = arrow(rows, count, "block int, counts binary")
    return summed(parts, 2 * BUCKETS).reshape(2, BUCKETS)


#: Entries of the fit that one numpy step takes on.
STEP = 1 << 20


def _fit(column: np.ndarray, sizes: np.ndarray, label: np.ndarray, scale: np.ndarray, ridge: float):
    """Logistic regression on rows of feature numbers, each scaled; (weights, constant).

    ``column`` holds the numbers of all rows on end, ``sizes`` how many each row has. Products are made
    a step at a time, so nothing but these two grows with the rows.
    """
    ends = np.cumsum(sizes)
    scale = scale.astype(np.float32)
    wide, steps = len(scale), range(0, len(column), STEP)

    def owners(start: int) -> np.ndarray:
        stop = min(start + STEP, len(column))
        return np.searchsorted(ends, np.arange(start, stop), "right")

    # the rarer class weighs more, by the root of its rarity
    share = min(max(label.mean(), 1e-9), 1 - 1e-9) if len(label) else 0.5
    weight = np.where(label == 1, (0.5 / share) ** 0.5, (0.5 / (1 - share)) ** 0.5)

    def times(w):
        out, own = np.zeros(len(sizes)), scale * w
        for start in steps:
            out += np.bincount(owners(start), own[column[start : start + STEP]], len(sizes))
        return out

    def back(v):
        out = np.zeros(wide)
        for start in steps:
            out += np.bincount(column[start : start + STEP], v[owners(start)], wide)
        return scale * out

    w, constant = np.zeros(wide), 0.0
    for _ in range(12):  # Newton steps, each solved by conjugate gradients
        p = 1 / (1 + np.exp(-np.clip(times(w) + constant, -30, 30)))
        curve, wrong = np.maximum(p * (1 - p), 1e-6) * weight, (p - label) * weight
        slope, down = back(wrong) + ridge * w, wrong.sum()
        step, offset = np.zeros(wide), 0.0
        r, r0 = -slope, -down
        d, d0 = r.copy(), r0
        size = r @ r + r0 * r0
        first = size
        for _ in range(30):
            if size <= 1e-8 * first or size < 1e-12:
                break
            moved = curve * (times(d) + d0)
            q, q0 = back(moved) + ridge * d, moved.sum()
            a = size / (d @ q + d0 * q0)
            step, offset = step + a * d, offset + a * d0
            r, r0 = r - a * q, r0 - a * q0
            size, last = r @ r + r0 * r0, size
            d, d0 = r + size / last * d, r0 + size / last * d0
        w, constant = w + step, constant + offset
        if np.abs(step).max(initial=0) + abs(offset) < 1e-4:
            break
    return w, constant


def train(
    documents: DataFrame,
    marked: DataFrame,
    chosen: int = 6144,
    fit_rows: int = 12_000,
    ridge: float = 2.0,
) -> Model:
    """A model from the texts of ``documents`` and the labels of ``marks``.

    Log-count ratios are taken over all labelled rows; labels are not bounded, so texts meet them in a
    merge join whatever the size. The regression takes the ``chosen`` buckets whose ratio is most
    certain and about ``fit_rows`` labelled ids, which are few enough to be sent to every task.
    Without rows of both classes every score is the share of marked rows, smoothed.
    """
    texts = documents.select("doc_id", "text")
    rows = texts.join(marked.hint("merge"), "doc_id").select("label", "text")
    counts = _counts(rows)
    per_class = marked.groupBy("label").count().collect()
    total = np.zeros(2)
    for r in per_class:
        total[r["label"]] = r["count"]
    share = (counts + 1) / (counts + 1).sum(1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    constant = float(np.log((total[1] + 1) / (total[0] + 1)))
    weights = np.zeros(BUCKETS, np.float32)
    if not total.all():
        return Model(weights, constant)
    # certainty: how far the class counts of a bucket are from independence of the class
    seen = counts.sum(0)
    expected = seen * total[1] / total.sum()
    spread = np.sqrt(np.maximum(expected * (1 - seen / total.sum()), 1e-9))
    certain = np.where(seen >= 5, np.abs(counts[1] - expected) / (spread + 1), 0)
    picked = np.sort(np.argsort(-certain, kind="stable")[:chosen])
    picked = picked[certain[picked] > 2]
    number = np.full(BUCKETS, -1, np.int32)
    number[picked] = np.arange(len(picked))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            own = [number[f] for f in features(*utf8(piece.column("text")))]
            ids = pa.array([np.sort(n[n >= 0]) for n in own], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([piece.column("label"), ids], ["label", "ids"])

    few = marked
    if total.sum() > fit_rows:  # a share of the hash range, so that no sort is needed
        bound = int(-(2**63) + 2**64 * fit_rows / total.sum())
        few = marked.where(F.xxhash64("doc_id") < bound)
    sample = texts.join(F.broadcast(few), "doc_id").select("label", "text")
    del counts, share, seen, expected, spread, certain
    table = arrow(sample, reduce, "label int, ids array<int>").toArrow()
    label = table["label"].to_numpy().astype(float)
    ids = table["ids"].combine_chunks()
    sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
    column = ids.flatten().to_numpy()
    del table
    fitted, constant = _fit(column, sizes, label, ratio[picked], ridge)
    weights[picked] = fitted * ratio[picked]
    return Model(weights, constant)


def score(frame: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The frame with ``score double`` from 0 to 1, from the text alone.

    Null and empty texts get the score of a text without features. Rows are kept one by one; a column
    named score is replaced.
    """
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            found = shared.value.score(*utf8(piece.column(text)))
            yield replaced(piece, "score", pa.array(found, pa.float64()))

    return arrow(frame, run, added(frame, "score double"))
