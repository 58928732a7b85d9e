"""Language of texts by a bidirectional gated recurrent network over bytes.

Two chains of gated units read a window of bytes, one in each direction. A softmax of both states
labels every position, and the label probabilities of all positions of a text are averaged. Whole texts
are read, as windows of ``CORE`` positions that are labelled and ``MARGIN`` more on either side that
only warm the states up; so texts of any length are read in bounded memory and side by side.

The network is trained in numpy by backpropagation through time, on windows cut by Spark out of a
bounded sample: at most ``fit_rows`` labelled rows of each language, chosen by a hash of their id, and
``fit_windows`` windows at hashed places in each. The hash also deals a language into ``SHARES`` shares,
each of which gives its part of the rows, so that no task ranks all rows of a common language. Only the
windows come to the driver. Languages take equal part in every step, whatever their share of the rows.

* A null text, a text without a letter, and all texts of a model without languages are ``und`` with
  score 0. A text of any other kind has a learned language; ties take the first by name.
* Rows without language or letter are not learned from. Repeated rows count as often as they are there.
* Other columns, whatever their names, are kept; ``lang_pred`` and ``score`` replace any of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burdenlens.llm.common import arrow, pieces, replaced, utf8

UNKNOWN = "und"
#: Positions that a window labels, and positions it reads besides on either side.
CORE, MARGIN = 224, 16
#: Units of each direction.
UNITS = 12
#: Bytes of a window to learn from.
LEARNED = 96
#: Shares that the rows of a language are dealt into to choose some of them.
SHARES = 64


class Chain(NamedTuple):
    """One direction: what a byte adds to reset, update and candidate, and what the state adds."""

    given: np.ndarray  # 3 units x 256
    state: np.ndarray  # 3 units x units


class Model(NamedTuple):
    languages: list[str]
    forward: Chain
    backward: Chain
    shown: np.ndarray  # languages x 2 units
    base: np.ndarray  # languages


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(
    labelled: DataFrame,
    fit_rows: int = 1024,
    fit_windows: int = 3,
    steps: int = 400,
    batch: int = 128,
    seed: int = 7,
) -> Model:
    """A model of ``text`` and ``lang``; ``id`` chooses the sample of rows."""
    spans = F.greatest(F.octet_length("text") - LEARNED, F.lit(0)) + 1
    places = F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), spans) for k in range(fit_windows)])
    windows = F.transform(
        places, lambda p: F.substring(F.col("text").cast("binary"), p.cast("int") + 1, F.lit(LEARNED))
    )
    order = F.xxhash64("id")
    rows = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select(
        "lang",
        order.alias("_order"),
        F.pmod(order, F.lit(SHARES)).alias("_share"),
        windows.alias("windows"),
    )
    # the limit is applied in each task before rows are shuffled
    place = F.row_number().over(Window.partitionBy("lang", "_share").orderBy("_order", "windows"))
    sample = rows.withColumn("_place", place).where(F.col("_place") <= max(1, fit_rows // SHARES))
    found: dict[str, list[bytes]] = {}
    for row in sample.orderBy("lang", "_share", "_place").select("lang", "windows").toLocalIterator():
        found.setdefault(row["lang"], []).extend(bytes(w) for w in row["windows"])
    return fit(found, steps, batch, seed)


def fit(found: dict[str, list[bytes]], steps: int, batch: int, seed: int) -> Model:
    """Trains on windows of each language by Adam steps over batches that share languages evenly."""
    rng = np.random.default_rng(seed)
    names = sorted(found)

    def chain() -> Chain:
        return Chain(
            rng.normal(0, 0.3, (3 * UNITS, 256)).astype(np.float32),
            rng.normal(0, UNITS**-0.5, (3 * UNITS, UNITS)).astype(np.float32),
        )

    model = Model(
        names,
        chain(),
        chain(),
        rng.normal(0, 0.3, (len(names), 2 * UNITS)).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    if len(names) < 2:
        return model
    weights = [*model.forward, *model.backward, model.shown, model.base]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        chosen = rng.permutation(np.arange(batch) % len(names))
        texts = [found[names[c]][rng.integers(len(found[names[c]]))] for c in chosen]
        order = np.argsort([-len(t) for t in texts], kind="stable")
        data, sizes = _columns([texts[k] for k in order])
        slopes, _ = gradient(model, data, sizes, chosen[order])
        rate = 0.02 * min(1.0, step / 20) * (1 - step / (steps + 1))
        length = np.sqrt(sum(float((s * s).sum()) for s in slopes))
        for w, s, m, v in zip(weights, slopes, first, second, strict=True):
            s *= min(1.0, 1.0 / max(length, 1e-9))
            m += 0.1 * (s - m)
            v += 0.01 * (s * s - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def predict(frame: DataFrame, model: Model, text: str = "text", labels: bool = False) -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the mean probability of that language over all positions.

    With ``labels`` also ``lang_runs``: the runs of positions (bytes) labelled alike, as
    ``start, size, lang``.
    """
    letters = "_letters"
    marked = frame.withColumn(letters, has_letter(F.col(text)))
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            data, bounds = utf8(batch.column(batch.schema.get_field_index(text)))
            known = batch.column(letters).to_numpy(zero_copy_only=False).astype(bool)
            means, tags = _means(model, data, bounds, known, labels)
            best = np.where(known, means.argmax(1), len(names) - 1)
            out = replaced(batch.drop_columns([letters]), "lang_pred", pa.array(names[best], pa.string()))
            out = replaced(out, "score", pa.array(means[np.arange(len(best)), best], pa.float64()))
            if labels:
                out = replaced(out, "lang_runs", _runs(tags, bounds, names))
            yield out

    return arrow(marked, run, _spelled(frame, labels))


def _spelled(frame: DataFrame, labels: bool) -> str:
    new = {"lang_pred": "string", "score": "double"}
    if labels:
        new["lang_runs"] = "array<struct<start: bigint, size: bigint, lang: string>>"
    old = [f"`{c}` {t}" for c, t in frame.dtypes if c.lower() not in new]
    return ", ".join(old + [f"{c} {t}" for c, t in new.items()])


def _runs(tags: np.ndarray, bounds: np.ndarray, names: np.ndarray) -> pa.Array:
    """Runs of equal tags in each text."""
    new = np.ones(len(tags), bool)
    new[1:] = tags[1:] != tags[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(tags)))
    offsets = np.searchsorted(starts, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(offsets))
    runs = pa.StructArray.from_arrays(
        [
            pa.array(starts - bounds[text], pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.array(names[tags[starts]], pa.string()),
        ],
        ["start", "size", "lang"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)


# --- the network --------------------------------------------------------------------------------
# Arrays are laid out as (step, unit, window), windows by falling length, so that the windows that
# still have a byte at a step are the first ones.


def _columns(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of falling length as columns, and how many of them reach each step."""
    sizes = np.array([len(w) for w in windows])
    data = np.zeros((max(sizes.max(), 1), len(windows)), np.intp)
    for k, w in enumerate(windows):
        data[: len(w), k] = np.frombuffer(w, np.uint8)
    return data, (sizes[None, :] > np.arange(len(data))[:, None]).sum(1)


def _steps(chain: Chain, data: np.ndarray, reach: np.ndarray, backward: bool) -> Iterator[tuple]:
    """The states after each step, in the direction's order, with what led there."""
    units = chain.state.shape[1]
    h = np.zeros((units, data.shape[1]), np.float32)
    for t in range(len(data))[:: -1 if backward else 1]:
        n = reach[t]
        given = np.take(chain.given, data[t, :n], axis=1)
        old = h[:, :n]
        g = chain.state @ old
        gates = g[: 2 * units]
        gates += given[: 2 * units]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        recalled = g[2 * units :]
        new = recalled * gates[:units]
        new += given[2 * units :]
        new *= -2
        np.exp(new, out=new)
        new += 1
        np.divide(2, new, out=new)
        new -= 1
        state = old - new
        state *= gates[units:]
        state += new
        yield t, n, old, gates, recalled, new, state
        if backward and n < data.shape[1]:
            h = h.copy()  # what was yielded stays as it is
            h[:, :n] = state  # windows that end earlier are still at rest
        else:
            h = state


def _chances(model: Model, data: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Probabilities of the languages at each step of each window: step x language x window."""
    units = model.forward.state.shape[1]
    found = np.zeros((len(data), len(model.languages), data.shape[1]), np.float32)
    with np.errstate(over="ignore"):
        for t, n, *_, state in _steps(model.forward, data, reach, False):
            found[t, :, :n] = model.shown[:, :units] @ state
        for t, n, *_, state in _steps(model.backward, data, reach, True):
            f = found[t, :, :n]
            f += model.shown[:, units:] @ state
            f += model.base[:, None]
            f -= f.max(0)
            np.exp(f, out=f)
            f /= f.sum(0)
    return found


def gradient(
    model: Model, data: np.ndarray, reach: np.ndarray, truth: np.ndarray
) -> tuple[list[np.ndarray], float]:
    """Slopes of the mean cross entropy of all positions by every weight, and the mean itself."""
    units = model.forward.state.shape[1]
    total = float(reach.sum())
    with np.errstate(over="ignore"):
        chances = _chances(model, data, reach)
        picked = chances[:, truth, np.arange(data.shape[1])]
        inside = np.arange(data.shape[1]) < reach[:, None]
        loss = -float(np.log(np.maximum(picked, 1e-30))[inside].sum()) / total
        off = chances  # slopes of the logits
        off[:, truth, np.arange(data.shape[1])] -= inside
        off /= total
        shown = np.zeros_like(model.shown)
        slopes = []
        for chain, at, backward in (
            (model.forward, slice(0, units), False),
            (model.backward, slice(units, None), True),
        ):
            trace = list(_steps(chain, data, reach, backward))
            dstate = np.zeros_like(chain.state)
            dgiven = np.zeros((3 * units, *data.shape), np.float32)
            dh = np.zeros((units, data.shape[1]), np.float32)
            for t, n, old, gates, recalled, new, state in reversed(trace):
                shown[:, at] += off[t, :, :n] @ state.T
                d = dh[:, :n] + model.shown[:, at].T @ off[t, :, :n]
                reset, update = gates[:units], gates[units:]
                dnew = d * (1 - update) * (1 - new * new)
                dgates = np.concatenate(
                    [dnew * recalled * reset * (1 - reset), d * (old - new) * update * (1 - update)]
                )
                dgiven[: 2 * units, t, :n] = dgates
                dgiven[2 * units :, t, :n] = dnew
                back = np.concatenate([dgates, dnew * reset])
                dstate += back @ old.T
                dh[:, :n] = d * update + chain.state.T @ back
            flat = data.ravel()
            by_byte = [np.bincount(flat, row.ravel(), 256) for row in dgiven]
            slopes += [np.array(by_byte, np.float32), dstate]
    return [*slopes, shown, off.sum((0, 2))], loss


def _means(
    model: Model, data: np.ndarray, bounds: np.ndarray, known: np.ndarray, labels: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Mean probabilities of every text, a last column of 0 for none, and the label of every byte."""
    sizes = np.where(known, np.diff(bounds), 0)
    pooled = np.zeros((len(sizes), len(model.languages) + 1))
    tags = np.full(len(data) if labels else 0, len(model.languages))
    if not len(model.languages):
        return pooled, tags
    # texts are cut evenly, so that windows of one text differ by one position at most
    many = -(-sizes // CORE)
    text = np.repeat(np.arange(len(sizes)), many)
    number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = bounds[text] + sizes[text] * number // many[text]
    stop = bounds[text] + sizes[text] * (number + 1) // many[text]
    low = np.maximum(start - MARGIN, bounds[text])
    high = np.minimum(stop + MARGIN, bounds[text + 1])
    order = np.argsort(low - high, kind="stable")
    for group in range(0, len(order), 2048):  # 2,048 windows: about half a megabyte of text
        own = order[group : group + 2048]
        length = (high - low)[own]
        steps = np.arange(length.max())[:, None]
        reach = (length > steps).sum(1)
        at = low[own] + np.minimum(steps, length - 1)
        chances = _chances(model, data[at].astype(np.intp), reach)
        core = (low[own] + steps >= start[own]) & (low[own] + steps < stop[own])
        np.add.at(pooled[:, :-1], text[own], np.einsum("tkb,tb->bk", chances, core.astype(np.float32)))
        if labels:
            tags[at[core]] = chances.argmax(1)[core]
    pooled /= np.maximum(sizes, 1)[:, None]
    return np.minimum(pooled, 1.0), tags
