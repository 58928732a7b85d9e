"""LM scoring by a probabilistic suffix tree over the bytes of the words.

A text is its words in lower case with one space between them and an end sign. Contexts are strings of
preceding signs of any length up to ``depth``. Every context seen at least ``least`` times is looked at,
whatever the size of the corpus. It is retained if the distribution of the next sign diverges from that of
the next shorter retained suffix (Kullback-Leibler, in nats), by itself and times its count, so that
the more text there is, the more contexts are told apart from chance. A retained context's distribution is its
counts smoothed by that of its parent, down to the root, which gives every byte a chance. Each sign is
scored by the longest retained suffix of what precedes it.

The contexts of up to two signs, of which there are 65,793 at most, are counted in arrays and sent to
all tasks. Longer ones never meet in one place. Texts are put together to units of ``UNIT`` signs, with
their ids, and dealt once; no copy of them is stored besides. Each unit sends its distinct grams (longest context and next sign, with their counts in the training texts) to
the bucket of the last three signs of the context. A bucket adds up the counts of all units, tests its
contexts length by length against their suffixes and answers every unit with the chances of its grams;
with these the unit scores its texts. Buckets grow in number with the corpus. The base score of words needs
the count of each word of each text, which units ask of further buckets in the same way, each of its
words once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from burdenlens.llm.common import arrow, blocks_of, kept, pieces, summed, utf8
from burdenlens.llm.shingles import LOWER, words

#: Longest context (8 at most), least count of a context, least divergence in nats.
DEPTH, LEAST, DIVERGENCE = 8, 2, 0.005
#: Multiplier of hashes.
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Length of the contexts that all tasks have.
SHORT = 2
#: Signs of a unit of texts, of one numpy step, and of the corpus for each bucket.
UNIT, STEP, SPREAD = 10 << 20, 1 << 19, 4 << 20
#: Of the compression of what units send and get.
LEVEL = 6
#: Nats that a context must save over all its occurrences, for each kind of sign seen after it.
EVIDENCE = 2
#: The sign of the end, and of what is before the beginning; no word holds it.
END = 10


def signs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of all texts on end, an end sign before the first, and where each text's begin."""
    count = len(bounds) - 1
    low = LOWER[data]
    text = np.repeat(np.arange(count), np.diff(bounds))
    wide = np.full(len(low) + count, 32, np.uint8)
    wide[np.arange(len(low)) + text] = low
    ends = bounds[1:] + np.arange(count)
    word = wide != 32
    start = word.copy()
    start[1:] &= ~word[:-1]
    at = np.flatnonzero(start)
    # a space before every word but a text's first
    owner = np.searchsorted(ends, at)
    first = np.ones(len(at), bool)
    first[1:] = owner[1:] != owner[:-1]
    take = word
    take[at[~first] - 1] = True
    take[ends] = True
    wide[ends] = END
    taken = np.cumsum(take)
    stream = np.concatenate([np.array([END], np.uint8), wide[take]])
    return stream, np.concatenate([[1], taken[ends] + 1])


@dataclass
class Tree:
    """Contexts by length. ``forward[k]`` leads from a context of length k and the sign after it to
    the context of length k + 1 there, 0 for none; row 0 is no context and leads nowhere."""

    code: np.ndarray  # of each byte; the last code is all bytes not seen
    unseen: int
    forward: list[np.ndarray]
    total: int = 0  # signs learned from
    offset: list[int] | None = None  # of each length's contexts among all
    state: np.ndarray | None = None  # the retained state of each context
    chance: np.ndarray | None = None  # log10 of each sign after each state

    @property
    def width(self) -> int:
        return int(self.code.max()) + 1

    def contexts(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For length 0, 1, ...: the number of the context before each sign, 0 for none."""
        now = np.ones(len(x), np.int32)
        yield now
        for step in self.forward:
            flat = step.ravel()
            longer = np.zeros(len(x), np.int32)
            longer[1:] = flat[now[:-1] * self.width + x[:-1]]
            now = longer
            yield now

    def logs(self, context: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Natural logarithm of the chance of signs after packed contexts (newest sign on top)."""
        before, last = (self.code[((context >> np.uint64(n)) & np.uint64(255))] for n in (48, 56))
        x, one = self.code[sign], np.ones(len(sign), np.int64)
        deepest, now = one, one
        if self.forward:
            now = self.forward[0][one, last].astype(np.int64)
            deepest = np.where(now > 0, self.offset[1] + now, deepest)
        if len(self.forward) > 1:
            now = self.forward[1][self.forward[0][one, before], last].astype(np.int64)
            deepest = np.where(now > 0, self.offset[2] + now, deepest)
        found = self.chance[self.state[deepest], x].astype(np.float64)
        return np.log(10) * (found - np.log10(self.unseen) * (x == self.width - 1))


def _train_rows(piece: pa.RecordBatch) -> pa.RecordBatch:
    return piece.filter(piece.column("train"))


def _count_next(texts: DataFrame, tree: Tree) -> np.ndarray:
    """Next signs after the longest contexts: an array of contexts (one more for none) x signs."""
    shared = texts.sparkSession.sparkContext.broadcast(tree)
    rows = (int(tree.forward[-1].max()) if tree.forward else 1) + 1
    size = rows * tree.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, counts = shared.value, np.zeros(size, np.int64)
        for piece in pieces(batches, "text"):
            stream, _ = signs(*utf8(_train_rows(piece).column("text")))
            x = tree.code[stream]
            for now in tree.contexts(x):
                pass
            counts += np.bincount((now * tree.width + x)[1:], minlength=size)
        yield blocks_of(counts)

    counts = summed(arrow(texts, run, "block int, counts binary"), size)
    shared.unpersist()
    return counts.reshape(rows, tree.width)


def grow(
    texts: DataFrame, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE
) -> Tree:
    """The tree of the rows of ``text, train`` whose ``train`` is true, in arrays: for short contexts."""
    every = np.zeros((2, 256), np.int32)
    every[1] = np.arange(1, 257)
    pairs = _count_next(texts, Tree(np.arange(256, dtype=np.int32), 1, [every]))
    single = pairs.sum(0)
    seen = np.flatnonzero(single)
    code = np.full(256, len(seen), np.int32)
    code[seen] = np.arange(len(seen))
    unseen = 256 - len(seen)
    tree = Tree(code, max(unseen, 1), [], int(single.sum()))
    width, end = len(seen) + 1, int(code[END])
    tree.code = code
    if not len(seen):
        tree.code = np.zeros(256, np.int32)
        tree.unseen, width, end = 256, 1, 0
    counts = np.zeros((2, width), np.int64)
    counts[1, : len(seen)] = single[seen]
    root = counts[1] + 0.5
    root[-1] = 0.5 * tree.unseen
    parent, state = np.zeros(2, np.int64), [np.zeros(2, np.int64)]
    chances, number = [(root / root.sum()).astype(np.float32)[None]], 1
    for length in range(depth):
        common = counts >= least
        common[0] = False
        if length:  # a context never reaches over the end of a text
            common[:, end] = False
        if not common.any():
            break
        step = np.zeros(counts.shape, np.int32)
        step[common] = np.arange(1, common.sum() + 1)
        before, sign = np.nonzero(common)
        shorter = tree.forward[-1][parent[before], sign] if length else np.ones(len(sign), np.int64)
        parent = np.concatenate([[0], shorter]).astype(np.int64)
        tree.forward.append(step)
        if length:
            counts = _count_next(texts, tree)
        else:
            counts = np.zeros((len(sign) + 1, width), np.int64)
            counts[1:, : len(seen)] = pairs[1 + seen[sign]][:, seen]
        above = state[-1][parent]  # the nearest retained suffix
        keep, smooth = _tested(counts, np.concatenate(chances), above, divergence)
        numbered = above.copy()
        numbered[keep] = number + np.arange(keep.sum())
        number += int(keep.sum())
        chances.append(smooth)
        state.append(numbered)
    tree.offset = list(np.cumsum([0, *(len(s) for s in state[:-1])]))
    tree.state = np.concatenate(state).astype(np.int32)
    tree.chance = np.log10(np.concatenate(chances))
    return tree


def _tested(
    counts: np.ndarray, chances: np.ndarray, above: np.ndarray, divergence: float
) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts of a length are retained, and their smoothed distributions; a few thousand
    contexts at a time."""
    kept_, smoothed = [], []
    for start in range(0, len(counts), 4096):
        own = counts[start : start + 4096].astype(float)
        parent = chances[above[start : start + 4096]].astype(float)
        size = own.sum(1, keepdims=True)
        share = own / np.maximum(size, 1)
        gain = (share * np.log(np.maximum(share, 1e-300) / parent)).sum(1)
        kinds = (own > 0).sum(1, keepdims=True)
        keep = (gain >= divergence) & (gain * size[:, 0] >= EVIDENCE * kinds[:, 0])
        keep[: 1 if start == 0 else 0] = False  # no context
        smooth = (own + kinds * parent) / np.maximum(size + kinds, 1)
        kept_.append(keep)
        smoothed.append(smooth[keep].astype(np.float32))
    return np.concatenate(kept_), np.concatenate(smoothed)


def _grams(stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed context (newest sign on top, end signs before the beginning) and sign of all but the
    first eight places of a stream of texts."""
    wide = stream.astype(np.uint64)
    for n in (1, 2, 4):
        wide[n:] = (wide[n:] << np.uint64(8 * n)) | wide[:-n]
    context = wide[7:-1]
    fill = np.uint64(int.from_bytes(bytes([END]) * 8, "big"))
    ends = np.flatnonzero(stream == END)
    following = np.append(ends[1:], len(stream) - 1)
    for n in range(1, 8):
        places = (ends + n)[ends + n <= following] - 8
        places = places[places >= 0]
        low = np.uint64((1 << (64 - 8 * n)) - 1)
        context[places] = (context[places] & ~low) | (fill & low)
    if depth < 8:
        context &= ~np.uint64((1 << (64 - 8 * depth)) - 1)
    return context, stream[8:]


def _ranked(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the number of each among them, in little memory."""
    order = np.argsort(code)
    code = code[order]
    new = np.append(True, code[1:] != code[:-1])
    inverse = np.empty(len(code), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return code[new], inverse


def _distinct(key: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a key and a byte in order, and the number of each pair among them."""
    keys, place = _ranked(key)
    both, inverse = _ranked((place.astype(np.int64) << 8) | old)
    return keys[both >> 8], (both & 255).astype(np.uint8), inverse


def _codes(padded: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of neighbouring signs of a stream by their packed two bytes, in order,
    and the other way round."""
    present = np.zeros((256, 256), bool)  # newer sign, older sign
    present[padded[1:], padded[:-1]] = True
    seen = present.any(1)
    present[seen, END] = present[END, END] = True
    if depth < 8:
        present[seen, 0] = present[0, 0] = True
    pairs = np.flatnonzero(present)
    number = np.zeros(1 << 16, np.uint64)
    number[pairs] = np.arange(len(pairs))
    return number, pairs.astype(np.uint64)


def _merged(taught: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of both arrays in order, and how often each is in the first; sorts both."""
    taught.sort()
    other.sort()
    first = np.flatnonzero(np.append(True, taught[1:] != taught[:-1])[: len(taught)])
    often = np.diff(np.append(first, len(taught)))
    seen = taught[first]
    every = np.concatenate([seen, other[np.append(True, other[1:] != other[:-1])[: len(other)]]])
    every.sort()
    every = every[np.append(True, every[1:] != every[:-1])[: len(every)]]
    count = np.zeros(len(every), np.int32)
    count[np.searchsorted(every, seen)] = often
    return every, count


def _slots(code: np.ndarray, level: int, bits: int) -> np.ndarray:
    mixed = (code ^ (code >> np.uint64(29 + level % 16))) * (ODD + np.uint64(2 * level))
    mixed >>= np.uint64(64 - bits)
    return mixed.astype(np.intp)


def _tables(codes: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Hash tables of the places of distinct numbers; those that lose their slot are in the next table."""
    tables, left = [], np.arange(len(codes), dtype=np.int32)
    while len(left):
        bits = len(left).bit_length() + 1
        table = np.zeros(1 << bits, np.int32)
        slots = _slots(codes[left], len(tables), bits)
        table[slots] = left
        left = left[table[slots] != left]
        tables.append((table, bits))
    return tables


def _located(code: np.ndarray, codes: np.ndarray, tables: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """The place of each number of ``code`` among the distinct ``codes``, all of which it is one of."""
    place, left = np.zeros(len(code), np.int32), None
    for level, (table, bits) in enumerate(tables):
        own = code if left is None else code[left]
        found = table[_slots(own, level, bits)]
        if left is None:
            place = found
        else:
            place[left] = found
        wrong = np.flatnonzero(codes[found] != own)
        left = wrong if left is None else left[wrong]
    return place


def _newest_first(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight signs before each place, the newest first, end signs before the beginning of its text."""
    before = padded[at[:, None] - 1 - np.arange(8)]
    before[np.logical_or.accumulate(before == END, axis=1)] = END
    return before


def _coded(padded: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The grams of all but the first eight places as numbers, each pair of neighbours numbered once."""
    pair = padded[1:].astype(np.uint16) << np.uint16(8)
    pair |= padded[:-1]
    pairs, count = number[pair], len(padded) - 8  # of places 1 and up with the one before
    code = pairs[6 : 6 + count] << np.uint64(8)
    code |= padded[8:]
    for back in (3, 5, 7):
        code <<= np.uint64(14)
        code |= pairs[7 - back : 7 - back + count]
    # where a text begins less than eight signs before, what is before it counts as ends
    begun = np.flatnonzero(padded[:-1] == END)
    at = np.unique(begun[:, None] + np.arange(1, 8))
    at = at[(at >= 8) & (at < len(padded))]
    before = _newest_first(padded, at).astype(np.uint16)
    own = number[(before[:, ::2] << np.uint16(8)) | before[:, 1::2]]
    edge = (own[:, 0] << np.uint64(8)) | padded[at]
    for k in (1, 2, 3):
        edge = (edge << np.uint64(14)) | own[:, k]
    code[at - 8] = edge
    return code


def _unit(
    stream: np.ndarray, train: np.ndarray, depth: int, limit: int = 1 << 14, placed: bool = True
):
    """The distinct grams of a unit as ``key`` (context but its oldest sign, and next sign) and
    ``old`` (that oldest sign), their counts in training texts, and the gram at each place (in steps;
    none unless ``placed``).

    Up to ``limit`` kinds of pairs of signs, four numbers of pairs and the next sign fit 64 bits. Grams
    with the same last two signs are in order of the next sign, which puts equal chances together."""
    padded = np.concatenate([np.full(8, END, np.uint8), stream])
    number, pairs = _codes(padded, depth)
    learned = np.repeat(train, np.diff(np.flatnonzero(stream == END), prepend=-1))
    steps = range(0, len(stream), STEP)
    if len(pairs) > limit:
        return _wide_unit(padded, learned, depth, steps)

    def coded(start: int) -> np.ndarray:
        if depth == 8:
            return _coded(padded[start : start + STEP + 8], number)
        context, sign = _grams(padded[start : start + STEP + 8], depth)
        code = number[context >> np.uint64(48)]
        code <<= np.uint64(8)
        code |= sign
        for n in (32, 16, 0):
            code <<= np.uint64(14)
            code |= number[(context >> np.uint64(n)) & np.uint64(0xFFFF)]
        return code

    taught, other = np.empty(learned.sum(), np.uint64), np.empty((~learned).sum(), np.uint64)
    t = o = 0
    for start in steps:
        code, own = coded(start), learned[start : start + STEP]
        some = int(own.sum())
        taught[t : t + some], other[o : o + len(own) - some] = code[own], code[~own]
        t, o = t + some, o + len(own) - some
    codes, count = _merged(taught, other)
    del taught, other, learned
    tables = _tables(codes) if placed else []
    places = [_located(coded(start), codes, tables) for start in steps] if placed else []
    del tables
    context = np.zeros(len(codes), np.uint64)
    for n in (50, 28, 14, 0):
        context <<= np.uint64(16)
        context |= pairs[(codes >> np.uint64(n)) & np.uint64((1 << 14) - 1)]
    old = context.astype(np.uint8)
    context &= ~np.uint64(255)
    context |= (codes >> np.uint64(42)) & np.uint64(255)
    return context, old, count, places


def _wide_unit(padded: np.ndarray, learned: np.ndarray, depth: int, steps: range):
    """As ``_unit``, for any kinds of pairs of signs."""
    parts, places = [], []
    for start in steps:
        context, sign = _grams(padded[start : start + STEP + 8], depth)
        key = (context & ~np.uint64(255)) | sign
        *own, inverse = _distinct(key, (context & np.uint64(255)).astype(np.int64))
        times = inverse[learned[start : start + STEP]]
        parts.append((*own, np.bincount(times, minlength=len(own[0])).astype(np.int32)))
        places.append(inverse)
    sizes = np.cumsum([0, *(len(p[0]) for p in parts)])
    *own, count = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    if len(places) > 1:
        *own, inverse = _distinct(own[0], own[1].astype(np.int64))
        count = np.bincount(inverse, count, len(own[0])).astype(np.int32)
        places = [inverse[a:][p] for a, p in zip(sizes, places, strict=False)]
    return *own, count, places


def _dealt(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of grams by bucket, and where each bucket begins."""
    mixed = (key >> np.uint64(40)) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all numbers, the second bytes and so on, which compress well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _written(context: np.ndarray, sign: np.ndarray, count: np.ndarray) -> bytes:
    """Grams and their counts; of each gram only the signs from the first one on that differs from the
    gram before it, place by place."""
    signs_ = np.empty((9, len(context)), np.uint8)
    newest = context.byteswap().view(np.uint8).reshape(-1, 8).T
    signs_[:2], signs_[2], signs_[3:] = newest[:2], sign, newest[2:]
    told = np.zeros(signs_.shape, bool)
    told[:, :1] = True
    np.logical_or.accumulate(signs_[:, 1:] != signs_[:, :-1], axis=0, out=told[:, 1:])
    often = count.astype(np.uint32)
    parts = [len(context).to_bytes(8, "little"), told.sum(0, dtype=np.uint8).tobytes(), _planes(often)]
    return b"".join([*parts, *(own[some].tobytes() for own, some in zip(signs_, told, strict=True))])


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, signs and counts that were written."""
    n = int.from_bytes(data[:8], "little")
    told = np.frombuffer(data, np.uint8, n, 8)
    count, start = _numbers(data[8 + n : 8 + 5 * n], np.uint32), 8 + 5 * n
    signs_ = np.empty((n, 9), np.uint8)
    for k in range(9):
        some = told >= 9 - k
        size = int(some.sum())
        signs_[:, k] = np.frombuffer(data, np.uint8, size, start)[np.cumsum(some) - 1]
        start += size
    newest = np.ascontiguousarray(signs_[:, [0, 1, 3, 4, 5, 6, 7, 8]])
    return newest.view(np.uint64).ravel().byteswap(), signs_[:, 2], count


def _runs(values: np.ndarray) -> bytes:
    """Floats of which equal neighbours are told once."""
    new = np.append(True, values[1:] != values[:-1])[: len(values)]
    return len(values).to_bytes(8, "little") + np.packbits(new).tobytes() + values[new].tobytes()


def _values(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    bits = (n + 7) // 8
    new = np.unpackbits(np.frombuffer(data, np.uint8, bits, 8), count=n)
    return np.frombuffer(data, np.float32, offset=8 + bits)[np.cumsum(new, dtype=np.int64) - 1]


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(data, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""


def _unit_words(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a unit, with 0 for the end of each text, and the text of each."""
    ends = np.flatnonzero(stream == END) + 1
    every, texts, start = [], [], 0
    while start < len(ends):
        begun = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, begun + STEP, "right")), start + 1)
        bounds = np.append(0, ends[start:stop] - begun)
        own, first = words(stream[begun : ends[stop - 1]], bounds)
        rows = np.arange(start, stop)
        every += [own, np.zeros(len(rows), np.uint64)]
        texts += [np.repeat(rows, np.diff(first)), rows]
        start = stop
    return np.concatenate(every), np.concatenate(texts)


def _dealt_words(word: np.ndarray, buckets: int) -> np.ndarray:
    """Where the words of each bucket begin among sorted ones."""
    bucket = ((word >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _asked(units: DataFrame, depth: int, buckets: int, word_buckets: int) -> DataFrame:
    """``unit, bucket, grams``: the distinct grams of each unit with their counts, by bucket; words
    and their counts by further buckets."""

    def asks(row: dict) -> pa.RecordBatch:
        stream, learned = _opened(row)
        word, text = _unit_words(stream)
        own = learned[text]
        word, count = _merged(word[own], word[~own])
        first = _dealt_words(word, word_buckets)
        places = np.flatnonzero(np.diff(first))
        asked_words = [
            _packed(_planes(np.diff(word[a:b], prepend=np.uint64(0))) + _planes(count[a:b]))
            for a, b in zip(first[places], first[places + 1], strict=True)
        ]
        del word, text, own, count
        key, old, count, _ = _unit(stream, learned, depth, placed=False)
        order, first = _dealt(key, buckets)
        some = np.flatnonzero(np.diff(first))
        blobs = []
        for a, b in zip(first[some], first[some + 1], strict=True):
            own = order[a:b]
            context = (key[own] & ~np.uint64(255)) | old[own]
            blobs.append(_packed(_written(context, key[own].astype(np.uint8), count[own])))
        columns = [
            pa.array(np.full(len(some) + len(places), row["unit"]), pa.int64()),
            pa.array(np.append(some, buckets + places), pa.int32()),
            pa.array(blobs + asked_words, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["unit", "bucket", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # what one unit takes is given back before the next
                yield asks(batch.slice(k, 1).to_pylist()[0])

    return arrow(units, run, "unit long, bucket int, grams binary")


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    stream = np.frombuffer(_unpacked(row["stream"]), np.uint8)
    return stream, np.array(row["learned"], object) == True  # noqa: E712, null is not learned from


def chances(
    key: np.ndarray,
    old: np.ndarray,
    count: np.ndarray,
    tree: Tree,
    depth: int = DEPTH,
    least: int = LEAST,
    divergence: float = DIVERGENCE,
) -> np.ndarray:
    """Natural logarithms of the chances of distinct grams by their longest retained suffix.

    The grams must be all those whose context has the same last ``SHORT`` + 1 signs, of any number of
    such endings; grams with a count of 0 are scored and not learned from.
    """
    sign = (key & np.uint64(255)).astype(np.int64)
    context = (key & ~np.uint64(255)) | old
    found = tree.logs(context, sign)
    inside = np.ones(len(key), bool)  # whether a context of the length is within the text
    for length in range(2, depth + 1):
        inside &= (context >> np.uint64(64 - 8 * (length - 1))) & np.uint64(255) != END
        if length <= SHORT or not inside.any():
            continue
        own = context[inside] >> np.uint64(64 - 8 * length)
        if length < 8:
            pair, at, place = np.unique(
                (own << np.uint64(8)) | key[inside] & np.uint64(255),
                return_index=True,
                return_inverse=True,
            )
            own, times = pair >> np.uint64(8), np.bincount(place, count[inside], len(pair))
        else:  # every gram is one pair
            at = np.argsort(own, kind="stable")
            place = np.empty(len(at), np.int64)
            place[at] = np.arange(len(at))
            own, times = own[at], count[inside][at].astype(float)
        above = found[inside][at]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        often = np.diff(np.append(start, len(own)))
        size = np.add.reduceat(times, start)
        kinds = np.add.reduceat((times > 0).astype(float), start)
        saved = np.add.reduceat(times * (np.log(np.maximum(times, 1)) - above), start)
        saved -= size * np.log(np.maximum(size, 1))
        keep = (size >= least) & (saved >= divergence * size) & (saved >= EVIDENCE * kinds)
        kinds, size, keep = (np.repeat(c, often) for c in (kinds, size, keep))
        smooth = above.copy()
        own = (times + kinds * np.exp(above))[keep] / (size + kinds)[keep]
        smooth[keep] = np.log(own)
        found[inside] = smooth[place]
    return found


def _answered(asked: DataFrame, tree, depth: int, least: int, buckets: int) -> DataFrame:
    """``unit, bucket, found``: log10 of the chances of the grams that each unit asked for.

    For words it is their counts in all units, after the sum of the bucket's counts and the number of
    its words with a count, which are told to one unit only.
    """
    names = ["unit", "bucket", "found"]

    def counted(table: pa.Table) -> pa.Table:
        parts, counts = [], []
        for blob in table.column("grams"):
            data = _unpacked(blob.as_py())
            n = len(data) // 12
            parts.append(np.cumsum(_numbers(data[: 8 * n], np.uint64), dtype=np.uint64))
            counts.append(_numbers(data[8 * n :], np.int32))
        sizes = np.cumsum([0, *map(len, parts)])
        word, place = np.unique(np.concatenate(parts), return_inverse=True)
        count = np.bincount(place, np.concatenate(counts), len(word)).astype(np.int64)
        told, blobs = np.array([count.sum(), (count > 0).sum()]), []
        for a, b in zip(sizes, sizes[1:], strict=False):
            blobs.append(_packed(_planes(np.concatenate([told, count[place[a:b]]]))))
            told = np.zeros(2, np.int64)
        columns = [table.column("unit"), table.column("bucket"), pa.array(blobs, pa.binary())]
        return pa.Table.from_arrays(columns, names)

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= buckets:
            return counted(table)
        keys, olds, counts = [], [], []
        for blob in table.column("grams"):
            context, sign, count = _read(_unpacked(blob.as_py()))
            keys.append((context & ~np.uint64(255)) | sign)
            olds.append(context.astype(np.uint8))
            counts.append(count)
        sizes = np.cumsum([0, *map(len, keys)])
        key, old, place = _distinct(np.concatenate(keys), np.concatenate(olds).astype(np.int64))
        count = np.bincount(place, np.concatenate(counts), len(key))
        del keys, olds, counts
        found = (chances(key, old, count, tree.value, depth, least) / np.log(10)).astype(np.float32)
        blobs = [_packed(_runs(found[place[a:b]])) for a, b in zip(sizes, sizes[1:], strict=False)]
        columns = [table.column("unit"), table.column("bucket"), pa.array(blobs, pa.binary())]
        return pa.Table.from_arrays(columns, names)

    return asked.groupBy("bucket").applyInArrow(run, "unit long, bucket int, found binary")


def _scored(units: DataFrame, answered: DataFrame, depth: int, buckets: int, kind: str) -> DataFrame:
    """``text, doc_id, train, n, known, base, score`` of every text of the units, of ids of a ``kind``;
    ``base`` is before its divisor.

    One more row a unit, without ``text``, has in ``n`` and ``known`` what word buckets told it.
    """
    names = ["text", "doc_id", "train", "n", "known", "base", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (unit,) = left.select(["stream", "learned"]).to_pylist()
        stream, learned = _opened(unit)
        ids, train = (left.column(c).combine_chunks().flatten() for c in ("ids", "learned"))
        number = np.asarray(right.column("bucket"))
        order = np.argsort(number)
        blobs, of_words = right.column("found"), number[order] >= buckets
        told, counts = np.zeros(2, np.int64), []
        for k in order[of_words].tolist():
            values = _numbers(_unpacked(blobs[k].as_py()), np.int64)
            told += values[:2]
            counts.append(values[2:])
        count = np.concatenate(counts)
        word, text = _unit_words(stream)
        every = np.unique(word)
        c = count[_located(word, every, _tables(every))]
        rows = int(text[-1]) + 1
        n, known = np.bincount(text, minlength=rows), np.bincount(text[c > 0], minlength=rows)
        base = np.bincount(text, np.log10(c + 0.5), rows)
        del word, every, text, c, count, counts

        key, _, _, places = _unit(stream, learned, depth)
        dealt, _ = _dealt(key, buckets)
        found = np.empty(len(key), np.float32)
        del key
        found[dealt] = np.concatenate(
            [_values(_unpacked(blobs[k].as_py())) for k in order[~of_words].tolist()]
        )
        sums, total = np.zeros(len(stream) + 1), 0.0
        for k, place in enumerate(places):
            own = sums[k * STEP + 1 : k * STEP + 1 + len(place)]
            np.cumsum(found[place], dtype=float, out=own)
            own += total
            total = own[-1]
        ends = np.flatnonzero(stream == END) + 1
        score = sums[ends] - sums[np.append(0, ends[:-1])]
        columns = [
            pa.array([*range(rows), None], pa.int32()),
            pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
            pa.concat_arrays([train, pa.nulls(1, train.type)]),
            pa.array(np.append(n, told[0]), pa.int64()),
            pa.array(np.append(known, told[1]), pa.int64()),
            pa.array(np.append(base, 0.0)),
            pa.array(np.append(score, 0.0)),
        ]
        return pa.Table.from_arrays(columns, names)

    pairs = units.groupBy("unit").cogroup(answered.groupBy("unit"))
    numbers = "n long, known long, base double, score double"
    return pairs.applyInArrow(run, f"text int, doc_id {kind}, train boolean, {numbers}")


def scores(documents: DataFrame, train, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``train`` is a condition on the row that says whether the text is learned from. Tokens are the
    words and one end; ``base_score`` is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))) over them,
    ``score`` the log10 probability of the text under the tree. Null texts are empty and have the end
    only. Rows are kept one by one, repeated ones too (and count as often as they are there); other
    columns are left out. Without training texts all counts are 0.
    """
    kind = dict(documents.dtypes)["doc_id"]
    texts = documents.select("doc_id", train.alias("train"), "text")
    tree = grow(texts.select("train", "text"), min(depth, SHORT), least)
    context = documents.sparkSession.sparkContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        streams, ids, learned = [], [], []

        def unit():
            columns = [pa.array([number], pa.int64()), pa.array([_packed(np.concatenate(streams).tobytes())], pa.binary())]
            for own in map(pa.concat_arrays, (ids, learned)):
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))
            return pa.RecordBatch.from_arrays(columns, ["unit", "stream", "ids", "learned"])

        for piece in pieces(batches, "text"):
            streams.append(signs(*utf8(piece.column("text")))[0][1:])
            ids.append(piece.column("doc_id"))
            learned.append(piece.column("train"))
            if sum(map(len, streams)) >= UNIT:
                yield unit()
                number, streams, ids, learned = number + 1, [], [], []
        if streams:
            yield unit()

    schema = f"unit long, stream binary, ids array<{kind}>, learned array<boolean>"
    # dealt once: what asks and what is scored read the same shuffle
    units = arrow(texts, run, schema).repartition("unit")
    buckets = max(tree.total // SPREAD, 16)
    asked = _asked(units, depth, buckets, max(buckets // 4, 4))
    answered = _answered(asked, context.broadcast(tree), depth, least, buckets)
    scored = kept(_scored(units, answered, depth, buckets, kind))
    told = scored.where("text IS NULL").agg(F.sum("n"), F.sum("known")).first()
    total, distinct = (x or 0 for x in told)
    divisor = math.log10(total + 0.5 * (distinct + 1))
    return scored.where("text IS NOT NULL").select(
        "doc_id",
        "train",
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n") * F.lit(divisor)).alias("base_score"),
        "score",
    )
