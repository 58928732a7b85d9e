"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

A text is split by the vocabulary's pattern, and each match is encoded on its own. Over the byte
positions of a match stands a segment tree whose leaves hold the rank of the pair that begins there;
every node holds the leftmost least rank below it. The root names the next merge, which changes the
leaf of the merged pair, clears the leaf of its right half and renews the leaf of its live left
neighbour: three point updates along the tree's height. Short matches of a batch are merged in
lockstep as rows of one numpy tree, long ones one by one in the same way.

Work is split by Spark's scan; a task holds one piece of a batch and a bounded cache of matches. The
ranks (tens of thousands of short byte strings) travel with the task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tiktoken import Encoding

from burdenlens.llm.common import added, arrow, pieces, replaced, utf8

#: Ranks of pairs sit above the position in a tree key.
_SHIFT = 32
_NEVER = np.iinfo(np.int64).max
#: Matches of at most this many bytes are merged in lockstep.
_LOCKSTEP = 64
#: Encoded matches a task remembers.
_CACHE = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: one base64 string and one rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}


# ---------------------------------------------------------------- splitting

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: What follows an apostrophe in the pattern's contractions (fixed values).
_SHORT, _LONG = "stmd", ("re", "ve", "ll")


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point. The engine whose ids are to be met is asked which it takes for
    letters, numbers and white space, as engines follow different versions of Unicode."""
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        asked = Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(asked.encode_ordinary(everything)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


def split(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position at which each match of the pattern begins, and the number of the first match of
    every text (one more for the end).

    The pattern is the one of the given vocabularies: a contraction; letters, numbers or other signs,
    each with a space before them at most; white space up to the last one before something else.
    """
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=at[1:])
    first = np.searchsorted(at, bounds)  # code points at which the texts begin
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    kind = _classes()[points]
    begin = opens[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]  # runs of one class
    ends_run = np.ones(n, bool)
    ends_run[:-1] = begin[1:]
    ends_text = opens[1 : n + 1]
    # the last white space before something else stands alone, or goes with it if it is a space
    last = (kind == _SPACE) & ends_run & ~ends_text
    begin |= last
    joined = np.zeros(n, bool)
    joined[1:] = (last & (points == 32))[:-1]
    begin &= ~joined
    # contractions: an apostrophe of its own, not joined to a space, and certain letters behind it
    quote = np.flatnonzero((points == 39) & begin)
    quote = quote[quote + 1 < n]
    quote = quote[begin[quote + 1] & ~opens[quote + 1]]
    if len(quote):
        next1 = points[quote + 1]
        has2 = (quote + 2 < n) & ~opens[np.minimum(quote + 2, n)]
        next2 = np.where(has2, points[np.minimum(quote + 2, n - 1)], 0)
        size = np.isin(next1, [ord(c) for c in _SHORT]).astype(np.int64)
        for pair in _LONG:
            size[(next1 == ord(pair[0])) & (next2 == ord(pair[1]))] = 2
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        after = quote + 1 + size
        inside = after < n
        begin[after[inside]] |= kind[after[inside]] == _LETTER
    starts = np.flatnonzero(begin)
    return at[starts], np.searchsorted(starts, first)


# ---------------------------------------------------------------- merging


class Merger:
    """Encodes matches by the ranks of pairs; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.base = max(ranks.values(), default=0) + 1
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        # open addressing, an eighth full at most, so that a look-up takes one or two steps
        self.bits = max(4, (8 * len(pairs)).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.merged = np.full(len(self.keys), -1, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]  # of those that want a slot, one gets it
            placed = self.keys[slot] == keys[left]
            left, slot = left[~placed], slot[~placed] + 1
        place = self._find(keys)
        self.merged[place] = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.seen: dict[bytes, int] = {}
        self.forget()

    def forget(self) -> None:
        self.seen.clear()
        self.flat = np.zeros(0, np.int32)
        self.size, self.offset = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Slot that holds the key, or an empty one."""
        slot = self._slot(key)
        found = self.keys[slot]
        off = np.flatnonzero((found != key) & (found >= 0))
        while len(off):
            slot[off] += 1
            found = self.keys[slot[off]]
            off = off[(found != key[off]) & (found >= 0)]
        return slot

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.merged[self._find(left * self.base + right)]

    def lockstep(self, matches: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all matches on end, and how many each has; ``wide`` is a power of two."""
        m = len(matches)
        sizes = np.fromiter(map(len, matches), np.int64, m)
        filled = np.arange(wide) < sizes[:, None]
        token = np.full((m, wide), -1, np.int64)
        token[filled] = self.bytes[np.frombuffer(b"".join(matches), np.uint8)]
        after = np.tile(np.arange(1, wide + 1), (m, 1))
        after[after >= sizes[:, None]] = wide
        before = np.tile(np.arange(-1, wide - 1), (m, 1))
        tree = np.full((m, 2 * wide), _NEVER, np.int64)
        has = filled[:, 1:]
        rank = self._rank(token[:, :-1][has], token[:, 1:][has])
        place = np.broadcast_to(np.arange(wide - 1), has.shape)[has]
        tree[:, wide : 2 * wide - 1][has] = np.where(rank >= 0, rank << _SHIFT | place, _NEVER)
        for node in range(wide - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        rows = np.flatnonzero(tree[:, 1] != _NEVER)
        # from here on by flat places: row * wide (or twice that) + position
        token, live = token.ravel(), filled.ravel()
        after, before, tree = after.ravel(), before.ravel(), tree.ravel()

        def update(rows, position, key):
            base, node = rows * (2 * wide), position + wide
            tree[base + node] = key
            height = wide.bit_length() - 1
            for _ in range(height):
                node >>= 1
                below = base + 2 * node
                tree[base + node] = np.minimum(tree[below], tree[below + 1])

        def pair(rows, left, right):
            """The key of the pair at two live positions; ``wide`` is none."""
            real = np.flatnonzero(right < wide)
            key = np.full(len(rows), _NEVER, np.int64)
            own, a = rows[real] * wide, left[real]
            rank = self._rank(token[own + a], token[own + right[real]])
            key[real] = np.where(rank >= 0, rank << _SHIFT | a, _NEVER)
            return key

        while len(rows):
            own = rows * wide
            least = tree[rows * (2 * wide) + 1]
            here = least & ((1 << _SHIFT) - 1)
            gone = after[own + here]
            beyond = after[own + gone]
            token[own + here] = least >> _SHIFT
            live[own + gone] = False
            after[own + here] = beyond
            more = np.flatnonzero(beyond < wide)
            before[own[more] + beyond[more]] = here[more]
            update(rows, gone, _NEVER)
            update(rows, here, pair(rows, here, beyond))
            left = before[own + here]
            some = np.flatnonzero(left >= 0)
            update(rows[some], left[some], pair(rows[some], left[some], here[some]))
            rows = rows[tree[rows * (2 * wide) + 1] != _NEVER]
        return token[live], live.reshape(m, wide).sum(1)

    def alone(self, match: bytes) -> list[int]:
        """Ids of one match of any length, by the same tree."""
        wide = 1 << (len(match) - 1).bit_length()
        token = [int(self.bytes[b]) for b in match]
        n = len(token)
        after, before = [*range(1, n), wide], list(range(-1, n - 1))
        tree = [_NEVER] * (2 * wide)

        def pair(left, right):
            if left < 0 or right >= wide:
                return _NEVER
            rank = self.pairs.get(token[left] * self.base + token[right])
            return _NEVER if rank is None else rank << _SHIFT | left

        def update(position, key):
            node = position + wide
            tree[node] = key
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        for k in range(n - 1):
            tree[wide + k] = pair(k, k + 1)
        for node in range(wide - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != _NEVER:
            here = tree[1] & ((1 << _SHIFT) - 1)
            gone = after[here]
            beyond = after[gone]
            token[here], token[gone] = tree[1] >> _SHIFT, -1
            after[here] = beyond
            if beyond < wide:
                before[beyond] = here
            update(gone, _NEVER)
            update(here, pair(here, beyond))
            if before[here] >= 0:
                update(before[here], pair(before[here], here))
        return [t for t in token if t >= 0]

    def learn(self, matches: list[bytes]) -> None:
        """Encodes matches not seen yet and keeps their ids, numbered on."""
        size, offset = np.zeros(len(matches), np.int64), np.zeros(len(matches), np.int64)
        single: tuple[list[int], list[int], list[int]] = ([], [], [])
        classes: dict[int, list[int]] = {}
        for k, match in enumerate(matches):
            whole = self.ranks.get(match)
            if whole is None and len(match) <= _LOCKSTEP:
                classes.setdefault(1 << (len(match) - 1).bit_length(), []).append(k)
                continue
            ids = self.alone(match) if whole is None else [whole]
            single[0].append(k)
            single[1].append(len(ids))
            single[2].extend(ids)
        done = [(single[0], np.array(single[2], np.int64), np.array(single[1], np.int64))]
        for wide, members in classes.items():
            step = max(1, (1 << 19) // wide)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                done.append((part, *self.lockstep([matches[k] for k in part], wide)))
        used = len(self.flat)
        for part, flat, sizes in done:
            size[part] = sizes
            offset[part] = used + np.cumsum(sizes) - sizes
            used += len(flat)
        self.flat = np.concatenate([self.flat, *(flat for _, flat, _ in done)]).astype(np.int32)
        self.size = np.concatenate([self.size, size])
        self.offset = np.concatenate([self.offset, offset])

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each text's begin."""
        starts, first = split(data, bounds)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        if len(self.seen) > _CACHE:
            self.forget()
        raw = data.tobytes()
        ends = [*starts[1:].tolist(), len(raw)]
        matches = [raw[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]
        seen = self.seen
        number = np.fromiter(map(seen.get, matches, repeat(-1)), np.int64, len(matches))
        new = np.flatnonzero(number < 0).tolist()
        if new:
            fresh = dict.fromkeys(matches[k] for k in new)
            seen.update(zip(fresh, range(len(seen), len(seen) + len(fresh)), strict=True))
            self.learn([*fresh])
            number[new] = [seen[matches[k]] for k in new]
        count = self.size[number]
        total = np.zeros(len(number) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        place = np.repeat(self.offset[number] - total[:-1], count) + np.arange(total[-1])
        return self.flat[place], total[first]


_mergers: dict[int, Merger] = {}


def _merger(ranks: dict[bytes, int]) -> Merger:
    """One per worker and vocabulary, as building the table of pairs takes a while."""
    key = hash(frozenset(ranks.items()))
    if key not in _mergers:
        _mergers.clear()
        _mergers[key] = Merger(ranks)
    return _mergers[key]


def encode(frame: DataFrame, ranks: dict[bytes, int], text: str = "text") -> DataFrame:
    """The frame with ``ids array<int>``: the text's ids, without special tokens.

    Null and empty texts have no ids. Rows are kept one by one, repeated ones too. A column named ids
    is replaced.
    """
    shared = frame.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = None
        for piece in pieces(batches, text):
            merger = merger or _merger(shared.value)
            ids, first = merger.encode(*utf8(piece.column(text)))
            column = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
            yield replaced(piece, "ids", column)

    return arrow(frame, run, added(frame, "ids array<int>"))


def decode(frame: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """The frame with ``decoded binary``: the bytes of the ids on end; no ids give no bytes.

    An id the vocabulary lacks fails. A column named decoded is replaced.
    """
    shared = frame.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        size = np.full(max(ranks.values(), default=0) + 1, -1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        every = np.maximum(size, 0)
        offset = np.cumsum(every) - every
        blob = np.frombuffer(
            b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8
        )
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                column = part.column(ids)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                length = size[flat]
                if len(length) and length.min() < 0:
                    raise ValueError("an id is not in the vocabulary")
                total = np.zeros(len(flat) + 1, np.int64)
                np.cumsum(length, out=total[1:])
                place = np.repeat(offset[flat] - total[:-1], length) + np.arange(total[-1])
                last = np.zeros(len(counts) + 1, np.int64)
                np.cumsum(counts, out=last[1:])
                buffers = [
                    None,
                    pa.py_buffer(total[last].astype(np.int32).tobytes()),
                    pa.py_buffer(blob[place].tobytes()),
                ]
                bytes_ = pa.Array.from_buffers(pa.binary(), part.num_rows, buffers)
                yield replaced(part, "decoded", bytes_)

    return arrow(frame, run, added(frame, "decoded binary"))
