"""Sets of hashed word runs of whole texts, for all texts of a piece at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[9:14] = 32
_SIGNS = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_RUN = 0xD6E8FEB86659FD93


def _u(value: int) -> np.uint64:
    return np.uint64(value)


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _u(_BASE)), np.full(size, _u(_BACK))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A to Z in lower case), and where each text's words begin."""
    low = LOWER[data]
    blank = low == 32
    start = ~blank
    start[1:] &= blank[:-1] | False
    inner = bounds[(bounds > 0) & (bounds < len(low))]
    start[inner] = ~blank[inner]
    end = ~blank
    end[:-1] &= blank[1:]
    end[inner - 1] = ~blank[inner - 1]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _powers(1 << max(1, len(low)).bit_length())
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_SIGNS[low] * up[: len(low)], out=sums[1:])
    return mixed((sums[b] - sums[a]) * down[a]), np.searchsorted(a, bounds)


def runs(data: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run hashes of every text on end, sorted in each text, and where each text's begin.

    A text of fewer words has one run, all its words; one without words has none.
    """
    hashes, first = words(data, bounds)
    counts = np.diff(first)
    many = np.maximum(counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), many)
    offset = np.cumsum(many) - many
    at = np.arange(many.sum()) - offset[text] + first[text]
    length = np.minimum(counts, size)[text]
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    run = length.astype(np.uint64)
    for k in range(size):
        run = run * _u(_RUN) + np.where(k < length, padded[at + k], _u(0))
    run = mixed(run)
    order = np.lexsort((run, text))
    run, text = run[order], text[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    run, text = run[new], text[new]
    return run, np.searchsorted(text, np.arange(len(counts) + 1))
