"""Distinct word shingles of whole texts as sorted 64-bit hashes, a batch of texts at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from reviewloom.llm.token_counts import CHUNK, text_bytes, word_spans

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)

_powers: list[np.ndarray] = []


def _power_tables(size: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        for base in (_BASE, _INVERSE):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers.append(np.cumprod(factors, dtype=np.uint64))
        del _powers[:-2]
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word with A-Z in lower case, from one running sum over all bytes."""
    powers, inverse = _power_tables(max(len(data), CHUNK) + 1)
    running = np.empty(len(data) + 1, np.uint64)
    running[0] = 0
    np.cumsum(_LOWER[data] * powers[: len(data)], dtype=np.uint64, out=running[1:])
    return mixed((running[starts + lengths] - running[starts]) * inverse[starts] + lengths.astype(np.uint64))


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `width` words. A text with fewer words has its whole
    sequence as its one shingle; a null, empty or blank text has none."""
    data, first = text_bytes(texts)
    starts, lengths = word_spans(data)
    words = word_hashes(data, starts, lengths)
    ends = np.searchsorted(starts, np.append(first[1:], len(data)))
    begins = np.concatenate([[0], ends[:-1]])
    weights = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        runs += words[k: k + len(runs)] * weights[k]
    runs = mixed(runs)
    out = []
    for b, e in zip(begins.tolist(), ends.tolist()):
        if e - b >= width:
            out.append(np.unique(runs[b: e - width + 1]))
        elif e > b:
            out.append(mixed((words[b:e] * weights[: e - b]).sum(dtype=np.uint64, keepdims=True) + np.uint64(e - b)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
