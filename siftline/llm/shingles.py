"""Word and shingle hashes of many texts at once, in numpy: helpers that run inside tasks on Arrow batches."""

from __future__ import annotations

import numpy as np

_rng = np.random.RandomState(20240601)
_BYTE = _rng.randint(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all blank-parted words, text after text, and where each text's words begin (one more than texts)."""
    data = b"\n".join([b"", *((t or "").encode("utf-8", "replace") for t in texts), b""])
    raw = np.frombuffer(data, np.uint8)
    if lower:
        raw = _FOLD[raw]
    blank = _SPACE[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    power = powers(BASE, len(raw) + 1)
    np.cumsum(_BYTE[raw] * power[:-1], out=sums[1:])
    words = mixed((sums[end] - sums[begin]) * powers(INVERSE, len(raw) + 1)[begin] + (end - begin).astype(np.uint64))
    ends = np.cumsum([0, *(len((t or "").encode("utf-8", "replace")) + 1 for t in texts)])
    return words, np.searchsorted(begin, ends + 1)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of each run of size words; of fewer words, though not none, one hash of them all."""
    if not len(words):
        return words
    if len(words) < size:
        size = len(words)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = mixed(out + words[k : len(words) - size + 1 + k] + np.uint64(k + 1))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
