"""Vectorised 64-bit hashing and window minima shared by the text operators."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}
_powers = {"p": np.ones(1, U), "inv": np.ones(1, U)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _grow(n: int) -> None:
    have = len(_powers["p"])
    if have < n:
        n = max(n, 2 * have)
        for name, base in (("p", _P), ("inv", _P_INV)):
            out = np.full(n, base, U)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)


def byte_values(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """A random 64-bit value for each byte."""
    if seed not in _tables:
        _tables[seed] = mix64(np.arange(1, 257, dtype=U) * U(_P) + U(seed))
    return _tables[seed][data]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of values[t] * P**t over i <= t < j (mod 2**64)."""
    n = len(values)
    _grow(n + 1)
    out = np.zeros(n + 1, U)
    np.cumsum(values * _powers["p"][:n], out=out[1:])
    return out


def window_hashes(prefix: np.ndarray, width: int) -> np.ndarray:
    """A mixed 64-bit hash of each run of ``width`` values; empty where there are fewer."""
    n = len(prefix) - width
    if n <= 0:
        return np.empty(0, U)
    return mix64((prefix[width:] - prefix[:-width]) * _powers["inv"][:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values, by block-wise prefix and suffix minima."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    if w == 1:
        return x.copy()
    pad = -len(x) % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]) if pad else x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def run_starts(x: np.ndarray) -> np.ndarray:
    """Indices at which a run of equal values begins."""
    if not len(x):
        return np.empty(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, remembering a bounded number of words per worker."""

    def __init__(self, bound: int = 100_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_word_hashes = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word_hashes.__getitem__, words), U, len(words))
