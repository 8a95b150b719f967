"""Word shingles of texts as 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

import hashlib

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of a word that is hashed by a polynomial, which long regular words could share whatever the base; longer ones by BLAKE2.
SHORT = 32
#: Powers of the base modulo 2^64 and of its inverse, extended as longer texts come.
_powers = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def _upto(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = np.uint64(_BASE if kind == "base" else pow(_BASE, -1, 1 << 64))
        out = np.full(max(n, 1 << 16), step)
        out[0] = 1
        _powers[kind] = np.cumprod(out)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word in bytes; words are runs of other bytes than space and 9 to 13, A to Z in lower case."""
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_BREAK[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = end - start
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _upto("base", len(data)), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _upto("inverse", len(data) + 1)[start] ^ length.astype(np.uint64))
    for w in np.flatnonzero(length > SHORT).tolist():
        hashes[w] = int.from_bytes(hashlib.blake2b(data[start[w] : end[w]], digest_size=8).digest(), "little")
    return hashes, start, end


def shingle_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n-word shingle in order; of the whole sequence if it is shorter; none without words."""
    n = min(n, len(word_hashes))
    if n == 0:
        return np.zeros(0, np.uint64)
    out = word_hashes[: len(word_hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(3) + word_hashes[k : len(word_hashes) - n + 1 + k])
    return out


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(words(text)[0], n))


def set_name(shingles: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def min_hashes(shingles: np.ndarray, factors: np.ndarray, block: int = 4096) -> np.ndarray:
    """The least of (hash * odd factor) mod 2^64, high half, for each factor; sets are passed over in blocks."""
    out = np.full(len(factors), np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), block):
        np.minimum(out, (shingles[None, k : k + block] * factors[:, None]).min(axis=1), out=out)
    return out


def odd_factors(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)) | np.uint64(1)
