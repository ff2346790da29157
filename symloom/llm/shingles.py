"""Word shingles of whole texts as sets of 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case. A shingle
is ``size`` words; a text of fewer words has its whole sequence as the one
shingle, a text without words has none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """Hash of a word, remembered up to a bound."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, "u8")
    w = np.fromiter(map(_words.__getitem__, words), "u8", len(words))
    n = min(size, len(w))
    out = np.full(len(w) - n + 1, n, "u8")
    for i in range(n):
        out = out * _MUL + w[i : len(w) - n + 1 + i]
    out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return np.unique(out)


def digest(s: np.ndarray) -> bytes:
    """Equal for equal sets only."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class MinHash:
    """count independent minima of a set of 64-bit hashes, 32 bits of each kept."""

    def __init__(self, count: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.xor = rng.integers(0, 2**63, count, dtype="u8")[:, None] * np.uint64(2) + np.uint64(1)
        self.mul = rng.integers(0, 2**63, count, dtype="u8")[:, None] * np.uint64(2) + np.uint64(1)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.xor), 2**64 - 1, "u8")
        for at in range(0, len(s), 4096):
            low = np.minimum(low, ((s[None, at : at + 4096] ^ self.xor) * self.mul).min(axis=1))
        return (low >> np.uint64(32)).astype("u4")


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a and b| >= num * |a or b| on full sets."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not small or den * small < num * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)
