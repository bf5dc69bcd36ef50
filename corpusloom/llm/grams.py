"""Hashed character n-grams of a text as numpy arrays, for the classifiers."""

from __future__ import annotations

import numpy as np

#: ASCII characters that are no letters count as a space.
_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def letter_codes(text: str | None) -> np.ndarray:
    """Code points of the text in lower case between two spaces."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < 128
    if low.all():
        return _ASCII[codes]
    return np.where(low, _ASCII[np.where(low, codes, 0)], codes)


def gram_hashes(codes: np.ndarray, size: int, bits: int) -> np.ndarray:
    """A bucket below 2**bits for every n-gram of the given size, in order."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = codes[:n] + np.uint32(size * 7919)
    for k in range(1, size):
        h = h * np.uint32(0x9E3779B1) + codes[k : k + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h >> np.uint32(32 - bits)
