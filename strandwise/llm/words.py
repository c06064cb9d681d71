"""Words of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

#: ASCII white space, which ends a word.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E6C63D0876A9A35  # odd, so that it has an inverse
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit hashes over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer with a space after each, and where each begins, and the end."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=begin[1:])
    return np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8), begin


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts in order, and where each text's words begin (one more
    entry: the end); the buffer, and the words' first and last byte in it.

    A word's hash is its polynomial at a fixed base modulo 2^64, mixed. Two different words get one hash with a chance
    of about 2^-64.
    """
    buf, begin = joined(texts)
    if not len(texts):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), np.zeros(1, dtype=np.int64), buf, none, none
    word = ~_SPACE[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    first, end = edge[0::2], edge[1::2]  # the buffer ends with a space
    power, inverse = _power(len(buf) + 1)
    part = buf.astype(np.uint64)
    part += np.uint64(1)
    part *= power[: len(buf)]
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(part, out=total[1:])
    h = mix((total[end] - total[first]) * inverse[first])
    return h, np.searchsorted(first, begin), buf, first, end - 1


def batches(texts: list[bytes], most: int = 1 << 21):
    """Slices of texts of about most bytes."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
