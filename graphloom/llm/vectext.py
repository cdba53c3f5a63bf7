"""Vectorised text helpers that run inside Spark tasks: words, hashes and shingles.

A *word* is a run of bytes outside space and ``\\x09-\\x0D``; since those are ASCII, words can be
found on UTF-8 bytes. Texts are handled in chunks of a few MB, so that memory follows the chunk
(or the longest single text), never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
CHUNK_BYTES = 2_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_POWER_BASE = 0x9E3779B97F4A7C15
_WEIGHTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U64)
_powers = np.ones(1, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 64), _POWER_BASE, dtype=U64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def chunks(texts: list[bytes], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of the list whose texts have about ``size`` bytes together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def hashed_words(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts in order, and for each text the index of its first word (one more at the end)."""
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes + 1)  # a separator follows every text
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(starts, np.concatenate([[0], ends]))
    if not len(starts):
        return np.zeros(0, dtype=U64), first
    lens = stops - starts
    before = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(before, lens)
    values = (data[inside].astype(U64) + U64(1)) * powers(int(lens.max()))[place]
    return mix(np.add.reduceat(values, before) ^ (lens.astype(U64) << U64(56))), first


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its 5-word shingles (A-Z lowered).

    With one to four words, the whole sequence is the only shingle; without words, none.
    """
    for a, b in chunks(texts):
        words, first = hashed_words(texts[a:b], lower=True)
        n = len(words)
        rows = np.zeros(max(n - 4, 0), dtype=U64)
        for k in range(5 if n >= 5 else 0):
            rows += words[k : n - 4 + k] * _WEIGHTS[k]
        rows = mix(rows)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= 5:
                yield np.unique(rows[lo : hi - 4])
            elif hi > lo:
                short = words[lo:hi] * _WEIGHTS[: hi - lo]
                yield mix(np.array([int(short.sum(dtype=U64)) ^ (hi - lo)], dtype=U64))
            else:
                yield np.zeros(0, dtype=U64)
