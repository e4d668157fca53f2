"""Vectorised hashes of words and of runs of words.

Words are runs of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return. A word is known by two independent 64-bit hashes of its
eight-byte pieces, each mixed before the next comes in, so that no pattern of
letters collapses. Hashes are the same on every worker.
"""

from __future__ import annotations

import hashlib

import numpy as np

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
#: Words longer than this are hashed one by one.
LONG_WORD = 256
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher of splitmix64: a bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 19), b, np.uint64)]) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


#: Keeps the first 0 to 8 bytes of a little-endian piece.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def word_digests(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(two hashes of every word of every text in order, as columns; words per text)."""
    raw = np.frombuffer(b" ".join(texts) + b" " * 8, np.uint8)
    white = _WHITE[raw]
    if lower:
        raw = _LOWER[raw]
    edge = np.flatnonzero(np.diff(white, prepend=True))  # alternately first byte of a word and first white byte after it
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    pieces = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    out = np.empty((len(starts), 2), np.uint64)
    for column in (0, 1):
        out[:, column] = mix(size.astype(np.uint64) * np.uint64(_BASE) + _ODD[column])
    own = np.arange(len(starts))
    for at in range(0, LONG_WORD, 8):
        piece = pieces[starts[own] + at] & _FIRST[np.minimum(size[own] - at, 8)]
        for column in (0, 1):
            out[own, column] = mix((out[own, column] ^ (piece * _ODD[column])) + np.uint64(at + column))
        own = own[size[own] > at + 8]
        if not len(own):
            break
    for i in own.tolist():
        out[i] = np.frombuffer(hashlib.blake2b(raw[starts[i]:ends[i]].tobytes(), digest_size=16).digest(), np.uint64)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return out, np.diff(np.searchsorted(starts, first))


def shingle_words(digests: np.ndarray) -> np.ndarray:
    """The two hashes of each word as one of 64 bits, in one column."""
    return (mix(digests[:, 0] + _ODD[1]) + digests[:, 1] * _ODD[0])[:, None]


def _factors(n: int, column: int, salt: int) -> np.ndarray:
    """An odd factor for each place in a run."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(2 * salt + column)) | np.uint64(1)


def run_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """64-bit hash of every run of n consecutive words; one fewer than n less than there are words."""
    return run_hashes_at(words, slice(0, max(0, len(words) - n + 1)), n, salt)


def run_hashes_at(words: np.ndarray, at: np.ndarray | slice, n: int, salt: int = 0, column: int = 0) -> np.ndarray:
    """64-bit hashes of the runs of n words that begin at the given places, from one column of the digests."""
    own = words[:, column]
    out = np.uint64(n)
    for k, factor in enumerate(_factors(n, column, salt)):
        out = out + own[at.start + k: at.stop + k if at.stop else 0] * factor if isinstance(at, slice) else out + own[at + k] * factor
    return mix(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; all words as one if there are fewer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(words, min(n, len(words))))
