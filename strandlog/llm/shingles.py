"""Word shingles of Arrow text columns as 64-bit hashes, in NumPy.

The bytes of many texts are hashed together: A-Z lowered by a table, words found by a white-space table, each word's
polynomial hash taken from prefix sums, shingles mixed from the hashes of consecutive words of one text. Work goes in
slices of some two million bytes, so the arrays stay small; a single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SLICE = 2_000_000
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] = np.arange(97, 123) + 1
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SLICE, side="right")) - 1)
        yield at, to
        at = to


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words in order, and for each text the number of words before it (and the total)."""
    word = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets[:-1]] = True
    edge[-1] = True
    before = np.concatenate(([False], word[:-1])) & ~edge[:-1]
    starts = np.flatnonzero(word & ~before)
    after = np.concatenate((word[1:], [False])) & ~edge[1:]
    ends = np.flatnonzero(word & ~after) + 1
    powers, inverses = _powers(len(data) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_LOWER[data] * powers[: len(data)], dtype=np.uint64)))
    hashes = (sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64)
    return mix64(hashes), np.searchsorted(starts, offsets)


def _joined(hashes: np.ndarray, n: int, k: int) -> np.ndarray:
    """The hash of each run of k words among n."""
    if n < k:
        return np.zeros(0, np.uint64)
    out = np.full(n - k + 1, np.uint64(k * 0xD6E8FEB86659FD93 % 2**64), dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + hashes[j : n - k + 1 + j]
        out ^= out >> np.uint64(29)
    return mix64(out)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles' hashes, ascending; the whole sequence as one if it has fewer words,
    none if it has no words (or is null)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    buffers = texts.buffers()
    all_offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    all_data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    for at, to in _slices(all_offsets) if len(texts) else ():
        low, high = int(all_offsets[at]), int(all_offsets[to])
        if low == high:
            yield from (np.zeros(0, np.uint64) for _ in range(at, to))
            continue
        hashes, words = _word_hashes(all_data[low:high], all_offsets[at : to + 1] - low)
        joined = _joined(hashes, len(hashes), k)
        for first, last in zip(words[:-1].tolist(), words[1:].tolist()):
            if last - first >= k:
                got = np.sort(joined[first : last - k + 1])
                yield got[np.concatenate(([True], got[1:] != got[:-1]))]
            elif last > first:
                yield _joined(hashes[first:last], last - first, last - first)
            else:
                yield np.zeros(0, np.uint64)
