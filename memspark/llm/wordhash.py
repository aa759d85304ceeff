"""Vectorised words and word hashes of Arrow string columns (numpy inside tasks).

A word is a maximal run of bytes that are not ASCII white space; A-Z may be lower-cased first.
Words get 64-bit hashes: the sum of a random number per byte times a power of an odd base by position,
then a finaliser.  Two different words of one corpus of 10^9 words collide with a chance of about 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240131)
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 64)
        _POWERS = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _BASE, np.uint64))))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, hashes of all words) of the texts data[offsets[i]:offsets[i + 1]]."""
    at = offsets - offsets[0]
    data = data[offsets[0] : offsets[-1]]
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = ~space[begins]
    starts = np.flatnonzero(first)
    counts = np.searchsorted(starts, at[1:]) - np.searchsorted(starts, at[:-1])
    if not len(starts):
        return counts, np.zeros(0, np.uint64)
    word = np.cumsum(first, dtype=np.int32) - 1
    word[: starts[0]] = 0
    place = np.arange(len(data), dtype=np.int32) - starts.astype(np.int32)[word]
    place[space] = 0
    values = (_LOWER if lower else _BYTES)[data]
    values[space] = 0
    values *= _powers(int(place.max()) + 1)[place]
    values[: starts[0]] = 0
    return counts, mix(np.add.reduceat(values, starts))


def word_chunks(texts: pa.Array, lower: bool = True, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (index of the first text, words of each text, hashes of all their words) for runs of texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, offsets = _buffers(texts)
    i, n = 0, len(texts)
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + chunk, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield (i, *_hash_words(data, offsets[i : j + 1], lower))
        i = j


_TURNS = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def shingles(counts: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles: (shingles of each text, hashes ordered by text, then hash).

    A text with fewer words, but at least one, has its whole word sequence as one shingle.
    """
    n, docs = len(hashes), np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    parts, owners = [], []
    if n >= width:
        h = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            h = mix(h * _TURNS[k % 6] + hashes[k : n - width + 1 + k])
        whole = docs[: n - width + 1] == docs[width - 1 :]
        parts.append(h[whole])
        owners.append(docs[: n - width + 1][whole])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begins = np.concatenate(([0], np.cumsum(counts)))[short]
        h = mix(counts[short].astype(np.uint64) * _TURNS[5])
        for k in range(width - 1):
            has = counts[short] > k
            h[has] = mix(h[has] * _TURNS[k % 6] + hashes[begins[has] + k])
        parts.append(h)
        owners.append(short)
    if not parts:
        return np.zeros(len(counts), np.int64), np.zeros(0, np.uint64)
    h, d = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return np.bincount(d, minlength=len(counts)), h
