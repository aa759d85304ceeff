"""Keys that a text shares with every text it is part of, made from whole Arrow batches.

A key is the least hash of the runs of ``k`` bytes that begin in a window of ``w`` places.  A text of ``k + w - 1`` bytes
or more has a window, and each of its windows is one of every text that holds it, with the same least hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are hashed at a time (a longer text is hashed alone).
CHUNK = 1 << 19
_FACTOR = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BYTE = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64)


def levels(least: int) -> list[tuple[int, int]]:
    """(k, w) of the levels for texts of ``least`` bytes or more: longer texts have longer runs in wider windows, so fewer keys."""
    sizes = [least, 3 * least, 12 * least]
    runs = [max(1, least * 3 // 5), least * 8 // 5, least * 16 // 5]
    return [(k, size - k + 1) for k, size in zip(runs, sizes, strict=True)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def _runs(data: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """The hash of the run of each size that begins at each byte, as far as there is one."""
    powers, out = {1: _BYTE[data]}, {}
    n = 1
    while 2 * n <= max(sizes):
        h = powers[n]
        powers[2 * n] = h[: max(0, len(h) - n)] * _FACTOR[n.bit_length()] + h[n:]
        n *= 2
    for size in sizes:
        h, at = None, 0
        for p in sorted(powers, reverse=True):
            if size & p:
                part = powers[p][at:]
                h = part if h is None else h[: len(part)] * _FACTOR[32 + p.bit_length()] + part[: len(h)]
                at += p
        out[size] = mixed(h)
    return out


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    n = 1
    while 2 * n <= w:
        h = np.minimum(h[: max(0, len(h) - n)], h[n:])
        n *= 2
    rest = w - n
    return np.minimum(h[: max(0, len(h) - rest)], h[rest:]) if rest else h


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without nulls."""
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def keys(texts: pa.Array, salts: np.ndarray, least: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, key) of chunks of ``texts``: with ``own`` those of each text's own level, else of every level it reaches.

    ``salts`` sets texts of different kinds apart.  A key comes once a run of equal ones, not once a text.
    """
    at, data = _texts(texts)
    steps = levels(least)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
        size = np.diff(at[first : last + 1])
        text = np.repeat(np.arange(first, last), size)
        left = np.repeat(at[first + 1 : last + 1], size) - np.arange(at[first], at[last])
        runs = _runs(data[at[first] : at[last]], [k for k, _ in steps])
        level = np.searchsorted([k + w - 1 for k, w in steps], size, "right") - 1
        for i, (k, w) in enumerate(steps):
            h = _least(runs[k], w)
            some = left[: len(h)] >= k + w - 1
            if own:
                some &= level[text[: len(h)] - first] == i
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1 : len(h)] != text[: max(0, len(h) - 1)])
            found = np.flatnonzero(some & new)
            # the first window of a text counts whatever stands before it
            ids = text[found]
            yield ids, mixed(h[found] ^ salts[ids] ^ _FACTOR[i])
        first = last
