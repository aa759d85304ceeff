"""Suffix arrays by induced sorting and permuted common-prefix arrays, on numpy arrays that fit a task.

A suffix is S if it is smaller than the next one, else L; an S suffix after an L one is leftmost-smaller (LMS).
LMS substrings are named by their rank; if names repeat, the string of names is sorted recursively.  From the
sorted LMS suffixes one scan to the right places the L suffixes and one to the left the S suffixes, each once.
"""

from __future__ import annotations

import numpy as np

#: Up to this many symbols a scan takes a bucket at a time, beyond it a suffix at a time.
BUCKETS = 512


def classify(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last one is L, since the end is smaller than all."""
    n = len(t)
    at = np.arange(n)
    differs = np.zeros(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    differs[-1:] = True
    # equal symbols have the class of the next place where two neighbours differ
    where = np.minimum.accumulate(np.where(differs, at, n)[::-1])[::-1]
    smaller = np.zeros(n, bool)
    smaller[:-1] = t[:-1] < t[1:]
    return smaller[where]


def name_substrings(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """Ranks, from 0 without gaps, of the substrings from each LMS place to the next one, that included.

    Symbols carry their class, so no substring is a proper beginning of another.  A few symbols are packed in a
    word; a round sorts the words of those that are still tied.
    """
    n, bits = len(t), (2 * k + 1).bit_length()
    per = max(1, 63 // bits)
    u = np.zeros(n + 1, np.int64)
    u[:n] = 2 * t.astype(np.int64) + s + 1
    size = np.append(np.diff(lms) + 1, n - lms[-1] + 1)
    rank = np.zeros(len(lms), np.int64)
    tied, done = np.arange(len(lms)), 0
    while len(tied):
        key = np.zeros(len(tied), np.int64)
        for q in range(done, done + per):
            key = key << bits | np.where(q < size[tied], u[np.minimum(lms[tied] + q, n)], 0)
        old = rank[tied]
        order = np.lexsort((key, old)) if done else np.argsort(key, kind="stable")
        old, key = old[order], key[order]
        group = np.concatenate(([True], old[1:] != old[:-1]))
        run = group | np.concatenate(([True], key[1:] != key[:-1]))
        at = np.arange(len(tied))
        first = np.maximum.accumulate(np.where(run, at, 0))
        rank[tied[order]] = old + first - np.maximum.accumulate(np.where(group, at, 0))
        many = np.bincount(first, minlength=len(tied))[first] > 1
        done += per
        tied = tied[order][many]
        tied = tied[size[tied] > done]
    return np.unique(rank, return_inverse=True)[1]


def induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array from the sorted LMS suffixes."""
    counts = np.bincount(t, minlength=k)
    ends = np.cumsum(counts)
    starts = ends - counts
    return (_by_bucket if k <= BUCKETS else _by_suffix)(t, s, lms, starts, ends)


def _seeded(t: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LMS suffixes at the ends of their buckets, and their number by bucket."""
    sa = np.full(len(t), -1, np.int64)
    own = np.bincount(t[lms], minlength=len(ends))
    symbol = t[lms]
    sa[ends[symbol] - own[symbol] + np.arange(len(lms)) - (np.cumsum(own) - own)[symbol]] = lms
    return sa, own


def _by_bucket(t, s, lms, starts, ends):
    n, k = len(t), len(ends)
    sa, own = _seeded(t, lms, ends)
    head, tail = starts.copy(), ends.copy()
    small = t.astype(np.uint16)

    def push(j: np.ndarray, back: bool) -> None:
        """Places j, in this order, into their buckets: from the head on, or from the tail down."""
        if not len(j):
            return
        symbol = small[j]
        order = np.argsort(symbol, kind="stable")
        j, symbol = j[order], symbol[order]
        many = np.bincount(symbol, minlength=k)
        nth = np.arange(len(j)) - (np.cumsum(many) - many)[symbol]
        if back:
            sa[tail[symbol] - 1 - nth] = j
            np.subtract(tail, many, out=tail)
        else:
            sa[head[symbol] + nth] = j
            np.add(head, many, out=head)

    push(np.array([n - 1]), False)
    used = np.flatnonzero(ends > starts).tolist()
    for c in used:
        done = int(starts[c])
        while done < head[c]:
            now, done = sa[done : head[c]], int(head[c])
            j = now[now > 0] - 1
            push(j[~s[j]], False)
        if own[c]:
            now = sa[ends[c] - own[c] : ends[c]]
            push(now[now > 0] - 1, False)
    for c in reversed(used):
        done = int(ends[c])
        while done > tail[c]:
            now, done = sa[tail[c] : done][::-1], int(tail[c])
            j = now[now > 0] - 1
            push(j[s[j]], True)
        now = sa[starts[c] : head[c]][::-1]
        j = now[now > 0] - 1
        push(j[s[j]], True)
    return sa


def _by_suffix(t, s, lms, starts, ends):
    sa = _seeded(t, lms, ends)[0].tolist()
    n, symbols, kinds, head, tail = len(t), t.tolist(), s.tolist(), starts.tolist(), ends.tolist()
    c = symbols[n - 1]
    sa[head[c]] = n - 1
    head[c] += 1
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not kinds[j]:
            c = symbols[j]
            sa[head[c]] = j
            head[c] += 1
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and kinds[j]:
            c = symbols[j]
            tail[c] -= 1
            sa[tail[c]] = j
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, k: int = 256) -> np.ndarray:
    """Start places of the suffixes of ``t`` (symbols below ``k``) in their order; an empty array for an empty text."""
    if not len(t):
        return np.zeros(0, np.int64)
    s = classify(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(lms) > 1:
        names = name_substrings(t, s, lms, k)
        if names.max() + 1 == len(lms):
            lms = lms[np.argsort(names)]
        else:
            lms = lms[suffix_array(names, int(names.max()) + 1)]
    return induce(t, s, lms, k)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of the bytes ``t``, the common prefix with the suffix before it in ``sa`` (0 for the first).

    Where the bytes before both are equal, the value is one less than at the place before; only the other,
    irreducible places are compared, eight bytes at a time.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    at = np.flatnonzero(before[1:] > 0) + 1
    own[at] = t[at - 1] != t[before[at] - 1]
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = t
    words = np.empty(n + 8, np.uint64)
    for o in range(8):
        part = padded[o : o + (n + 8 - o + 7) // 8 * 8]
        view = part[: len(part) // 8 * 8].view(np.uint64)
        words[o::8][: len(view)] = view[: len(words[o::8])]
    values = np.zeros(n, np.int64)
    i = np.flatnonzero(own & (before >= 0))
    j, size = before[i], np.zeros(len(i), np.int64)
    limit = n - np.maximum(i, j)
    left = np.arange(len(i))
    while len(left):
        x = words[i[left] + size[left]] ^ words[j[left] + size[left]]
        same = x == 0
        low = x & (~x + np.uint64(1))
        more = np.where(same, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        size[left] += more
        left = left[same & (size[left] < limit[left])]
    values[i] = np.minimum(size, limit)
    place = np.arange(n)
    source = np.maximum.accumulate(np.where(own | (before < 0), place, 0))
    return np.maximum(values[source] - (place - source), 0)
