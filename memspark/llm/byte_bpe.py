"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of parts.  Every adjacent pair that has a rank sits in the bucket of that
rank; a bitmap with one bit a rank, and above it one bit a word of that bitmap, finds the lowest rank with
find-first-set in two steps, so a merge costs the same however long the pre-token is.  Entries whose pair
has changed since are stale and skipped.  Ties of a rank go left to right, as the merge rule asks.

The new pre-tokens of a run of texts share one queue (``merge_many``): their lists lie behind one another in
arrays, with a barrier after each.  A bucket's live positions are merged together, the leftmost of each
pre-token; what is left of the bucket goes back, so each pre-token sees its merges in its own order: lowest
rank first, leftmost first.  Pre-tokens over ``LONG`` bytes have a queue of their own (``merge``).

Defined results: null text is empty; an empty text has no ids; bytes outside the vocabulary can't occur,
since all 256 single bytes are in it; rows are independent, so repeated rows give equal results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import held
from .pretoken import Memory, cut, portions

#: Bits of a word of the bitmap: 197 words cover 50,257 ranks.
WORD = 256
#: Bytes above which a pre-token has a queue of its own.
LONG = 512
#: Chunks that a worker remembers in each of two generations.
CHUNKS = 300_000
#: Bits of an id in a pair's key.
_ID = 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    # end[i]: where the part that begins at i ends, 0 once it is merged away; rank_of[i]: rank of that part and the next
    end, before, rank_of = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            rank_of[i] = rank
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                word = rank // WORD
                words[word] = words.get(word, 0) | 1 << rank % WORD
                top |= 1 << word
    while top:
        # find first set: the lowest word with a bit, then its lowest bit
        word = (top & -top).bit_length() - 1
        bits = words[word]
        rank = word * WORD + (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            words[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
        if rank_of[i] != rank:
            continue  # stale: another merge has changed this pair
        j = end[i]
        k = end[i] = end[j]
        end[j] = 0
        rank_of[j] = -1
        new = None
        if k < n:
            before[k] = i
            new = get(piece[i : end[k]])
        if new is None:
            rank_of[i] = -1
        else:
            rank_of[i] = new
            if new in buckets:
                heappush(buckets[new], i)
            else:
                buckets[new] = [i]
                word = new // WORD
                words[word] = words.get(word, 0) | 1 << new % WORD
                top |= 1 << word
        h = before[i]
        if h < 0:
            continue
        new = get(piece[h:k])
        if new is None:
            rank_of[h] = -1
        else:
            rank_of[h] = new
            if new in buckets:
                heappush(buckets[new], h)
            else:
                buckets[new] = [h]
                word = new // WORD
                words[word] = words.get(word, 0) | 1 << new % WORD
                top |= 1 << word
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pairs:
    """Ranks of pairs of ids, as a sorted array of keys."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[b[:i]] << _ID | ranks[b[i:]], r) for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        keys, rank = np.array(found, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        # a last key that no pair has
        self.keys, self.rank = np.append(keys[order], np.iinfo(np.int64).max), np.append(rank[order], -1)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << _ID | right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.rank[at], -1)


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """Ids of many pre-tokens, none of them empty, as little-endian 32-bit integers."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n, sizes = len(data), np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends, owner = np.cumsum(sizes), np.repeat(np.arange(len(pieces)), sizes)
    # place n is the barrier before and after every list; its id makes no pair
    ids = np.append(pairs.byte[data], (1 << _ID) - 1)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1] = before[ends - sizes] = after[n] = n
    rank_of, gone = np.full(n + 1, -1), np.zeros(n, bool)
    buckets: dict[int, list[np.ndarray]] = {}
    words: dict[int, int] = {}
    top = 0

    def push(places: np.ndarray, ranks: np.ndarray) -> None:
        nonlocal top
        some = ranks >= 0
        places, ranks = places[some], ranks[some]
        if len(places) > 1:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            rank = int(ranks[i])
            if rank in buckets:
                buckets[rank].append(places[i:j])
            else:
                buckets[rank] = [places[i:j]]
                word = rank // WORD
                words[word] = words.get(word, 0) | 1 << rank % WORD
                top |= 1 << word

    rank_of[:n] = pairs(ids[:n], ids[after[:n]])
    push(np.arange(n), rank_of[:n])
    while top:
        # find first set: the lowest word with a bit, then its lowest bit
        word = (top & -top).bit_length() - 1
        bits = words[word]
        rank = word * WORD + (bits & -bits).bit_length() - 1
        held = buckets.pop(rank)
        words[word] = bits = bits & (bits - 1)
        if not bits:
            top &= top - 1
        at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
        at = at[rank_of[at] == rank]  # the others are stale: another merge has changed their pairs
        if not len(at):
            continue
        if len(at) > 1:
            own = owner[at]
            first = np.append(True, own[1:] != own[:-1])
            if not first.all():
                rest = at[~first]
                push(rest, rank_of[rest])
                at = at[first]
        j = after[at]
        k, h = after[j], before[at]
        ids[at], after[at], before[k] = rank, k, at
        gone[j], rank_of[j] = True, -1
        both = np.concatenate((h, at))
        new = pairs(np.concatenate((ids[h], ids[at])), np.concatenate((ids[at], ids[k])))
        rank_of[both] = new
        push(both, new)
    left = ~gone
    flat = ids[:n][left].astype("<i4").tobytes()
    cuts = np.concatenate(([0], 4 * np.cumsum(np.bincount(owner[left], minlength=len(pieces))))).tolist()
    return [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


class Encoder:
    """Ids of texts; space-cut chunks met before are remembered."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.pairs = Pairs(self.ranks)
        self.split = regex.compile(pattern).findall
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for b, r in self.ranks.items():
            self.bytes[r] = b
        self.digits = [str(i) for i in range(len(self.bytes))]
        #: Ids of " " + chunk.
        self.known = Memory(CHUNKS)

    def chunks(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that begin at a boundary; equal pre-tokens are merged once."""
        found = list(map(self.split, texts))
        ids: dict[str, bytes] = {}
        new: dict[str, bytes] = {}
        for piece in set(chain.from_iterable(found)):
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                ids[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                ids[piece] = np.array(merge(raw, self.ranks), "<i4").tobytes()
            else:
                new[piece] = raw
        if new:
            ids.update(zip(new, merge_many(list(new.values()), self.pairs), strict=True))
        return [b"".join(map(ids.__getitem__, f)) for f in found]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [cut(t) for t in texts]
        # the first piece of a text has no space before it
        heads = self.chunks([p.pop(0) for p in pieces])
        tails = self.known.join(pieces, lambda new: dict(zip(new, self.chunks([" " + c for c in new]), strict=True)))
        return [np.frombuffer(h + t, "<i4") for h, t in zip(heads, tails, strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a Python worker: what it remembers lasts from task to task."""
    return held.only(("byte_bpe", path, pattern), lambda: Encoder(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for keys, texts in portions(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(e.encode(texts), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(e.decode, part.column(1).to_pylist()), pa.binary())], ["doc_id", "bytes"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode the ids, and digest both in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        digits = e.digits.__getitem__
        for keys, texts in portions(batches):
            count, left, right = [], [], []
            for found in e.encode(texts):
                ids = found.tolist()
                count.append(len(ids))
                left.append(hashlib.sha256(" ".join(map(digits, ids)).encode()).hexdigest())
                right.append(hashlib.sha256(e.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(count, pa.int64()), pa.array(left), pa.array(right)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
