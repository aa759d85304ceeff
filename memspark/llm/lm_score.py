"""Deleted interpolation: a word bigram model whose weights depend on how often the context was seen.

p(w | v) = l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1), with weights (l2, l1, l0) of the bucket of c(v),
learned by expectation-maximisation on counts from which the predicted token itself is deleted (so every
training token is held out once).  Each text is read as following an end mark, so c(v) counts contexts too.

Work is cut into blocks of documents.  A block keeps its words as codes of its own vocabulary.  Its distinct
words and bigrams, as sorted hashes by hash range with the block's training counts, go to the ranges; a range
adds up all blocks' counts and sends every block its totals back, in the same order, without hashes.  So a
word pair crosses the network once a block, however often it occurs, and a frequent one is a number.

Order 2 it stays: trigrams hardly repeat within a block, so their keys would cross the network once a token, and the
scratch tables would grow from 3 to some 5 times the input.

Defined results: null text is empty and has just the end token; rows with null doc_id belong to the training
part; repeated rows count each time; without training rows all counts are zero and both scores come from the
uniform part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions_for, split_remainder
from .wordhash import mix, word_chunks

END = np.uint64(0x0123456789ABCDEF)
BUCKETS = 20
#: Steps of the histogram for EM, a quarter of a bit; the last bin is for zero.
_BINS = 160
#: Tokens of a block, at least, where its task has so many; a task holds some 100 bytes for each.
BLOCK_TOKENS = 1_000_000
#: Keys of words or bigrams, over all blocks, in one hash range.
RANGE_KEYS = 2_000_000
_NULL_ID = np.iinfo(np.int64).min


def _squeeze(a: np.ndarray) -> bytes:
    """Unsigned numbers as zstd-compressed byte planes."""
    kind = np.dtype("u1") if not len(a) or a.max() < 256 else np.dtype("u2") if a.max() < 65536 else np.dtype("u4") if a.max() < 1 << 32 else np.dtype("u8")
    planes = a.astype(kind).view(np.uint8).reshape(len(a), kind.itemsize).T
    return bytes([kind.itemsize]) + len(a).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _spread(b: bytes) -> np.ndarray:
    size, n = b[0], int.from_bytes(b[1:9], "little")
    if not n:
        return np.zeros(0, np.uint8)
    planes = np.frombuffer(pa.decompress(b[9:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(f"u{size}").reshape(-1)


def _squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: gaps in as many bytes as the widest needs."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    first, gaps[0] = int(gaps[0]), 0
    size = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([size]) + first.to_bytes(8, "little") + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _spread_keys(b: bytes) -> np.ndarray:
    size = b[0]
    part = np.frombuffer(b, np.uint8, offset=9).reshape(-1, size)
    full = np.zeros((len(part), 8), np.uint8)
    full[:, :size] = part
    return np.cumsum(full.view("<u8").reshape(-1)) + np.uint64(int.from_bytes(b[1:9], "little"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, train) to blocks: ids, tokens a document, training flags, vocabulary and codes."""
    base, seq = TaskContext.get().partitionId() << 24, 0
    held: list[tuple] = []

    def block():
        ids, train, sizes, tokens = (np.concatenate([h[i] for h in held]) for i in range(4))
        vocabulary, codes = np.unique(tokens, return_inverse=True)
        cells = base + seq, len(tokens), ids.astype("<i8").tobytes(), _squeeze(sizes), _squeeze(train.astype(np.uint8)), _squeeze_keys(vocabulary), _squeeze(codes)
        return pa.RecordBatch.from_arrays([pa.array([c], pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(cells)], ["block", "tokens", "ids", "sizes", "train", "vocabulary", "codes"])

    for b in batches:
        ids = b.column(0).fill_null(_NULL_ID).to_numpy()
        train = b.column(2).to_numpy(zero_copy_only=False)
        for first, counts, hashes in word_chunks(b.column(1)):
            n = len(counts)
            ends = np.cumsum(counts + 1) - 1
            tokens = np.empty(len(hashes) + n, np.uint64)
            word = np.ones(len(tokens), bool)
            word[ends] = False
            tokens[ends], tokens[word] = END, hashes
            held.append((ids[first : first + n], train[first : first + n], counts + 1, tokens))
            if sum(len(h[3]) for h in held) >= BLOCK_TOKENS:
                yield block()
                held, seq = [], seq + 1
    if held:
        yield block()


class _Block:
    """A block's tokens and bigrams."""

    def __init__(self, sizes: bytes, train: bytes, vocabulary: bytes, codes: bytes):
        self.sizes = _spread(sizes).astype(np.int64)
        self.train = _spread(train).astype(bool)
        self.vocabulary = _spread_keys(vocabulary)
        self.codes = _spread(codes).astype(np.int64)
        self.ends = np.cumsum(self.sizes) - 1
        self.starts = self.ends - self.sizes + 1
        self.learns = np.repeat(self.train, self.sizes)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct bigram hashes and each token's place among them."""
        h = self.vocabulary[self.codes]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[self.starts] = END
        return np.unique(mix(before * np.uint64(0x9FB21C651E98DF25) + mix(h)), return_inverse=True)


def _counted(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                k = _Block(row["sizes"], row["train"], row["vocabulary"], row["codes"])
                keys, at = k.bigrams()
                for kind, keys, at in ((0, k.vocabulary, k.codes), (1, keys, at)):  # noqa: B020, PLW2901
                    n = np.bincount(at[k.learns], minlength=len(keys)).astype(np.uint32)
                    part = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                    cuts = np.searchsorted(part, np.arange(ranges + 1))
                    full = np.flatnonzero(np.diff(cuts))
                    pieces = [(cuts[r], cuts[r + 1]) for r in full]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(full * 2 + kind), pa.array([row["block"]] * len(full), pa.int64()), pa.array([_squeeze_keys(keys[i:j]) for i, j in pieces], pa.binary()), pa.array([_squeeze(n[i:j]) for i, j in pieces], pa.binary())],
                        ["part", "block", "keys", "counts"],
                    )

    return run


def _totals(pdf: pd.DataFrame) -> pd.DataFrame:
    """All blocks' counts of one hash range, added; block -1 gets the range's (tokens, distinct tokens)."""
    keys = [_spread_keys(k) for k in pdf["keys"]]
    counts = np.concatenate([_spread(c) for c in pdf["counts"]])
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, counts).astype(np.uint64)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    part = int(pdf["part"].iloc[0])
    out = {"block": pdf["block"].tolist(), "part": [part] * len(pdf), "totals": [_squeeze(t) for t in np.split(total[at], cuts)]}
    if part % 2 == 0:
        out["block"].append(-1)
        out["part"].append(part)
        out["totals"].append(_squeeze(np.array([total.sum(), (total > 0).sum()], np.uint64)))
    return pd.DataFrame(out)


def _log_bins(p: np.ndarray) -> np.ndarray:
    """Quarter bits below 1; the last bin for zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.round(-4 * np.log2(np.maximum(p, 1e-300))), _BINS - 2), _BINS - 1).astype(np.int64)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context + 1.0)), BUCKETS - 1).astype(np.int64)


def _counts_of(codes: np.ndarray, starts: np.ndarray, words: np.ndarray, ends: float) -> tuple[np.ndarray, np.ndarray]:
    """c(w) and c(v) of each token."""
    own = words[codes].astype(np.float64)
    context = np.empty_like(own)
    context[1:] = own[:-1]
    context[starts] = ends
    return own, context


def _meet(tokens: float):
    """Joins a block with its totals: per-token bigram counts, word counts, and the histogram for EM."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["ids", "sizes", "train", "codes", "words", "pairs", "bins", "n"]
        if not len(left):
            return pd.DataFrame({c: [] for c in names})
        row = left.iloc[0]
        k = _Block(row["sizes"], row["train"], row["vocabulary"], row["codes"])
        right = right.sort_values("part")
        words, pairs = (np.concatenate([np.zeros(0, np.uint64), *(_spread(t) for t in right["totals"][right["part"] % 2 == kind])]) for kind in (0, 1))
        pairs = pairs[k.bigrams()[1]]
        # deleted estimates of the training tokens
        end = words[np.searchsorted(k.vocabulary, END)]
        own, context = _counts_of(k.codes, k.starts, words, float(end))
        own, context, both = own[k.learns] - 1, context[k.learns] - 1, pairs[k.learns].astype(np.float64) - 1
        bins = _bucket(context) * (_BINS * _BINS) + _log_bins(both / np.maximum(context, 1)) * _BINS + _log_bins(own / max(tokens - 1, 1))
        bins, n = np.unique(bins, return_counts=True)
        return pd.DataFrame({"ids": [row["ids"]], "sizes": [row["sizes"]], "train": [row["train"]], "codes": [row["codes"]], "words": [_squeeze(words)], "pairs": [_squeeze(pairs)], "bins": [bins.tolist()], "n": [n.tolist()]})

    return run


def weights(histogram: dict[int, int], distinct: float, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation: (BUCKETS, 3) weights of bigram, word and uniform parts."""
    out = np.full((BUCKETS, 3), 1 / 3)
    by: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for b, n in histogram.items():
        by[b // (_BINS * _BINS)].append((b % (_BINS * _BINS), n))
    last = None
    for bucket in range(BUCKETS):
        if not by[bucket]:
            if last is not None:
                out[bucket] = last
            continue
        at, n = np.array([x for x, _ in by[bucket]]), np.array([x for _, x in by[bucket]], float)
        p = np.stack([np.where(q < _BINS - 1, np.exp2(-q / 4.0), 0.0) for q in (at // _BINS, at % _BINS)] + [np.full(len(at), 1 / (distinct + 1))], 1)
        w = out[bucket]
        for _ in range(rounds):
            share = w * p
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            # one thousandth of a token for each part keeps all weights above zero
            w = (n[:, None] * share).sum(0) + 1e-3
            w /= w.sum()
        out[bucket] = last = w
    return out


def _score(weight: np.ndarray, tokens: float, distinct: float, ends: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                sizes, codes = _spread(row["sizes"]).astype(np.int64), _spread(row["codes"]).astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                own, context = _counts_of(codes, starts, _spread(row["words"]), ends)
                both = _spread(row["pairs"]).astype(np.float64)
                w = weight[_bucket(context)]
                # an unseen context has no bigram part; its weight goes to the others
                w[:, 0] = np.where(context > 0, w[:, 0], 0)
                p = (w[:, 0] * both / np.maximum(context, 1) + w[:, 1] * own / max(tokens, 1) + w[:, 2] / (distinct + 1)) / w.sum(1)
                base = np.log10((own + 0.5) / (tokens + 0.5 * (distinct + 1)))
                ids = np.frombuffer(row["ids"], "<i8")
                cols = [pa.array(ids, mask=ids == _NULL_ID), pa.array(~_spread(row["train"]).astype(bool)), pa.array(sizes), pa.array(np.add.reduceat((own > 0).astype(np.int64), starts)), pa.array(np.full(len(ids), int(tokens))), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(np.log10(p), starts))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, held_out: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``.

    Learns from the rows whose crc32 remainder modulo 5 is not 1, or for which SQL ``held_out`` is false.
    """
    spark = docs.sparkSession
    train = ~F.coalesce(F.expr(held_out), F.lit(False)) if held_out else split_remainder("doc_id", 5) != 1
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), train.alias("train"))
    blocks = materialize(rows.mapInArrow(_blocks, "block long, tokens long, ids binary, sizes binary, train binary, vocabulary binary, codes binary"), "blocks")
    # a block has at most a bigram a token
    keys = blocks.agg(F.sum("tokens")).first()[0] or 0
    ranges = max(partitions_for(spark), -(-keys // RANGE_KEYS))
    local = blocks.select("block", "sizes", "train", "vocabulary", "codes").mapInArrow(_counted(ranges), "part long, block long, keys binary, counts binary")
    totals = materialize(local.groupBy("part").applyInPandas(_totals, "block long, part long, totals binary"), "totals")
    sums = [_spread(r["totals"]).astype(np.int64) for r in totals.filter("block = -1").select("totals").toLocalIterator()]
    tokens, distinct = (int(sum(s[i] for s in sums)) for i in (0, 1))
    ends = rows.filter("train").count()
    met = blocks.drop("tokens").groupBy("block").cogroup(totals.filter("block >= 0").groupBy("block")).applyInPandas(_meet(float(tokens)), "ids binary, sizes binary, train binary, codes binary, words binary, pairs binary, bins array<long>, n array<long>")
    met = materialize(met, "met")
    bins = met.select(F.explode(F.arrays_zip("bins", "n")).alias("x")).groupBy("x.bins").agg(F.sum("x.n").alias("n"))
    # at most BUCKETS * 160 * 160 bins, whatever the input
    weight = weights({r["bins"]: r["n"] for r in bins.toLocalIterator()}, distinct)
    return met.drop("bins", "n").mapInArrow(_score(weight, float(tokens), float(distinct), float(ends)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
