"""Removal of every byte that lies in a string of ``length`` bytes which starts anywhere else, too.

A window is a string of ``length`` bytes.  Its anchor is the least hash among its grams (of ``gram_size`` bytes),
the leftmost one of equal hashes.  Equal windows have equal anchors at equal places, so windows that share an
anchor's place form one context, the text of some consecutive windows, and equal windows lie in contexts of equal
anchors.  Anchors that occur once hold no repeated window.

1. Anchors are counted; a Bloom filter of the repeated ones, of bounded size, or a join where it would be larger,
   says which contexts go on.  Equal contexts are one, with their number.
2. Contexts of an anchor come together in shards of about ``SHARD_BYTES``, whole texts of them, apart from each
   other.  Each shard is sorted by induced sorting (``suffix_array``); permuted common prefixes of ``length`` or
   more join neighbours to groups of equal windows, and a window is repeated if its group occurs twice.
   A context that alone has its anchor is repeated as a whole.
3. An anchor with more than ``HOT`` different contexts is dealt over many shards: its contexts are cut into blocks
   of windows at equal distance from the anchor, and a block's key is the hash of what all its windows share.
   At last a block is one window, and equal keys are equal windows.
4. What is repeated goes back to the places of the contexts, and by document to the texts.  Documents without any
   never move.

Only bytes decide: hashes of anchors lead together what is then compared, and contexts are told apart by 128 bits.

Defined results: null text is empty; every row is a text of its own, so rows that repeat a doc_id or a text repeat
each other's strings; texts shorter than ``length`` lose nothing; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import held
from .common import materialize
from .suffix_array import permuted_prefixes, suffix_array

LENGTH = 200
#: Bytes of the texts that one suffix array sorts.
SHARD_BYTES = 2_000_000
#: Contexts of an anchor that go to one shard, and windows of a block where there are more.
HOT = 2_000
BLOCKS = (16, 1)
#: Windows of a text that are looked at together.
SECTION = 1 << 20
#: Keys that a sent filter may hold, and its bits at most.
MAX_SENT_KEYS = 1 << 26
MAX_SENT_BITS = 1 << 28
_END = b"\xff"  # in no UTF-8 text
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_size(length: int) -> int:
    return 1 << max(0, (length // 3).bit_length() - 1)


def gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all grams of a power of two of bytes, by doubling."""
    h, step = _TABLE[b], 1
    while step < size:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        step *= 2
    return h


def runs(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of every window, whether a window's anchor lies elsewhere than that of the window before)."""
    h = gram_hashes(b, gram_size(length))
    m, step, width = h, 1, length - gram_size(length) + 1
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if step < width:
        m = np.minimum(m[: len(m) - (width - step)], m[width - step :])
    fresh = np.ones(len(m), bool)
    # a least gram at a window's own start is left behind by the next window, even if its equal follows
    fresh[1:] = (m[1:] != m[:-1]) | (h[: len(m) - 1] == m[:-1])
    return m, fresh


def sections(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[tuple[int, int, int, int]]]]:
    """(batch, bytes, parts) with parts (row, place in bytes, size, place in its text): texts, or overlapping sections of them, in runs."""
    for batch in batches:
        buffer, parts, size = [], [], 0
        texts = batch.column(batch.num_columns - 1)
        for row in range(batch.num_rows):
            raw = texts[row].as_py() or b""
            for at in range(0, len(raw) - length + 1, SECTION):
                part = raw[at : at + SECTION + length - 1]
                parts.append((row, size, len(part), at))
                buffer.append(part)
                size += len(part)
                if size >= SECTION:
                    yield batch, np.frombuffer(b"".join(buffer), np.uint8), parts
                    buffer, parts, size = [], [], 0
        if parts:
            yield batch, np.frombuffer(b"".join(buffer), np.uint8), parts


def _spots(b: np.ndarray, parts: list[tuple], length: int) -> tuple[np.ndarray, ...]:
    """(anchor, place in b, windows, number of the part) of every context of the parts."""
    anchor, fresh = runs(b, length)
    begin, size = np.array([p[1] for p in parts]), np.array([p[2] for p in parts])
    count = np.zeros(len(anchor) + 1, np.int64)
    inside = np.zeros(len(anchor) + 1, bool)
    # windows that cross from one part to the next are none
    count[begin] += 1
    np.subtract.at(count, np.minimum(begin + size - length + 1, len(anchor)), 1)
    inside[:] = np.cumsum(count) > 0
    fresh[begin] = True
    cut = fresh | ~inside[:-1]
    start = np.flatnonzero(cut)
    n = np.diff(np.append(start, len(anchor)))
    keep = inside[start]
    start, n = start[keep], n[keep]
    return anchor[start].view(np.int64), start, n, np.searchsorted(begin, start, side="right") - 1


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.clear()
        for _, b, parts in sections(batches, length):
            yield pa.RecordBatch.from_arrays([pa.array(_spots(b, parts, length)[0])], ["anchor"])

    return run


def _contexts(length: int, test):
    from xxhash import xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.clear()
        for batch, b, parts in sections(batches, length):
            anchor, start, n, part = _spots(b, parts, length)
            keep = test(anchor)
            anchor, start, n, part = anchor[keep], start[keep], n[keep], part[keep]
            raw = memoryview(b)
            ctx = np.array([xxh3_64_intdigest(raw[i:j]) for i, j in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)], np.uint64)
            row, begin, at = (np.array([p[k] for p in parts])[part] for k in (0, 1, 3))
            doc = [batch.column(k).take(pa.array(row)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ctx.view(np.int64)), *doc, pa.array(start - begin + at), pa.array(n.astype(np.int32))], ["anchor", "ctx", "doc", "h", "start", "n"])

    return run


def sent_filter(keys: DataFrame, n: int):
    """A test of 64-bit hash keys for membership, or None where there are too many to send.

    True for every key of the one-column table ``keys``, and for a few others.
    """
    if n > MAX_SENT_KEYS:
        return None
    bits = 1 << max(16, min(MAX_SENT_BITS.bit_length() - 1, (16 * n).bit_length()))
    mask = bits - 1
    key = F.col(f"`{keys.columns[0]}`")
    places = keys.select(F.explode(F.array(key.bitwiseAND(mask), F.shiftrightunsigned(key, 29).bitwiseAND(mask))).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)

    def test(keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        u = keys.view(np.uint64)
        for at in (u & np.uint64(mask), u >> np.uint64(29) & np.uint64(mask)):
            out &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    return test


def _member(test):
    import pandas as pd

    return F.pandas_udf(lambda h: pd.Series(test(h.to_numpy())), "boolean")


def repeated_windows(texts: list[bytes], numbers: np.ndarray, length: int) -> list[list[int]]:
    """For each text the ranges [from, to) of windows that occur twice in all; text i counts ``numbers[i]`` times."""
    t = np.frombuffer(_END.join(texts) + _END, np.uint8)
    size = np.array([len(x) for x in texts])
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    sa = suffix_array(t)
    joined = permuted_prefixes(t, sa)[sa] >= length
    windows = np.zeros(len(t) + 1, np.int64)
    has = size >= length
    windows[begin[has]] += 1
    np.subtract.at(windows, (begin + size - length + 1)[has], 1)
    whole = np.cumsum(windows)[:-1] > 0
    times = np.where(whole, np.repeat(np.asarray(numbers, np.int64), size + 1), 0)
    group = np.cumsum(~joined)
    total = np.bincount(group, times[sa])
    twice = np.zeros(len(t) + 2, bool)
    twice[1:-1][sa] = whole[sa] & (total[group] >= 2)
    edges = np.flatnonzero(twice[1:] != twice[:-1])
    owner = np.searchsorted(begin, edges[::2], side="right") - 1
    out: list[list[int]] = [[] for _ in texts]
    for o, i, j in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out[o] += [i - int(begin[o]), j - int(begin[o])]
    return out


def _sort_shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        found = repeated_windows(table["text"].to_pylist(), table["times"].to_numpy(), length)
        return pa.table({"anchor": table["anchor"], "ctx": table["ctx"], "ranges": pa.array(found, pa.list_(pa.int32()))}).filter(pa.array([bool(x) for x in found], pa.bool_()))

    return run


def _blocks(length: int, width: int):
    """Contexts of hot anchors as blocks of windows at equal distance from their anchor."""
    from xxhash import xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = gram_size(length)
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            for anchor, ctx, root, lead, n, times, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if lead is None:
                    # the anchor's place, as seen from the first window; all windows of the context hold it
                    h = gram_hashes(np.frombuffer(raw, np.uint8), gram)
                    lead = int(np.flatnonzero(h[n - 1 :] == np.int64(anchor).view(np.uint64))[0]) + n - 1
                for k in range((lead - n + 1) // width, lead // width + 1):
                    # windows at distances [k * width, (k + 1) * width) before the anchor
                    i, j = max(0, lead - (k + 1) * width + 1), min(n, lead - k * width + 1)
                    core = raw[max(0, lead - k * width) : lead - (k + 1) * width + 1 + length]
                    sub = raw[i : j + length - 1]
                    key = xxh3_64_intdigest(core, k) - (1 << 63)
                    for column, value in zip(out, (key, xxh3_64_intdigest(sub, i - lead + length) - (1 << 63), j - i, lead - i, times, sub, (anchor, ctx), i), strict=True):
                        column.append(value)
            up = [[x[m] for x in out[6]] for m in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.binary()), pa.array(up[0], pa.int64()), pa.array(up[1], pa.int64()), pa.array(out[7], pa.int32())],
                ["anchor", "ctx", "n", "lead", "times", "text", "up_anchor", "up_ctx", "at"],
            )

    return run


def _decide(contexts: DataFrame, fetch, length: int, shard_bytes: int, hot: int, blocks: tuple[int, ...]) -> DataFrame:
    """(anchor, ctx, ranges) for distinct contexts (anchor, ctx, n, times, ...); ``fetch`` adds the column text."""
    stats = contexts.groupBy("anchor").agg(F.sum("times").alias("total"), F.count("*").alias("m")).filter("total > 1")
    live = materialize(contexts.join(stats, "anchor").drop("total"), "live")
    whole = live.filter("m = 1").select("anchor", "ctx", F.array(F.lit(0), F.col("n")).cast("array<int>").alias("ranges"))
    size, widest = live.filter("m > 1").agg(F.sum(F.col("n") + length - 1), F.max("m")).first()
    if not size:
        return whole
    several = fetch(live.filter("m > 1"))
    if widest > hot:
        several = materialize(several, "several")
    shards = max(1, -(-size // shard_bytes))
    dealt = several.filter(F.col("m") <= hot).select("anchor", "ctx", "times", "text", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    found = dealt.groupBy("shard").applyInArrow(_sort_shard(length), "anchor long, ctx long, ranges array<int>").unionByName(whole)
    if widest <= hot:
        return found
    root = several.withColumn("lead", F.col("lead") if "lead" in several.columns else F.lit(None).cast("int")).withColumn("root", F.lit(0))
    parts = root.filter(F.col("m") > hot).select("anchor", "ctx", "root", "lead", "n", "times", "text")
    schema = "anchor long, ctx long, n int, lead int, times long, text binary, up_anchor long, up_ctx long, at int"
    parts = materialize(parts.mapInArrow(_blocks(length, blocks[0]), schema), "blocks")
    merged = parts.groupBy("anchor", "ctx").agg(F.first("n").alias("n"), F.first("lead").alias("lead"), F.sum("times").alias("times"), F.first("text").alias("text"))
    below = _decide(materialize(merged, "merged"), lambda rows: rows, length, shard_bytes, hot, blocks[1:])
    back = below.join(parts.select("anchor", "ctx", "up_anchor", "up_ctx", "at"), ["anchor", "ctx"])
    return found.unionByName(back.select(F.col("up_anchor").alias("anchor"), F.col("up_ctx").alias("ctx"), F.transform("ranges", lambda x: x + F.col("at")).alias("ranges")))


def _cut_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, wanted in zip(*(b.column(c) for c in ("text", "wanted")), strict=True):
                text, w = raw.as_py() or b"", wanted.as_py()
                cells = [[x[k] for x in w] for k in ("anchor", "ctx", "n", "m", "times")]
                cells.append([text[x["start"] : x["start"] + x["n"] + length - 1] for x in w])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["anchor", "ctx", "n", "m", "times", "text"])

    return run


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                out: tuple[list, list] = ([], [])
                for raw, hits in zip(*(part.column(c) for c in ("text", "hits")), strict=True):
                    text = raw.as_py() or b""
                    pairs = sorted((h["start"] + i, h["start"] + j + length - 1) for h in hits.as_py() or () for i, j in zip(h["ranges"][::2], h["ranges"][1::2], strict=True))
                    spans: list[list[int]] = []
                    for i, j in pairs:
                        if spans and i <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], j)
                        else:
                            spans.append([i, j])
                    edges = [0, *(x for s in spans for x in s), len(text)]
                    out[0].append([{"from": i, "to": j} for i, j in spans])
                    out[1].append(b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)))
                kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x.as_py() or b"") for x in part.column("text")], pa.int64()), pa.array(out[0], kind), pa.array(out[1], pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot: int = HOT, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (array of from, to: bytes removed), kept (the other bytes)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # equal texts have equal results, so a null id needs no other name
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))
    long = rows.filter(F.octet_length("text") >= length).select("doc", "h", "text")
    counts = long.select("text").mapInArrow(_anchors(length), "anchor long").groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor")
    counts = materialize(counts, "anchors")
    test = sent_filter(counts, counts.count())
    spots = long.mapInArrow(_contexts(length, test or (lambda a: np.ones(len(a), bool))), "anchor long, ctx long, doc long, h long, start long, n int")
    spots = materialize(spots if test else spots.join(counts, "anchor", "left_semi"), "spots")
    contexts = spots.groupBy("anchor", "ctx").agg(F.count("*").alias("times"), F.max("n").alias("n"), F.min(F.struct("doc", "h", "start")).alias("at"))

    def among(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(rows whose h may be among the keys, the rest), so that the rest need not move."""
        keys = keys.select("h").distinct()
        known = sent_filter(keys, keys.count())
        if known is None:
            return rows, None
        marked = rows.withColumn("maybe", _member(known)("h"))
        return marked.filter("maybe").drop("maybe"), marked.filter("not maybe").drop("maybe")

    def fetch(wanted: DataFrame) -> DataFrame:
        per_text = wanted.groupBy("at.doc", "at.h").agg(F.collect_list(F.struct("anchor", "ctx", "n", "m", "times", "at.start")).alias("wanted"))
        per_text = materialize(per_text, "wanted")
        return among(long, per_text)[0].join(per_text, ["doc", "h"]).select("text", "wanted").mapInArrow(_cut_contexts(length), "anchor long, ctx long, n int, m long, times long, text binary")

    found = materialize(_decide(contexts, fetch, length, shard_bytes, hot, blocks), "found")
    hits = spots.select("anchor", "ctx", "doc", "h", "start").join(found, ["anchor", "ctx"]).groupBy("doc", "h").agg(F.collect_list(F.struct("start", "ranges")).alias("hits"))
    hits = materialize(hits, "hits")
    moved, rest = among(rows, hits)
    schema = "doc_id long, n_bytes long, spans array<struct<from:long,to:long>>, kept binary"
    out = moved.join(hits, ["doc", "h"], "left").select("doc_id", "text", "hits").mapInArrow(_removed(length), schema)
    if rest is None:
        return out
    return out.unionByName(rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("spans"), F.col("text").alias("kept")))


def digests(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return remove_repeats(docs, length, **options).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
