"""Exact deduplication with two passes of a counting Bloom filter.

Pass 1 reads every text once, hashes its normalised form and counts filter positions; the filter keeps,
for each position, whether one or at least two rows hit it.  Pass 2 reads the rows again: a row whose
positions were all hit twice is possibly repeated; only such rows shuffle.  All others are known to be
unique and pass straight through.  The filter has no false negatives, so no copy is lost; a false
positive only costs one needless row in the shuffle.

Filter size follows the row count (``BITS_PER_ROW``), cut into segments of ``SEGMENT_BITS``.  At most
``MAX_BROADCAST_BYTES`` of it are sent to tasks at a time: a larger filter goes in several passes, and each row
is probed in the pass that has its segment, so unique rows pass straight through all the same.  Beyond
``MAX_PASSES`` (268 million rows) reading again would cost more than it spares, and all rows count as possible
repeats: their narrow (id, hash) rows shuffle once, and texts only in ``drop_duplicates``.

Defined results: null text counts as empty; null doc_id sorts after all others; a text of only white space
normalises to one space and differs from the empty text; identical rows that repeat one doc_id are one
group, and one of them stays; an empty table gives an empty result; other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import held
from .common import WS, materialize, unused

BITS_PER_ROW = 16
PROBES = 4
SEGMENT_BITS = 1 << 16
MAX_BROADCAST_BYTES = 64 << 20
MAX_PASSES = 8
#: Rows of a group that one task joins back to its result; larger groups are dealt over several.
GROUP_PART = 10_000
#: Large groups up to this number are sent to the tasks (36 bytes each); more are joined by a shuffle.
MAX_SENT_GROUPS = 500_000


def normalized(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{WS}+", " ")


def _places(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and PROBES bit places of each 64-bit hash."""
    u = h.astype(np.int64).view(np.uint64)
    segment = (u >> np.uint64(16)) % np.uint64(segments)
    a, b = u & np.uint64(0xFFFF), (u * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(45)) | np.uint64(1)
    bits = [(a + np.uint64(k) * b) % np.uint64(SEGMENT_BITS) for k in range(PROBES)]
    return segment.astype(np.int64), np.stack(bits, 1).astype(np.int64)


def _counted(segments: int):
    """Each task counts its own rows in a local filter and emits (segment, once, twice) bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.clear()
        keys, counts = [], []
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            segment, bits = _places(h, segments)
            # a row hits a place once, even if two of its probes meet there
            bits = np.sort(bits, 1)
            fresh = np.ones(bits.shape, bool)
            fresh[:, 1:] = bits[:, 1:] != bits[:, :-1]
            flat = (segment[:, None] * SEGMENT_BITS + bits)[fresh]
            k, c = np.unique(flat, return_counts=True)
            keys.append(k)
            counts.append(np.minimum(c, 2))
            if sum(map(len, keys)) > 4_000_000:
                yield from _emit(keys, counts)
                keys, counts = [], []
        yield from _emit(keys, counts)

    return run


def _emit(keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if not keys:
        return
    flat, n = np.concatenate(keys), np.concatenate(counts)
    k, at = np.unique(flat, return_inverse=True)
    total = np.bincount(at, n)
    segment = k // SEGMENT_BITS
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(segment)) + 1, [len(k)])) if len(k) else [0]
    rows: tuple[list, list, list] = ([], [], [])
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        inside = (k[i:j] % SEGMENT_BITS).astype(np.uint16)
        for out, value in zip(rows, (int(segment[i]), inside.tobytes(), inside[total[i:j] > 1].tobytes()), strict=True):
            out.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["segment", "once", "twice"])


def _merge(pdf):
    """Saturating sum of the local filters of one segment; only the places hit twice are kept."""
    once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for a, b in zip(pdf["once"], pdf["twice"], strict=True):
        at = np.frombuffer(a, np.uint16)
        twice[np.frombuffer(b, np.uint16)] = True
        twice[at] |= once[at]
        once[at] = True
    return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "bitmap": [np.packbits(twice).tobytes()]})


def repeat_filter(hashes: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """(table of (segment, bitmap of places hit at least twice), number of segments) for a column of hashes."""
    segments = max(1, -(-rows * BITS_PER_ROW // SEGMENT_BITS))
    local = hashes.mapInArrow(_counted(segments), "segment long, once binary, twice binary")
    return materialize(local.groupBy("segment").applyInPandas(_merge, "segment long, bitmap binary"), "filter"), segments


def _tester(bitmaps: dict[int, bytes], segments: int, low: int, high: int):
    """Probes hashes whose segment lies in [low, high) of ``segments``."""
    empty = bytes(SEGMENT_BITS // 8)

    def test(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.frombuffer(b"".join(bitmaps.get(i, empty) for i in range(low, high)), np.uint8)
        for h in series:
            segment, bits = _places(h.to_numpy(), segments)
            place = (segment[:, None] - low) * SEGMENT_BITS + bits
            yield pd.Series(((table[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).all(1))

    return test


def probed(rows: DataFrame, h: str, flag: str, bitmaps: DataFrame, segments: int, max_bytes: int) -> Iterator[DataFrame]:
    """Parts of ``rows``, each row in one, with ``flag``: false only where the hash column ``h`` occurs once."""
    step = max(1, max_bytes * 8 // SEGMENT_BITS)
    if -(-segments // step) > MAX_PASSES:
        yield rows.withColumn(flag, F.lit(True))
        return
    segment = F.shiftrightunsigned(h, 16) % segments
    for low in range(0, segments, step):
        high = min(segments, low + step)
        sent = {r[0]: bytes(r[1]) for r in bitmaps.filter(F.col("segment").between(low, high - 1)).toLocalIterator()}
        own = rows if high - low == segments else rows.filter(segment.between(low, high - 1))
        yield own.withColumn(flag, F.pandas_udf(_tester(sent, segments, low, high), "boolean")(h))


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, h, sha): sha-256 of the normalised text as bytes, and its first 8 bytes as a number."""
    hexed = F.sha2(normalized(text).cast("binary"), 256)
    rows = docs.select(F.col("doc_id").cast("long"), hexed.alias("hex"))
    return rows.select("doc_id", F.conv(F.substring("hex", 2, 15), 16, 10).cast("long").alias("h"), F.unhex("hex").alias("sha"))


def flag_repeats(docs: DataFrame, text: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(doc_id, h, sha, maybe) for every row, written; maybe = false only where the text occurs once."""
    rows = hashed(docs, text)
    bitmaps, segments = repeat_filter(rows.select("h"), docs.count())
    if segments * SEGMENT_BITS // 8 > max_broadcast_bytes:
        rows = materialize(rows, "hashes")
    # a pass is written before the next one's filter is sent
    return reduce(DataFrame.unionByName, [materialize(part, "flags") for part in probed(rows, "h", "maybe", bitmaps, segments, max_broadcast_bytes)])


def duplicate_groups(docs: DataFrame, text: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    flagged = flag_repeats(docs, text, max_broadcast_bytes)
    passed = flagged.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    # equal rows count first, so that a hot text moves one row a task; then one result a text
    ids = materialize(flagged.filter("maybe").groupBy("sha", "doc_id").agg(F.count("*").alias("n")), "ids")
    parts = F.ceil(F.count("*") / GROUP_PART).cast("int").alias("parts")
    groups = materialize(ids.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), parts), "groups")
    large = groups.filter("parts > 1").select(F.col("sha").alias("_large"), F.col("parts").alias("_parts"))
    large = F.broadcast(large) if large.count() <= MAX_SENT_GROUPS else large
    dealt = ids.join(large, F.col("sha") == F.col("_large"), "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int"), F.lit(0))).drop("_large", "_parts")
    back = dealt.join(groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), ["sha", "part"])
    # rows that repeat one doc_id, in runs, so that no array is long
    back = back.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / GROUP_PART))))
    back = back.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(GROUP_PART), F.col("n") - F.col("run") * GROUP_PART))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1) & (F.col("run") == 0)
    found = back.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "sha")
    return passed.unionByName(found).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, text: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` without later copies: of equal texts the row with the smallest doc_id stays, whole.

    Unique rows never leave their task.  Possibly repeated rows shuffle once, whole, after each task has kept its
    own first of each text; a filter that is sent in several passes has the texts read once a pass.
    """
    names, sha, maybe, key = [F.col(f"`{c}`") for c in docs.columns], unused(docs, "_sha"), unused(docs, "_maybe"), unused(docs, "_key")
    full = docs.withColumn(sha, F.unhex(F.sha2(normalized(text).cast("binary"), 256)))
    full = full.withColumn(key, F.conv(F.substring(F.hex(sha), 2, 15), 16, 10).cast("long"))
    bitmaps, segments = repeat_filter(hashed(docs, text).select("h"), docs.count())
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    out = []
    for part in probed(full, key, maybe, bitmaps, segments, max_broadcast_bytes):
        firsts = part.filter(F.col(maybe)).groupBy(sha).agg(F.min_by(F.struct(*names), order).alias(maybe)).select(f"{maybe}.*")
        both = part.filter(~F.col(maybe)).select(*names).unionByName(firsts)
        out.append(both if segments * SEGMENT_BITS // 8 <= max_broadcast_bytes else materialize(both, "kept"))
    return reduce(DataFrame.unionByName, out)
