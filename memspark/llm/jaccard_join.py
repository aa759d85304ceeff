"""Similarity join of word-shingle sets with adaptive multi-match prefixes.

Sets are sorted by one global order, rarest shingles first (by a count sketch over all shingles, then by
hash).  Two sets that link share at least o shingles, so their prefixes of n - o + l shingles share at least
l, for any l.  Each document picks its l: a longer prefix costs more postings, but asks for more shared ones
before a pair is verified; the sketch's counts estimate both costs.  Of a pair the longer set's l holds.

Copies never multiply pairs:
1. documents with equal sets form a class and its smallest doc_id alone goes on;
2. in each posting list every document is paired with the list's leader only; pairs that share enough prefix
   shingles are verified on whole texts, and the links' components are found.  A list that the sketch counts
   above ``LIST_PART`` is cut into parts with a leader each, and the leaders form a list again;
3. what is left, pairs of different components, goes through the full multi-match join and is verified; such a
   pair's first match lies within the plain prefixes (l = 1), so only pairs that meet there are counted.
A group of near copies thus costs pairs in proportion to its members, and no link between components is lost.
No task holds a whole list or a leader's whole following: lists are dealt by part, in step 3 one side of a
part meets all parts, and of ``STAR_PART`` partners at most, one after another, each meets the leader's text.

Defined results: texts without words, and null texts, have an empty set, link with nothing and are their own
component; null doc_id gives a null component; rows that share a doc_id count as one vertex; an empty table
gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import held
from .common import materialize, partitions_for, unused
from .components import components
from .wordhash import mix, shingles, word_chunks

#: Counters of the sketch; its size is fixed, at 1 byte each when sent to the tasks.
SKETCH_BITS = 22
_SEGMENT = 1 << 16
#: Longest extension of a prefix, and the cost of verifying a pair in units of a posting.
MOST_MATCHES = 4
VERIFY_COST = 20.0
#: Ids up to this number are sent to the tasks (8 bytes each); more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Postings of a token in one part of its list, by the sketch, and partners of a leader in one part.
LIST_PART = 50_000
STAR_PART = 250


def _least(share: int, n: np.ndarray) -> np.ndarray:
    """ceil(n * share / 100)."""
    return -(-n * share // 100)


def shingle_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Counts of shingles by hash bucket over all texts, as 8 * log2(1 + count)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.clear()
        table = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            for _, counts, hashes in word_chunks(b.column(0)):
                h = shingles(counts, hashes, width)[1]
                np.add.at(table, (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        parts = table.reshape(-1, _SEGMENT)
        at = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in at], pa.binary())], ["segment", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_SEGMENT, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        level = np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8)
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "levels": [zlib.compress(level.tobytes(), 1)]})

    table = np.zeros(((1 << SKETCH_BITS) // _SEGMENT, _SEGMENT), np.uint8)
    rows = docs.select("text").mapInArrow(local, "segment long, counts binary").groupBy("segment").applyInPandas(add, "segment long, levels binary")
    for r in rows.toLocalIterator():
        table[r["segment"]] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    return table.reshape(-1)


def prefixes(docs: DataFrame, width: int, percent: int, levels: Broadcast) -> DataFrame:
    """doc_id, n (set size), digest (of the set), l (matches asked for), prefix (shingles, rarest first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.clear()
        level = levels.value
        frequency = _counts()
        noise = float(frequency[level].mean())
        for b in batches:
            for first, counts, hashes in word_chunks(b.column(1)):
                sizes, h = shingles(counts, hashes, width)
                begins = np.concatenate(([0], np.cumsum(sizes)))
                raw = memoryview(h.tobytes())
                digest = [hashlib.blake2b(raw[8 * i : 8 * j], digest_size=16).digest() if j > i else None for i, j in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                q = level[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((h, q, np.repeat(np.arange(len(sizes)), sizes)))
                h, cost = h[order], np.concatenate(([0.0], np.cumsum(np.maximum(frequency[q[order]] - noise, 0.0))))
                plain = sizes - _least(percent, sizes) + 1
                choices = []
                for m in range(1, MOST_MATCHES + 1):
                    end = begins[:-1] + np.minimum(plain + m - 1, sizes)
                    postings = cost[end] - cost[begins[:-1]] + (plain + m - 1)
                    choices.append(np.where(m <= _least(percent, sizes), postings * (1 + VERIFY_COST / m), np.inf))
                asked = np.where(sizes > 0, np.argmin(choices, 0) + 1, 0)
                length = np.minimum(plain + MOST_MATCHES - 1, sizes)
                raw = memoryview(h.tobytes())
                cut = [raw[8 * i : 8 * (i + k)].tobytes() for i, k in zip(begins[:-1].tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), pa.array(asked, pa.int8()), pa.array(cut, pa.binary())],
                    ["doc_id", "n", "digest", "l", "prefix"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return materialize(rows.mapInArrow(run, "doc_id long, n long, digest binary, l byte, prefix binary"), "prefixes")


def _counts() -> np.ndarray:
    """The count that each level of the sketch stands for."""
    return np.exp2(np.arange(256) / 8) - 1


def _postings(levels: Broadcast, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.clear()
        parts_of = np.ceil(np.maximum(_counts(), 1) / most).astype(np.int32)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                blobs = b.column("prefix").to_pylist()
                size = np.array([len(x) // 8 for x in blobs])
                place = np.arange(size.sum()) - np.repeat(np.concatenate(([0], np.cumsum(size)))[:-1], size)
                token = np.frombuffer(b"".join(blobs), np.uint64)
                n, doc, asked = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), size) for c in ("n", "doc_id", "l"))
                parts = parts_of[levels.value[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]]
                part = (mix(doc.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(part), pa.array(parts), pa.array(place, pa.int32()), pa.array(n.astype(np.int32)), pa.array(doc), pa.array(asked, pa.int8())], _LIST)

    return run


_LIST = ["token", "part", "parts", "pos", "n", "doc", "l"]
_LIST_TYPE = "token long, part int, parts int, pos int, n int, doc long, l byte"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and part, those of lists with two or more rows, each with its part's first row as leader."""
    alone: pa.RecordBatch | None = None  # last row seen, while it is alone in its list
    key = leader = None
    for b in batches:
        if not b.num_rows:
            continue
        if alone is not None:
            b = pa.Table.from_batches([alone, b]).combine_chunks().to_batches()[0]
            alone = None
        token, part, parts = (b.column(c).to_numpy() for c in ("token", "part", "parts"))
        starts = np.concatenate(([0], np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1])) + 1))
        size = np.diff(np.append(starts, len(token)))
        lead = [np.repeat(b.column(c).to_numpy()[starts], size) for c in ("pos", "n", "doc")]
        keep = np.repeat(size > 1, size) | (parts > 1)
        if leader is not None and (token[0], part[0]) == key:
            for x, v in zip(lead, leader, strict=True):
                x[: size[0]] = v
            keep[: size[0]] = True
        if size[-1] == 1 and not keep[-1]:
            alone, leader = b.slice(len(token) - 1, 1), None
        else:
            key, leader = (token[-1], part[-1]), [x[-1] for x in lead]
        at = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in _LIST), *(pa.array(x[keep]) for x in lead)], [*_LIST, "lead_pos", "lead_n", "lead"])


def _with_leaders(rows: DataFrame) -> DataFrame:
    n = partitions_for(rows.sparkSession)
    rows = rows.select(*_LIST).repartition(n, "token", "part").sortWithinPartitions("token", "part", "pos", "n", "doc")
    return rows.mapInArrow(_shared, f"{_LIST_TYPE}, lead_pos int, lead_n int, lead long")


def _overlap(a: str, b: str, percent: int) -> str:
    """Least shared shingles of linked sets with sizes a and b."""
    return f"ceil({percent} * ({a} + {b}) / {100 + percent}.0D - 1e-9)"


def _sent(rows: DataFrame) -> DataFrame:
    """``rows``, a written table of ids, with a broadcast hint where their number is within the bound."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_IDS else rows


def _stars(pairs: DataFrame, side: DataFrame, most: int) -> DataFrame:
    """Rows (a, part, b, columns of ``side`` but doc_id): a leader's own row (b null), then those of its partners.

    Sorted so within partitions; a leader with more than ``most`` partners has several parts, each with its row.
    """
    ids = materialize(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), "ids")
    side = materialize(side.join(_sent(ids), F.col("doc_id") == F.col("_id"), "left_semi"), "side")
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).filter("parts > 1")
    hot = _sent(materialize(hot.withColumnRenamed("a", "_a"), "hot"))
    pairs = pairs.join(hot, F.col("a") == F.col("_a"), "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0)).alias("part"))
    names = [c for c in side.columns if c != "doc_id"]
    partners = pairs.join(side.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", *names)
    leaders = pairs.select("a", "part").distinct().join(side.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), *names)
    n = partitions_for(pairs.sparkSession)
    return leaders.unionByName(partners).repartition(n, "a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))


def enough_matches(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a longer, b shorter) that share as many prefix shingles as a asks for.

    Every pair that is to be found has a first match within the plain prefixes, so this looks at few pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for *now, b, m, asked, blob in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "n", "l", "prefix")), strict=True):
                other = np.frombuffer(blob, np.uint64)
                if b is None:
                    # rows that share a doc_id are leaders together
                    key, leaders = now, [*(leaders if key == now else ()), (m, asked, other)]
                    continue
                for n, least, own in leaders:
                    spare = -(-percent * (n + m) // (100 + percent))
                    if len(np.intersect1d(own[: n - spare + least], other[: m - spare + least], assume_unique=True)) >= least:
                        found.append((now[0], b))
            yield _pairs(found)

    stars = _stars(pairs, rows.select("doc_id", "n", "l", "prefix"), STAR_PART)
    return stars.select("a", "part", "b", "n", "l", "prefix").mapInArrow(run, "a long, b long").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose whole sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.clear()
        key, leaders = None, []
        for batch in batches:
            keys, partner = list(zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), strict=True)), batch.column("b").to_pylist()
            found: list[tuple[int, int]] = []
            for first, counts, hashes in word_chunks(batch.column("text")):
                sizes, h = shingles(counts, hashes, width)
                for i, other in enumerate(np.split(h, np.cumsum(sizes)[:-1]), first):
                    if partner[i] is None:
                        # rows that share a doc_id are leaders together; a copy, so that the run's array can go
                        key, leaders = keys[i], [*(leaders if key == keys[i] else ()), other.copy()]
                        continue
                    for own in leaders:
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        if both and 100 * both >= percent * (len(own) + len(other) - both):
                            found.append((keys[i][0], partner[i]))
            yield _pairs(found)

    stars = _stars(pairs, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), STAR_PART)
    return stars.select("a", "part", "b", "text").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, list_part: int = LIST_PART) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with an equal set), component_id for each row of ``docs``."""
    docs = docs.select("doc_id", "text")
    levels = docs.sparkSession.sparkContext.broadcast(shingle_sketch(docs, width))
    rows = prefixes(docs, width, percent, levels)
    classes = materialize(rows.filter("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id")), "classes")
    mine = classes.select(F.col("digest").alias("_d"), F.col("class_id").alias("_c"))
    first = rows.join(mine, (F.col("doc_id") == F.col("_c")) & (F.col("digest") == F.col("_d"))).select("doc_id", "n", "l", "prefix")
    lists = materialize(_with_leaders(first.mapInArrow(_postings(levels, list_part), _LIST_TYPE)), "lists")

    # 2. each document with the leaders of its posting lists, and leaders of parts with the list's first
    tops = lists.filter("parts > 1 and doc = lead").withColumns({"part": F.lit(0), "parts": F.lit(1)})
    o = _overlap("n", "lead_n", percent)
    stars = lists.unionByName(_with_leaders(tops)).filter("doc <> lead").withColumn("o", F.expr(o)).filter("pos < n - o + l and lead_pos < lead_n - o + l and least(n, lead_n) >= o")
    stars = stars.groupBy(F.col("lead").alias("a"), F.col("doc").alias("b")).agg(F.count("*").alias("m"), F.min("l").alias("l")).filter("m >= l").select("a", "b")
    links = materialize(verify(materialize(stars, "stars"), docs, width, percent), "links")
    joined = components(links)

    # 3. pairs of different components: a first match within the plain prefixes, then the full multi-match count
    sides = lists.select("token", "part", "parts", "pos", "n", "doc").join(joined.withColumnRenamed("v", "doc"), "doc", "left").withColumn("c", F.coalesce("c", "doc"))
    sides = materialize(sides, "sides")
    x = sides.select("token", "part", *(F.col(c).alias(f"x_{c}") for c in ("pos", "n", "doc", "c")))
    # each part of one side meets every part of the other
    y = sides.select(F.col("token").alias("_token"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"), *(F.col(c).alias(f"y_{c}") for c in ("pos", "n", "doc", "c")))
    o = _overlap("x_n", "y_n", percent)
    fits = f"x_c <> y_c and (x_n > y_n or x_n = y_n and x_doc > y_doc) and y_n >= {o} and x_pos < x_n - {o} + 1 and y_pos < y_n - {o} + 1"
    rest = x.join(y, (F.col("token") == F.col("_token")) & (F.col("part") == F.col("_part")) & F.expr(fits)).select(F.col("x_doc").alias("a"), F.col("y_doc").alias("b")).distinct()
    rest = materialize(enough_matches(materialize(rest, "met"), rows, percent), "rest")
    more = materialize(verify(rest, docs, width, percent), "more")
    if not more.isEmpty():
        joined = components(links.unionByName(more))
    classes = classes.join(joined.select(F.col("v").alias("class_id"), "c"), "class_id", "left").withColumn("c", F.coalesce("c", "class_id"))
    out = rows.select("doc_id", "n", "digest").join(classes.withColumnRenamed("digest", "_d"), F.col("digest") == F.col("_d"), "left")
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own("class_id").alias("class_id"), own("c").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id."""
    found = near_duplicates(docs, width, percent)
    key = unused(docs, "_gone")
    gone = materialize(found.filter("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
    return docs.join(_sent(gone), F.col("doc_id") == F.col(key), "left_anti")
