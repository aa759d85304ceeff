"""A z-fast trie over conversations: which turns begin which conversations, and what sharing them saves.

Conversations stay rows (conversation, depth, hash of the first so many turns); none is gathered in one place.
The hash of a prefix is the exclusive-or of its turns' position-dependent hashes, 128 bits in all, so it runs
along a conversation of any length in stretches of ``STRETCH`` turns.

The trie is a table of compacted nodes.  A node's extent reaches from its parent's depth a to its own depth e;
its handle is the prefix whose depth is the two-fattest number of (a, e], the one divisible by the largest power
of two.  Conversations with equal turns are one sequence.  Sequences go in batch by batch:

* fat binary search: from (0, length], the two-fattest depth is looked up among the handles; a hit moves the lower
  end to that node's extent, a miss the upper end below the depth; the last hit is the exit node or its parent.
  Every step is one join for all sequences of the batch;
* the exit depth on the exit node's edge (or that of a child, found by its first turn) is the longest common
  prefix with the edge's sequence, by binary search over prefix hashes;
* edges split at exit depths, new ends and new branchings become nodes, handles are set anew.

At the end counts are taken per compacted node, and edges are expanded to one row per depth.

Defined results: rows without conv_id belong to no conversation and are left out; a null turn comes first; turns
of one number are ordered by role, then text; null role or text is empty; repeated rows are turns of their own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions_for

#: Turns of a conversation that one window takes.
STRETCH = 1024
#: Batches as shares of the sequences: the first of EIGHTHS eighths, then up to the second, ...
EIGHTHS = (1, 8)
#: Ids that are joined in one string before it is hashed.
RUN = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, order: str, values: dict[str, tuple], before: bool = False) -> DataFrame:
    """``rows`` with running values along ``order`` (1, 2, ...) within ``key``: {name: (column, aggregate, combine, start)}.

    Stretches of ``STRETCH`` places are windows of their own, and so are the stretches' totals.  ``before``
    leaves a row's own value out.
    """
    rows = rows.withColumn("_stretch", F.floor((F.col(order) - 1) / STRETCH))
    totals = rows.groupBy(key, "_stretch").agg(*(agg(c).alias(n) for n, (c, agg, _, _) in values.items()))
    ahead = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("_key"), F.col("_stretch").alias("_of"), *(agg(F.col(n)).over(ahead).alias(f"_{n}") for n, (_, agg, _, _) in values.items()))
    own = Window.partitionBy(key, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    here = rows.select(*rows.columns, *(agg(c).over(own).alias(f"_own_{n}") for n, (c, agg, _, _) in values.items()))
    out = here.join(totals, (F.col(key) == F.col("_key")) & (F.col("_stretch") == F.col("_of")))
    found = [combine(F.coalesce(f"_{n}", start), F.coalesce(f"_own_{n}", start)).alias(n) for n, (_, _, combine, start) in values.items()]
    return out.select(*(c for c in rows.columns if c != "_stretch" and c not in values), *found)


def turns(conversations: DataFrame) -> DataFrame:
    """(c, pos, t1, t2, bytes): the place of each turn in its conversation, two hashes of role and text, the text's bytes."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).filter("c is not null")
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62)).cast("long")))
    place = F.row_number().over(Window.partitionBy("c", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    hashes = [F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)]
    rows = materialize(rows.select("c", "chunk", place.alias("nth"), *hashes, F.octet_length("text").cast("long").alias("bytes")), "turns")
    sizes = rows.groupBy("c", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("c", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return rows.join(offsets, ["c", "chunk"]).select("c", (F.col("nth") + F.col("before")).alias("pos"), "t1", "t2", "bytes")


def rebuild(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((c, length), rows (c, d, t1, t2, bytes)): the first turns of a conversation are those of its group's first.

    Of conversation c the first h = crc32(c) % 9 turns are replaced by the first h of c - c % 5.
    """
    sizes = materialize(rows.groupBy("c").agg(F.count("*").alias("n")), "sizes")
    most = F.crc32(F.col("c").cast("string").cast("binary")) % 9
    heads = sizes.select("c", "n", most.alias("h"), (F.col("c") - F.col("c") % 5).alias("b"))
    base = sizes.select(F.col("c").alias("_b"), F.col("n").alias("n_b"))
    heads = heads.join(base, F.col("b") == F.col("_b"), "left").select("c", "n", "h", "b", F.least("h", F.coalesce("n_b", F.lit(0))).alias("given"))
    heads = materialize(heads, "heads")
    own = rows.join(heads.select("c", "h", "given"), "c").filter("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("given")).alias("d"), "t1", "t2", "bytes")
    shared = rows.filter("pos <= 8 and c % 5 = 0").withColumnRenamed("c", "b").join(heads.select("c", "b", "h"), "b").filter("pos <= h")
    return heads.select("c", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), own.unionByName(shared.select("c", F.col("pos").alias("d"), "t1", "t2", "bytes"))


def prefixes(rows: DataFrame) -> DataFrame:
    """(c, d, p1, p2, q1, q2, bytes, total): hashes of the first d and d - 1 turns, bytes of turn d and of the first d."""
    zero = F.lit(0).cast("long")
    own = rows.select("c", "d", "bytes", *(F.xxhash64(F.lit(10 + k), "d", "t1", "t2").alias(f"x{k}") for k in (1, 2)))
    xor = lambda a, b: a.bitwiseXOR(b)
    out = running(own, "c", "d", {"p1": (F.col("x1"), F.bit_xor, xor, zero), "p2": (F.col("x2"), F.bit_xor, xor, zero), "total": (F.col("bytes"), F.sum, lambda a, b: a + b, zero)})
    return out.select("c", "d", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "bytes", "total")


def fattest(low: Column, high: Column) -> Column:
    """The number of (low, high] that is divisible by the largest power of two."""
    shift = (F.length(F.bin(low.bitwiseXOR(high))) - 1).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", high, shift), shift)


def _at(state: DataFrame, path: DataFrame, of: str, depth: str, one: str, two: str) -> DataFrame:
    """``state`` with the hashes of the first ``depth`` turns of sequence ``of`` as ``one``, ``two`` (null where it is shorter)."""
    look = path.select(F.col("s").alias("_s"), F.col("d").alias("_d"), F.col("p1").alias(one), F.col("p2").alias(two))
    return state.join(look, (F.col(of) == F.col("_s")) & (F.col(depth) == F.col("_d")), "left").drop("_s", "_d")


def locate(batch: DataFrame, path: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """(s, length, exit): how many turns of each sequence (s, length) are in the trie already."""
    handles = nodes.filter("e > 0").select(F.col("f").alias("_f"), F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), F.col("e").alias("_e"), F.col("p1").alias("_p1"), F.col("p2").alias("_p2"), F.col("rep").alias("_rep"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    state = batch.select("s", "length", zero.alias("lo"), F.col("length").alias("hi"), zero.alias("e"), zero.alias("p1"), zero.alias("p2"), none.alias("rep"), zero.alias("hit"))
    for _ in range(max(1, longest.bit_length())):
        state = state.withColumn("f", F.when(F.col("lo") < F.col("hi"), fattest(F.col("lo"), F.col("hi"))))
        state = _at(state, path, "s", "f", "x1", "x2")
        state = state.join(handles, (F.col("f") == F.col("_f")) & (F.col("x1") == F.col("_f1")) & (F.col("x2") == F.col("_f2")), "left")
        found, active = F.col("_e").isNotNull(), F.col("f").isNotNull()
        state = materialize(state.select(
            "s", "length", F.when(found, F.least("_e", "hi")).otherwise(F.col("lo")).alias("lo"), F.when(active & ~found, F.col("f") - 1).otherwise(F.col("hi")).alias("hi"),
            *(F.when(found, F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in ("e", "p1", "p2", "rep")), F.when(found, F.col("f")).otherwise(F.col("hit")).alias("hit"),
        ), "search")
    # does the sequence hold the node's whole extent?  then it leaves by a child's edge, if there is one
    state = _at(state, path, "s", "e", "x1", "x2")
    whole = (F.col("e") == 0) | ((F.col("x1") == F.col("p1")) & (F.col("x2") == F.col("p2")))
    state = state.withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("next", F.when(F.col("whole"), F.col("e") + 1)).drop("x1", "x2")
    state = _at(state, path, "s", "next", "x1", "x2")
    firsts = nodes.filter("e > 0").select(F.col("a").alias("_a"), F.col("g1").alias("_g1"), F.col("g2").alias("_g2"), F.col("e").alias("_e"), F.col("rep").alias("_rep"))
    state = state.join(firsts, (F.col("e") == F.col("_a")) & (F.col("x1") == F.col("_g1")) & (F.col("x2") == F.col("_g2")), "left")
    inside, child = ~F.col("whole"), F.col("_e").isNotNull()
    state = materialize(state.select(
        "s", "length", F.when(inside, F.col("rep")).when(child, F.col("_rep")).alias("rep"),
        F.when(inside, F.col("hit")).when(child, F.col("next")).otherwise(F.col("e")).alias("lo"),
        F.when(inside, F.least("e", "length")).when(child, F.least("_e", "length")).otherwise(F.col("e")).alias("hi"),
    ), "edge")
    for _ in range(longest.bit_length()):
        state = state.withColumn("mid", F.when(F.col("lo") < F.col("hi"), F.floor((F.col("lo") + F.col("hi") + 1) / 2)))
        state = _at(_at(state, path, "s", "mid", "x1", "x2"), path, "rep", "mid", "y1", "y2")
        same, active = F.coalesce((F.col("x1") == F.col("y1")) & (F.col("x2") == F.col("y2")), F.lit(False)), F.col("mid").isNotNull()
        state = materialize(state.select("s", "length", "rep", F.when(same, F.col("mid")).otherwise(F.col("lo")).alias("lo"), F.when(active & ~same, F.col("mid") - 1).otherwise(F.col("hi")).alias("hi")), "common")
    return state.select("s", "length", F.col("lo").alias("exit"))


def insert(batch: DataFrame, path: DataFrame, points: DataFrame | None, nodes: DataFrame | None, longest: int) -> DataFrame:
    """The depths and hashes (d, p1, p2) of all explicit nodes but the root, after a batch of sequences (s, length, p1, p2)."""
    at = batch.select("s", "length", F.lit(0).cast("long").alias("exit")) if nodes is None else locate(batch.select("s", "length"), path, nodes, longest)
    rows = path.join(at, "s").filter("d >= exit")
    # of what is new, nodes that go on in several ways; where it leaves the trie, a node; and each end
    several = rows.filter("d > exit").select("d", "p1", "p2", "q1", "q2").distinct().groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n")).filter("n > 1")
    splits = rows.filter("d = exit or d = length").select("d", "p1", "p2")
    found = several.select("d", "p1", "p2").filter("d > 0").unionByName(splits)
    return materialize((found if points is None else found.unionByName(points)).distinct(), "points")


def compacted(path: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, nodes) for explicit points.

    steps (s, d, p1, p2, up): the nodes along each sequence, with the one above.  nodes: depth e and hash p1, p2,
    rep (the smallest sequence through it), a and b1, b2 (its parent), handle f, f1, f2, first turn g1, g2.
    """
    on = path.join(points, ["d", "p1", "p2"]).select("s", "d", "p1", "p2")
    zero = F.lit(0).cast("long")
    root = F.struct(zero.alias("d"), zero.alias("p1"), zero.alias("p2"))
    steps = running(on, "s", "d", {"up": (F.struct("d", "p1", "p2"), F.max, F.greatest, root)}, before=True)
    steps = materialize(steps, "steps")
    nodes = steps.groupBy(F.col("d").alias("e"), "p1", "p2").agg(F.min("s").alias("rep"), F.first("up").alias("up"))
    nodes = nodes.select("e", "p1", "p2", "rep", F.col("up.d").alias("a"), F.col("up.p1").alias("b1"), F.col("up.p2").alias("b2"))
    nodes = nodes.withColumn("f", fattest(F.col("a"), F.col("e"))).withColumn("first", F.col("a") + 1)
    return steps, materialize(_at(_at(nodes, path, "rep", "f", "f1", "f2"), path, "rep", "first", "g1", "g2").drop("first"), "nodes")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (s, c) rows as (s, first, ids): up to RUN ids of a sequence, joined."""
    now, ids, out = None, [], ([], [], [])

    def close():
        if ids:
            for column, value in zip(out, (now, ids[0], ",".join(map(str, ids))), strict=True):
                column.append(value)

    for b in batches:
        for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if s != now or len(ids) == RUN:
                close()
                now, ids = s, []
            ids.append(c)
        if len(out[0]) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2])], ["s", "first", "ids"])
            out = ([], [], [])
    close()
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["s", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs as (s, sha): one digest a sequence, fed run by run."""
    now, sha = None, None
    for b in batches:
        out: tuple[list, list] = ([], [])
        for s, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if s != now:
                if sha:
                    out[0].append(now)
                    out[1].append(sha.hexdigest())
                now, sha = s, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["s", "sha"])
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()])], ["s", "sha"])


def ends(members: DataFrame) -> DataFrame:
    """(s, sha): SHA-256 of the ascending, comma-joined ids c of each sequence; ids cross the network as rows once, then as runs."""
    n = partitions_for(members.sparkSession)
    runs = members.select("s", "c").repartitionByRange(n, "s", "c").sortWithinPartitions("s", "c").mapInArrow(_runs, "s long, first long, ids string")
    return runs.repartition(n, "s").sortWithinPartitions("s", "first").mapInArrow(_digests, "s long, sha string")


class Trie:
    """A trie of conversations: ``sequences``, ``members``, ``path``, ``steps`` and ``nodes`` are written tables."""

    def __init__(self, lengths: DataFrame, rows: DataFrame, eighths: tuple[int, ...] = EIGHTHS):
        """``lengths`` (c, length) has every conversation, ``rows`` (c, d, t1, t2, bytes) their turns."""
        every = materialize(prefixes(rows), "prefixes")
        last = every.select(F.col("c").alias("_c"), F.col("d").alias("_d"), "p1", "p2", "total")
        zero = F.lit(0).cast("long")
        tips = lengths.join(last, (F.col("c") == F.col("_c")) & (F.col("length") == F.col("_d")), "left")
        tips = materialize(tips.select("c", "length", *(F.coalesce(n, zero).alias(n) for n in ("p1", "p2", "total"))), "tips")
        self.sequences = materialize(tips.groupBy("length", "p1", "p2").agg(F.min("c").alias("s"), F.count("*").alias("m"), F.first("total").alias("total")), "sequences")
        self.members = tips.join(self.sequences.select("length", "p1", "p2", "s"), ["length", "p1", "p2"]).select("s", "c")
        self.path = materialize(every.join(self.sequences.select(F.col("s").alias("c")), "c", "left_semi").withColumnRenamed("c", "s"), "path")
        longest = self.sequences.agg(F.max("length")).first()[0] or 0
        points = nodes = steps = None
        low = 0
        for high in eighths:
            batch = self.sequences.filter(F.pmod(F.xxhash64("s"), F.lit(8)).between(low, high - 1) & (F.col("length") > 0))
            in_trie = self.path.filter(F.pmod(F.xxhash64("s"), F.lit(8)) < high)
            points = insert(batch, self.path, points, nodes, longest)
            steps, nodes = compacted(in_trie, points)
            low = high
        self.steps, self.nodes = steps, nodes

    def table(self) -> DataFrame:
        """One row per distinct beginning of conversations, the empty one included."""
        zero, key = F.lit(0).cast("long"), ["e", "p1", "p2"]
        nodes = self.nodes.select(*key, F.col("rep").alias("owner"), "a", "b1", "b2")
        kids = materialize(nodes.groupBy(F.col("a").alias("e"), F.col("b1").alias("p1"), F.col("b2").alias("p2")).agg(F.count("*").alias("kids")), "kids")
        seqs = self.sequences.select("s", "m", "total", F.col("length").alias("e"), "p1", "p2")
        seqs = seqs.join(kids.select(*key, F.lit(0).alias("inner")), key, "left").select("s", "m", "total", F.when(F.col("inner").isNull(), 1).otherwise(0).alias("leaf"))
        # every sequence passes the root, and its own nodes
        steps = self.steps.select("s", F.col("d").alias("e"), "p1", "p2").unionByName(self.sequences.select("s", zero.alias("e"), zero.alias("p1"), zero.alias("p2")))
        first = self.sequences.agg(F.min("s").alias("owner")).filter("owner is not null").select(zero.alias("e"), zero.alias("p1"), zero.alias("p2"), "owner", F.lit(-1).cast("long").alias("a"), zero.alias("b1"), zero.alias("b2"))
        nodes = nodes.unionByName(first)
        on = materialize(steps.join(nodes.select(*key, "owner"), key), "on")
        # a sequence owns the nodes of which it is the smallest: those below its last foreign one, whose bytes others count
        shared = on.filter("s <> owner").groupBy("s").agg(F.max("e").alias("k"))
        shared = shared.join(self.path.select(F.col("s").alias("_s"), F.col("d").alias("_d"), F.col("total").alias("foreign")), (F.col("s") == F.col("_s")) & (F.col("k") == F.col("_d")), "left").select("s", F.coalesce("foreign", zero).alias("foreign"))
        seqs = seqs.join(shared, "s", "left")
        through = on.join(seqs, "s")
        saved = (F.col("m") - 1) * F.col("total") + F.when(F.col("s") != F.col("owner"), F.coalesce("foreign", zero)).otherwise(0)
        counts = through.groupBy(*key).agg(F.sum("m").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved"))
        owners = nodes.select(F.col("e").alias("a"), F.col("p1").alias("b1"), F.col("p2").alias("b2"), F.col("owner").alias("above"))
        sha = self.sequences.join(ends(self.members), "s").select(F.col("length").alias("e"), "p1", "p2", "sha")
        full = nodes.join(counts, key).join(kids, key, "left").join(sha, key, "left").join(owners, ["a", "b1", "b2"], "left")
        full = materialize(full.select("e", "a", "owner", "above", "n_convs", "n_leaves", "saved", F.coalesce("kids", F.lit(0)).alias("kids"), F.coalesce("sha", F.lit(NO_ENDS)).alias("sha")), "full")
        # an edge's depths, a stretch at a time; the root has one
        depths = full.withColumn("_from", F.explode(F.sequence(F.col("a") + 1, F.col("e"), F.lit(STRETCH).cast("long"))))
        depths = depths.withColumn("depth", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + STRETCH - 1, F.col("e")))))
        sums = self.path.select(F.col("s").alias("_s"), F.col("d").alias("_d"), (F.col("total") - F.col("bytes")).alias("ahead"))
        out = depths.join(sums, (F.col("owner") == F.col("_s")) & (F.col("depth") == F.col("_d")), "left")
        tip = F.col("depth") == F.col("e")
        return out.select(
            F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("a") + 1, F.col("owner")).otherwise(F.col("above")).alias("parent_conv_id"), "n_convs",
            F.when(tip, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
            (F.col("saved") - (F.col("n_convs") - 1) * F.coalesce("ahead", zero)).alias("saved_tokens"), F.when(tip, F.col("sha")).otherwise(NO_ENDS).alias("ends_sha256"),
        )


def prefix_nodes(conversations: DataFrame, eighths: tuple[int, ...] = EIGHTHS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    lengths, rows = rebuild(materialize(turns(conversations), "places"))
    return Trie(lengths, rows, eighths).table()
