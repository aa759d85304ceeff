"""Conversation search: lineages, windows, BM25 discovery and Boolean matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import materialize
from .ranking import sent

K1, B = 1.2, 0.75


def lineage(sessions: DataFrame, rounds: int = 40) -> DataFrame:
    """(session_id, root, compressed): the root by parent pointers, and whether a compression lies on the way.

    Pointer doubling; ``rounds`` bounds a cycle, whose sessions then keep the pointer they have.
    """
    known = sessions.select(F.col("session_id").alias("k"))
    p = sessions.join(known, F.col("parent_session_id") == F.col("k"), "left")
    p = materialize(p.select("session_id", F.coalesce("k", "session_id").alias("root"), (F.coalesce(F.col("end_reason") == "compression", F.lit(False))).alias("compressed")))
    for _ in range(rounds):
        q = p.select(F.col("session_id").alias("q"), F.col("root").alias("q_root"), F.col("compressed").alias("q_c"))
        new = p.join(q, F.col("root") == F.col("q"), "left")
        new = materialize(new.select("session_id", F.coalesce("q_root", "root").alias("root"), (F.col("compressed") | F.coalesce("q_c", F.lit(False))).alias("compressed"), (F.col("root") != F.coalesce("q_root", "root")).alias("moved")))
        p = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    return p


def message_window(messages: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """Messages within ``width`` places of an anchor (message_id) in its session, with what lies beyond."""
    w = Window.partitionBy("session_id")
    m = messages.withColumns({"place": F.row_number().over(w.orderBy("turn", "message_id")), "n": F.count("*").over(w)})
    a = m.join(anchors, "message_id").select(F.col("message_id").alias("anchor"), F.col("session_id").alias("a_session"), F.col("place").alias("a_place"))
    near = m.join(a, (F.col("session_id") == F.col("a_session")) & F.col("place").between(F.col("a_place") - width, F.col("a_place") + width))
    return near.select("anchor", "message_id", (F.col("place") - F.col("a_place")).cast("long").alias("offset"), F.greatest(F.col("a_place") - width - 1, F.lit(0)).cast("long").alias("before"), F.greatest(F.col("n") - F.col("a_place") - width, F.lit(0)).alias("after"))


def bookends(messages: DataFrame, each: int) -> DataFrame:
    """First and last messages of each session; a message is one or the other."""
    w = Window.partitionBy("session_id")
    m = messages.withColumns({"up": F.row_number().over(w.orderBy("turn", "message_id")), "down": F.row_number().over(w.orderBy(F.desc("turn"), F.desc("message_id")))})
    return m.filter((F.col("up") <= each) | (F.col("down") <= each)).select("session_id", "message_id", F.when(F.col("up") <= each, "first").otherwise("last").alias("part"))


def read_session(messages: DataFrame, whole: int, head: int, tail: int) -> DataFrame:
    """All of a short session, else its head and tail."""
    w = Window.partitionBy("session_id")
    m = messages.withColumns({"place": F.row_number().over(w.orderBy("turn", "message_id")), "n": F.count("*").over(w)})
    return m.filter((F.col("n") <= whole) | (F.col("place") <= head) | (F.col("place") > F.col("n") - tail)).select("session_id", "message_id", "place")


def terms(text: Column) -> Column:
    """Letters (with accents) and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}0-9]+"), lambda w: w != "")


def bm25(messages: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, message_id, score, rank) by BM25 over an inverted index, only of the queries' terms."""
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    m = messages.select("message_id", terms(F.col("content")).alias("words")).withColumn("len", F.size("words"))
    stats = m.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    wanted = asked.select("term").distinct()
    index = m.select("message_id", "len", F.explode("words").alias("term")).join(sent(wanted), "term", "left_semi").groupBy("message_id", "len", "term").agg(F.count("*").alias("tf"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    rows = index.join(df, "term").join(F.broadcast(stats)).join(asked, "term")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    out = rows.groupBy("query_id", "message_id").agg(F.sum(score).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "message_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def discover(hits: DataFrame, messages: DataFrame, sessions: DataFrame, roots: DataFrame, hidden: list[str], demoted: list[str], top: int) -> DataFrame:
    """One hit a lineage root: hidden sources dropped, automation behind people, best rank first."""
    m = messages.select("message_id", "session_id")
    h = hits.join(m, "message_id").join(sessions.select("session_id", "source"), "session_id").join(roots.select("session_id", "root"), "session_id").filter(~F.col("source").isin(hidden))
    h = h.withColumn("late", F.col("source").isin(demoted))
    best = h.groupBy("query_id", "root").agg(F.min(F.struct("late", "rank", "message_id")).alias("x"))
    w = Window.partitionBy("query_id").orderBy("x")
    return best.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= top).select("query_id", "root", F.col("x.message_id").alias("message_id"), F.col("x.late").alias("late"), "pos")


def browse(messages: DataFrame, sessions: DataFrame, hidden: list[str], top: int) -> DataFrame:
    """Root sessions by last activity."""
    last = messages.groupBy("session_id").agg(F.max("at").alias("last_active"), F.count("*").alias("n"))
    roots = sessions.filter(F.col("parent_session_id").isNull() & ~F.col("source").isin(hidden))
    return roots.join(last, "session_id").orderBy(F.desc("last_active"), "session_id").limit(top).select("session_id", "last_active", "n")


def context_window(messages: DataFrame, last: int, budget: int) -> DataFrame:
    """For each user message the earlier user messages, newest first, while they fit a number of characters."""
    w = Window.partitionBy("session_id").orderBy("turn", "message_id").rowsBetween(-last, -1)
    m = messages.filter("role = 'user'").withColumn("past", F.reverse(F.collect_list("content").over(w)))
    fits = F.aggregate("past", F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open")), lambda s, x: F.struct(
        F.when(s["open"] & (s["used"] + F.length(x) <= budget), s["used"] + F.length(x)).otherwise(s["used"]).alias("used"),
        F.when(s["open"] & (s["used"] + F.length(x) <= budget), s["n"] + 1).otherwise(s["n"]).alias("n"),
        (s["open"] & (s["used"] + F.length(x) <= budget)).alias("open")))
    return m.select("message_id", fits["n"].cast("long").alias("n_context"), fits["used"].cast("long").alias("n_chars"))


def with_surroundings(hits: DataFrame, messages: DataFrame, width: int, each: int) -> DataFrame:
    """Hits (query_id, root, message_id, pos) with what a reader needs around them, in order: ``around``, the messages
    within ``width`` places of the hit, and ``opening`` and ``closing``, the ``each`` first and last of its session that
    are not around it; with how many messages lie before and after the window."""
    owner = messages.select("message_id", "session_id")
    hit = hits.join(owner, "message_id")
    m = messages.join(hit.select("session_id").distinct(), "session_id", "left_semi")
    w = Window.partitionBy("session_id")
    m = materialize(m.select("session_id", F.col("message_id").alias("other"), F.row_number().over(w.orderBy("turn", "message_id")).alias("place"), F.count("*").over(w).alias("n")))
    at = hit.join(m.select(F.col("other").alias("message_id"), F.col("place").alias("hit_place")), "message_id")
    near = F.abs(F.col("place") - F.col("hit_place")) <= width
    both = at.join(m, "session_id").filter(near | (F.col("place") <= each) | (F.col("place") > F.col("n") - each))
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("place", "other")))), lambda x: x["other"])
    first = F.col("place") <= each
    return both.groupBy("query_id", "root", "message_id", "pos").agg(
        ids(near).alias("around"), ids(~near & first).alias("opening"), ids(~near & ~first).alias("closing"),
        F.max(F.greatest(F.col("hit_place") - width - 1, F.lit(0))).cast("long").alias("before"), F.max(F.greatest(F.col("n") - F.col("hit_place") - width, F.lit(0))).alias("after"),
    )


def rebind(anchors: DataFrame, messages: DataFrame, roots: DataFrame) -> DataFrame:
    """Anchors (session_id, message_id) as asked for, with the session that holds the message: ``owner``, and ``state``:
    ``own``, ``rebound`` where another session of the same lineage holds it, ``foreign`` where one of another lineage does,
    ``missing`` where none does or the session is unknown."""
    held = messages.select("message_id", F.col("session_id").alias("owner"))
    of = roots.select(F.col("session_id").alias("_s"), F.col("root").alias("_root"))
    out = anchors.join(held, "message_id", "left").join(of, F.col("session_id") == F.col("_s"), "left").withColumnRenamed("_root", "asked").drop("_s")
    out = out.join(of, F.col("owner") == F.col("_s"), "left").withColumnRenamed("_root", "found").drop("_s")
    state = F.when(F.col("owner").isNull() | F.col("asked").isNull(), "missing").when(F.col("owner") == F.col("session_id"), "own").when(F.col("asked") == F.col("found"), "rebound").otherwise("foreign")
    return out.select("session_id", "message_id", "owner", state.alias("state"))
