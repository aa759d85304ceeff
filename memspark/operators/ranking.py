"""Hybrid retrieval for tables of queries: keyword and vector legs, fusion, re-ranking, dates, rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from memspark.functions.vectors import top_k

from .iterate import materialize, numbered

RRF_K = 20
#: A query table up to this many rows is sent to the tasks; a larger one is joined without a hint.
MAX_SENT_QUERIES = 10_000
#: Sets of terms sent to the tasks at a time; facts that ``keyword_best`` looks at first, and how many times as many in each next round.
MAX_SENT_SETS, FIRST_FACTS, MORE_FACTS = 200_000, 1024, 4
# Weights and clamps of the importance adjustment.
BASE_CLAMP, FEEDBACK_CLAMP = 0.03, 0.08
FORGIVE_DAYS = 180


def sent(queries: DataFrame, most: int = MAX_SENT_QUERIES) -> DataFrame:
    """The query side with a broadcast hint, but only where its size is within the bound."""
    return F.broadcast(queries) if queries.limit(most + 1).count() <= most else queries


def query_tokens(text: Column, most: int = 4, longer_than: int = 2) -> Column:
    return F.slice(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > longer_than), 1, most)


def contained_terms(terms: DataFrame, texts: DataFrame, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(term, text): which of the distinct short ``texts`` hold which of the ``terms``, by an equi-join on characters.

    A term's first three characters (fewer for a shorter one) are its key, and a text has a key for each run of
    ``sizes`` characters; what meets is checked by plain contains.
    """
    t = terms.select("term").distinct().filter(F.length("term") > 0).withColumn("key", F.substring("term", 1, 3))

    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - (n - 1), F.lit(1))), lambda i: F.substr("text", i, F.lit(n)))
        return F.when(F.length("text") >= n, every).otherwise(F.array().cast("array<string>"))

    keyed = texts.select("text").distinct().withColumn("key", F.explode(F.array_distinct(F.concat(*map(runs, sizes)))))
    return t.join(keyed, "key").filter(F.contains("text", "term")).select("term", "text")


def keyword_scores(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, memory_id, score): share of the query's first tokens that a fact contains, above zero.

    A query token has no white space, so a fact contains it where one of the fact's own words does: tokens meet the
    vocabulary, and the vocabulary's words lead to the facts.  No query is compared with every fact.
    """
    asked, words = _asked_words(queries), _fact_words(facts)
    found = contained_terms(asked, words, (3,)).join(words, "text").select("term", "memory_id").distinct()
    return asked.join(found, "term").groupBy("query_id", "memory_id").agg((F.count("*") / F.max("n")).alias("score"))


def _asked_words(queries: DataFrame) -> DataFrame:
    """(query_id, n, term) of the queries' first tokens, n of them."""
    q = queries.select("query_id", query_tokens(F.col("query")).alias("words")).filter(F.size("words") > 0)
    return q.select("query_id", F.size("words").alias("n"), F.explode("words").alias("term"))


def _fact_words(facts: DataFrame) -> DataFrame:
    return facts.select("memory_id", F.explode(F.array_distinct(F.split(F.lower("content"), r"\s+"))).alias("text"))


def keyword_best(queries: DataFrame, facts: DataFrame, least: float) -> DataFrame:
    """(query_id, memory_id, score): the first fact by ``keyword_scores``, then id, where its score is ``least`` or more.

    A query's score is one of the few that sets of its own terms make, so sets take the place of facts, each distinct one
    once for all queries.  Facts are looked at in the order of their ids, a few first and then more and more, and only
    those of a set's rarest term; a query that has a fact goes on with its better sets alone.  A fact's terms are one row
    of numbers, and no row is written for a set and a fact.
    """
    asked, words = materialize(_asked_words(queries)), _fact_words(facts)
    order = numbered(facts.select("memory_id").distinct(), "place", F.col("memory_id"))
    terms = numbered(asked.select("term").distinct(), "t", F.col("term")).select("term", F.col("t").cast("int"))
    leads = materialize(contained_terms(asked, words, (3,)).join(terms, "term").groupBy("text").agg(F.collect_list("t").alias("ts")))
    # a fact's lists of terms meet once, and only then are told apart
    held = words.join(leads, "text").select("memory_id", "ts").repartition("memory_id").select("memory_id", F.explode("ts").alias("t"))
    held = held.groupBy("memory_id").agg(F.collect_set("t").alias("held"))
    found = materialize(held.join(order, "memory_id").select("place", "held"))
    often = found.select(F.explode("held").alias("t")).groupBy("t").agg(F.count("*").alias("often"))
    own = asked.join(terms, "term").groupBy("query_id", "n", "t").agg(F.count("*").alias("k")).join(often, "t")
    own = own.groupBy("query_id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "t", "k"))).alias("own"))
    # every set of a query's terms, the rarest first
    bits = F.expr("explode(sequence(1, 15)) as bits")
    sets = own.filter(F.size("own") > 0).select("query_id", "n", "own", bits).filter("bits < shiftleft(1, size(own))")
    sets = sets.select("query_id", "n", F.expr("filter(own, (x, i) -> shiftright(bits, i) & 1 = 1)").alias("own"))
    score = F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["k"]) / F.col("n")
    # four columns a set; where it has fewer terms the first stands again
    key = ["t1", "t2", "t3", "t4"]
    term = [F.coalesce(F.get("own.t", F.lit(i)), F.get("own.t", F.lit(0))).alias(c) for i, c in enumerate(key)]
    sets = sets.select("query_id", score.alias("score"), F.round(score, 12).alias("level"), *term)
    left = materialize(sets.filter(F.col("score") >= least))
    last = found.agg(F.max("place")).first()[0] or 0
    best, at, more = None, 0, FIRST_FACTS
    while at < last:
        now = left.select(*key).distinct()
        parts = -(-now.count() // MAX_SENT_SETS)
        if not parts:
            break
        near = found.filter((F.col("place") > at) & (F.col("place") <= at + more)).select("place", "held", F.explode("held").alias("t1"))
        firsts = None
        for i in range(parts):
            some = F.broadcast(now.filter(F.pmod(F.hash(*key), F.lit(parts)) == i))
            hits = near.join(some, "t1").filter(" and ".join(f"array_contains(held, {c})" for c in key[1:]))
            hits = hits.groupBy(*key).agg(F.min("place").alias("place"))
            firsts = hits if firsts is None else firsts.unionByName(hits)
        first = left.join(firsts, key).groupBy("query_id").agg(F.max(F.struct("level", (-F.col("place")).alias("back"), "score")).alias("best"))
        first = materialize(first)
        best = first if best is None else best.unionByName(first)
        done = first.select("query_id", F.col("best.level").alias("reached"))
        left = materialize(left.join(done, "query_id", "left").filter("reached is null or level > reached").drop("reached"))
        at, more = at + more, more * MORE_FACTS
    if best is None:
        return queries.sparkSession.createDataFrame([], StructType([queries.schema["query_id"], facts.schema["memory_id"], StructField("score", DoubleType())]))
    best = best.groupBy("query_id").agg(F.max("best").alias("best")).select("query_id", (-F.col("best").getField("back")).alias("place"), "best.score")
    return best.join(order, "place").select("query_id", "memory_id", "score")


def ranked(scores: DataFrame, most: int, score: str = "score") -> DataFrame:
    """Adds ``rank`` by score, then id, and keeps the first ``most`` of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 12)), "memory_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def fuse(first: DataFrame, second: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists; where a query has one list only, that list's own scores.

    Result: query_id, memory_id, score, score_kind ('rrf' or 'single').
    """
    both = first.select("query_id", "memory_id", "score", "rank", F.lit(1).alias("leg")).unionByName(second.select("query_id", "memory_id", "score", "rank", F.lit(2).alias("leg")))
    legs = both.groupBy("query_id").agg((F.min("leg") != F.max("leg")).alias("two"))
    rows = both.groupBy("query_id", "memory_id").agg((F.sum(1.0 / (k + F.col("rank"))) / (2.0 / (k + 1))).alias("rrf"), F.max("score").alias("own"))
    return rows.join(legs, "query_id").select("query_id", "memory_id", F.when(F.col("two"), F.col("rrf")).otherwise(F.col("own")).alias("score"), F.when(F.col("two"), "rrf").otherwise("single").alias("score_kind"))


def days_between(now: int, then: Column) -> Column:
    return F.greatest(F.floor((F.lit(now) - then) / 86400), F.lit(0))


def importance(now: int) -> Column:
    """Additive adjustment from age, dormancy and feedback; needs created_at, last_at, last_retrieved, counts, confidence."""
    age = days_between(now, F.col("created_at"))
    idle = F.when(F.col("last_retrieved").isNotNull(), 0.001 * F.least(days_between(now, F.col("last_retrieved")), F.lit(365))).otherwise(0.0)
    base = 0.10 * F.exp(-age / 90.0) - 0.0005 * F.least(age, F.lit(730)) - idle
    forgiven = F.greatest(F.lit(0.0), 1.0 - days_between(now, F.col("last_at")) / FORGIVE_DAYS)
    feedback = 0.05 * F.col("helpful") - F.when(F.col("dismissed") > 0, 0.10 * F.col("dismissed") * F.coalesce(forgiven, F.lit(1.0))).otherwise(0.0) + 0.08 * (F.col("confidence") - 0.5) + 0.02 * F.least(F.col("retrieved"), F.lit(20))
    clamp = lambda c, m: F.greatest(F.lit(-m), F.least(F.lit(m), c))
    return clamp(base, BASE_CLAMP) + clamp(feedback, FEEDBACK_CLAMP)


def with_counters(facts: DataFrame, signals: DataFrame) -> DataFrame:
    """Facts with helpful, dismissed, retrieved, last_at and last_retrieved."""
    is_seen = F.col("kind") == "retrieved"
    s = signals.groupBy(F.col("memory_id").alias("s_id")).agg(F.count_if(F.col("kind") == "helpful").alias("helpful"), F.count_if(F.col("kind") == "dismissed").alias("dismissed"), F.count_if(is_seen).alias("retrieved"), F.max("at").alias("last_at"), F.max(F.when(is_seen, F.col("at"))).alias("last_retrieved"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return facts.join(s, F.col("memory_id") == F.col("s_id"), "left").select(*facts.columns, n("helpful"), n("dismissed"), n("retrieved"), "last_at", "last_retrieved")


def adjust(scores: DataFrame, facts: DataFrame, now: int) -> DataFrame:
    """``score`` moved by importance, not below zero; the score before stays as ``raw``."""
    f = facts.select(F.col("memory_id").alias("f_id"), importance(now).alias("adj"))
    return scores.join(f, F.col("memory_id") == F.col("f_id")).withColumns({"raw": F.col("score"), "score": F.greatest(F.lit(0.0), F.col("score") + F.col("adj"))}).drop("f_id", "adj")


def blend(rows: DataFrame, other: str, top: int) -> DataFrame:
    """0.8 of the score and 0.2 of another model's min-max score for the first ``top``; the rest stays below."""
    w = Window.partitionBy("query_id")
    inside = F.col("rank") <= top
    x = F.when(inside, F.col(other))
    low, high = F.min(x).over(w), F.max(x).over(w)
    part = F.when(high > low, (F.col(other) - low) / (high - low)).otherwise(0.5)
    return rows.withColumn("blended", F.when(inside, 0.8 * F.col("score") + 0.2 * part).otherwise(F.col("score")))


def phrases(query: Column, stop: list[str]) -> Column:
    """The query's bigrams, stop words left out; worked out once a query, before it meets the facts."""
    words = F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}0-9]+"), F.lit(0)), lambda w: ~w.isin(stop))
    pairs = F.transform(F.array(words), lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.coalesce(pairs[0], F.array().cast("array<string>"))


def phrase_share(of: str, low: str) -> Column:
    """Share of the phrases in column ``of`` that the column ``low``, a lower-cased text, holds word for word."""
    return F.coalesce(F.try_divide(F.size(F.filter(of, lambda p: F.contains(F.col(low), p))), F.size(of)), F.lit(0.0))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9']+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def newer_wins(rows: DataFrame, least: float = 0.6, span: int = 3, lift: float = 0.005) -> DataFrame:
    """Of two similar hits within ``span`` ranks, the newer gets the older one's score and a little more."""
    words = rows.withColumn("words", word_set(F.col("content"))).withColumn("n", F.size("words"))
    a, b = (words.select(*(F.col(c).alias(f"{s}_{c}") for c in ("query_id", "memory_id", "rank", "score", "created_at", "words", "n"))) for s in "ab")
    # sets of too different sizes can't be alike, and a union's size follows from the common words
    sizes = F.least("a_n", "b_n") >= F.floor(least * F.greatest("a_n", "b_n"))
    close = (F.col("a_query_id") == F.col("b_query_id")) & (F.abs(F.col("a_rank") - F.col("b_rank")) <= span) & (F.col("a_created_at") < F.col("b_created_at")) & sizes
    common = F.array(F.size(F.array_intersect("a_words", "b_words")))
    alike = F.transform(common, lambda i: F.try_divide(i, F.col("a_n") + F.col("b_n") - i))[0]
    pairs = a.join(b, close).filter(alike >= least)
    lifted = pairs.groupBy(F.col("b_query_id").alias("q_"), F.col("b_memory_id").alias("m_")).agg((F.max("a_score") + lift).alias("floor_"))
    return rows.join(lifted, (F.col("query_id") == F.col("q_")) & (F.col("memory_id") == F.col("m_")), "left").withColumn("score", F.greatest("score", F.coalesce("floor_", "score"))).drop("q_", "m_", "floor_")


def hybrid(queries: DataFrame, facts: DataFrame, signals: DataFrame, now: int, k: int = 10, keyword_pool: int = 200, vector_pool: int | None = None) -> DataFrame:
    """query_id, memory_id, score, raw, score_kind, rank: both legs, fusion, importance, top k."""
    return combined(ranked(keyword_scores(queries, facts), keyword_pool), top_k(queries, facts, vector_pool or 4 * k), facts, signals, now, k)


def combined(first: DataFrame, second: DataFrame, facts: DataFrame, signals: DataFrame, now: int, k: int = 10) -> DataFrame:
    """What ``hybrid`` makes of the two legs, for those who have them already."""
    return ranked(adjust(fuse(first, second), with_counters(facts, signals), now), k)


def pair_score(query: Column, content: Column) -> Column:
    """The scorer that stands where no model is given: overlap of the two texts' words."""
    return jaccard(word_set(query), word_set(content))


def hybrid_full(queries: DataFrame, facts: DataFrame, signals: DataFrame, now: int, stop: list[str], scorer: Callable[[Column, Column], Column] = pair_score, k: int = 10, rescored: int = 20, lift: float = 0.05) -> DataFrame:
    """query_id, memory_id, score, raw, rank: both legs, fusion, another scorer's blend, phrase lift, importance, newer wins.

    ``scorer`` gives a column from a query's and a fact's text (a model's pandas UDF, or an expression); ``raw`` is the
    score before phrase lift and importance.
    """
    # each written once: later steps read them several times
    fused = materialize(fuse(ranked(keyword_scores(queries, facts), 200), top_k(queries, facts, 4 * k)))
    rows = fused.join(facts.select("memory_id", "content", F.lower("content").alias("low")), "memory_id").join(materialize(queries.select("query_id", "query", phrases(F.col("query"), stop).alias("phrases"))), "query_id")
    first = ranked(rows, rescored).withColumn("other", scorer(F.col("query"), F.col("content")))
    kept = blend(first, "other", rescored).select("query_id", "memory_id", "blended")
    rows = rows.drop("content").join(kept, ["query_id", "memory_id"], "left").withColumn("raw", F.coalesce("blended", "score"))
    rows = rows.withColumn("score", F.col("raw") + lift * phrase_share("phrases", "low"))
    adjusted = adjust(rows.select("query_id", "memory_id", "score", F.col("raw").alias("first")), with_counters(facts, signals), now).drop("raw")
    pool = materialize(ranked(adjusted, 4 * k).join(facts.select("memory_id", "content", "created_at"), "memory_id"))
    return ranked(newer_wins(pool).drop("rank"), k).select("query_id", "memory_id", "score", F.col("first").alias("raw"), "rank")


def with_graph(base: DataFrame, linked: DataFrame, near: DataFrame, k: int, alias_floor: float = 0.70, traversal_floor: float = 0.60, least: float = 0.15, boost: float = 0.15) -> DataFrame:
    """query_id, memory_id, score, rank: ranked hits joined by what the graph knows.

    ``base`` has query_id, memory_id, score; ``linked`` query_id, memory_id and kind: 1 by alias, 2 by traversal, 3 by the
    words of an edge, with ``place`` from 0 for the last; ``near`` the cosine of linked facts that are not in ``base``.
    Facts by alias or traversal come in if their cosine is ``least`` or more, and have a floor; facts by words get a
    boost that falls with their place.
    """
    kinds = linked.groupBy("query_id", "memory_id").agg(F.min("kind").alias("kind"), F.min("place").alias("place"))
    many = linked.filter("kind = 3").groupBy("query_id").agg(F.count("*").alias("many"))
    fresh = kinds.filter("kind < 3").join(near, ["query_id", "memory_id"]).join(base.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti").filter(F.col("cosine") >= least)
    rows = base.select("query_id", "memory_id", "score").unionByName(fresh.select("query_id", "memory_id", F.col("cosine").alias("score")))
    rows = rows.join(kinds, ["query_id", "memory_id"], "left").join(many, "query_id", "left")
    lifted = F.when((F.col("kind") == 3) & (F.col("score") >= least), F.col("score") + boost * (1 - F.col("place") / F.col("many"))).otherwise(F.col("score"))
    score = F.when(F.col("kind") == 1, F.greatest("score", F.lit(alias_floor))).when(F.col("kind") == 2, F.greatest("score", F.lit(traversal_floor))).otherwise(lifted)
    return ranked(rows.select("query_id", "memory_id", score.alias("score")), k)


def merge_subqueries(rows: DataFrame, k: int = RRF_K) -> DataFrame:
    """(parent, memory_id, score) over the ranked lists of a query and its sub-queries, best scaled to one."""
    s = rows.groupBy("parent", "memory_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("s"))
    return s.withColumn("score", F.col("s") / F.max("s").over(Window.partitionBy("parent"))).drop("s")


def render(rows: DataFrame, width: int = 800) -> DataFrame:
    """One text a query: a line a hit with day, category, cut content, score (three places, cut) and id."""
    cut = F.when(F.length("flat") <= width, F.col("flat")).otherwise(F.concat(F.regexp_replace(F.substring("flat", 1, width), " [^ ]*$", ""), F.lit("...")))
    day = F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd")
    rows = rows.withColumn("flat", F.regexp_replace("content", r"\s+", " "))
    line = F.concat(F.lit("["), day, F.lit("] ["), "category", F.lit("] "), cut, F.lit(" ("), F.format_string("%.3f", F.floor(F.col("score") * 1000 + 1e-6) / 1000), F.lit(") ["), "memory_id", F.lit("]"))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))
