"""Probe runs: questions made from facts, whether retrieval finds them, and a ledger of runs to hold the next one against."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as x

from .iterate import materialize, numbered
from .ranking import jaccard, word_set

# The templates in turn, their wording, the cuts of the ladder, the wide pool, likeness of a hit, the drop that fails a run.
TEMPLATES = ("direct", "temporal", "preference", "entity", "negation", "synonym")
LADDER, WIDE, ALIKE, AT, DROP = (5, 20, 96), 512, 0.75, 20, 0.03
# Words that name no subject.
STOP = (
    "the", "a", "an", "is", "are", "was", "were", "am", "be", "been", "i", "me", "my", "you", "your", "we", "our", "us", "this", "that", "these", "those", "it", "its", "of", "to", "in", "for", "and", "or",
    "but", "on", "with", "at", "by", "from", "as", "do", "does", "did", "what", "who", "how", "where", "when", "why", "which", "about", "so", "very", "have", "has", "had", "would", "will", "can", "could",
    "user", "likes", "prefers", "wants", "needs",
)
#: Characters of a text that are looked at first; the rest only where a question needs it.
HEAD = 400
#: Facts a block when templates are dealt in turn.
BLOCK = 65_536


def _keywords(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP))


def _subject(text: Column) -> Column:
    """The first four keywords; of texts without any, the first four words of two letters or more."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))
    keys = _keywords(text)
    return F.array_join(F.slice(F.when(F.size(keys) > 0, keys).otherwise(F.filter(words, lambda w: F.length(w) > 1)), 1, 4), " ")


def _clip(text: Column, n: int = 24) -> Column:
    """At most ``n`` characters, cut where a word ends."""
    head = F.substring(text, 1, n)
    return F.when(F.length(text) <= n, text).when(F.instr(head, " ") > 0, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)


def _renamed(text: Column, synonyms: dict[str, str]) -> Column:
    """The words of a text, one space between them, the first that has a synonym replaced by it; null without such a word."""
    bare = F.split(F.regexp_replace(F.lower(F.regexp_replace(text, r"\s+", " ")), "[^a-z ]+", ""), " ")
    other = F.create_map(*(F.lit(v) for kv in synonyms.items() for v in kv))
    # a one-element array binds the words, so that they are made once a text
    both = F.array(F.struct(F.split(text, r"\s+").alias("words"), bare.alias("bare")))
    both = F.transform(both, lambda b: F.struct(b["words"].alias("words"), b["bare"].alias("bare"), F.array_position(F.transform(b["bare"], lambda w: w.isin(*synonyms)), True).cast("int").alias("place")))
    new = lambda b: F.concat(F.slice(b["words"], 1, b["place"] - 1), F.array(F.try_element_at(other, F.get(b["bare"], b["place"] - 1))), F.slice(b["words"], b["place"] + 1, F.size(b["words"])))
    return F.get(F.transform(both, lambda b: F.when(b["place"] > 0, F.array_join(new(b), " "))), F.lit(0))


def _enough(head: Column, synonyms: dict[str, str], clip: int = 24) -> Column:
    """Whether the whole words that a text begins with give the same questions as the text: its first four keywords and
    its clip, before and after the synonym."""
    return F.coalesce(reduce(lambda a, b: a & b, ((F.length(t) > clip) & (F.size(_keywords(t)) >= 4) for t in (head, _renamed(head, synonyms)))), F.lit(False))


def questions(facts: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """``facts`` (category, content, tags, created_at) with ``asks``: a question a template, null where it does not apply.

    A null content is an empty one, for which no template applies.  ``synonyms`` gives words another name; the first
    such word of a text is replaced for the last template.
    """
    text = F.trim(F.coalesce("content", F.lit("")))
    said = facts.withColumn("_text", text).withColumn("_said", F.when(F.length("_text") > HEAD, F.regexp_replace(F.substring("_text", 1, HEAD), r"\s+\S*$", "")))
    said = said.withColumn("_said", F.when(_enough(F.col("_said"), synonyms), F.col("_said")).otherwise(F.col("_text"))).withColumn("_new", _renamed(F.col("_said"), synonyms))
    dated = x.resolved_day(F.lower("_text"), F.floor(F.col("created_at") / 86400).cast("int")).isNotNull()
    said = said.withColumns({"_subject": _subject(F.col("_said")), "_verb": F.coalesce(F.get(_keywords(F.col("_said")), F.lit(1)), F.lit("")), "_subject2": _subject(F.col("_new")), "_dated": dated})
    some = F.col("_subject") != ""
    ask = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    s, rest = F.col("_subject"), _clip(F.col("_said"))
    each = {
        "direct": F.when(some, ask("what is ", s, " ", rest, "?")), "temporal": F.when(some & F.col("_dated"), ask("when did ", s, " ", rest, "?")),
        "preference": F.when(some & (F.col("category") == "preference"), ask("what does the user prefer about ", s, "?")), "entity": F.when(some & (F.size("tags") > 0), ask(s, " ", F.col("_verb"), "?")),
        "negation": F.when(some, ask("who is NOT ", s)), "synonym": F.when(F.col("_new").isNotNull() & (F.col("_subject2") != ""), ask("what is ", F.col("_subject2"), " ", _clip(F.col("_new")), "?")),
    }
    return said.withColumn("asks", F.array(*(each[n] for n in TEMPLATES))).drop("_text", "_said", "_new", "_subject", "_verb", "_subject2", "_dated")


def step(state: int, mask: int) -> tuple[int, int]:
    """(template, next state): from ``state`` on, the first template in turn whose bit is set; -1 and no move without any."""
    for i in range(len(TEMPLATES)):
        at = (state + i) % len(TEMPLATES)
        if mask >> at & 1:
            return at, (at + 1) % len(TEMPLATES)
    return -1, state


_STEPS = [[step(s, m) for s in range(len(TEMPLATES))] for m in range(1 << len(TEMPLATES))]


def in_turn(rows: DataFrame, *order: Column, block: int = BLOCK) -> DataFrame:
    """``rows`` (key column ``memory_id``, ``asks``) with ``template`` and ``probe``: templates in turn over the whole order,
    those that don't apply skipped, exactly as one pass over all rows would deal them.

    What a block does to the turn is a map from six states to six, whatever the turn it begins with.  The maps of blocks
    of ``block`` rows are found side by side and composed in order (a short row a block), and each block is then dealt
    from its own first state.  Rows without any template are left out.
    """
    mask = F.aggregate(F.transform("asks", lambda a, i: F.when(a.isNotNull(), F.pow(F.lit(2), i).cast("int")).otherwise(0)), F.lit(0), lambda s, v: s + v)
    # questions are made once and stay where they are; what goes round is a row's number and its order
    rows = materialize(rows.withColumns({"_mask": mask, "_row": F.monotonically_increasing_id()}))
    placed = numbered(rows.drop("asks"), "_place", *order).withColumn("_block", F.floor((F.col("_place") - 1) / block))
    few = materialize(placed.select("_block", "_place", "_mask", "_row"))

    def maps(b: pd.DataFrame) -> pd.DataFrame:
        ends = list(range(len(TEMPLATES)))
        for m in b.sort_values("_place")["_mask"]:
            ends = [_STEPS[m][s][1] for s in ends]
        return pd.DataFrame({"_block": [b["_block"].iloc[0]], "ends": [ends]})

    def compose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = 0
        for b in parts:
            first = []
            for ends in b["ends"]:
                first.append(state)
                state = ends[state]
            yield pd.DataFrame({"_block": b["_block"], "state": first})

    def deal(b: pd.DataFrame) -> pd.DataFrame:
        b, state, out = b.sort_values("_place"), int(b["state"].iloc[0]), []
        for m in b["_mask"]:
            at, state = _STEPS[m][state]
            out.append(at)
        return pd.DataFrame({"_row": b["_row"], "_at": out})

    # written first: what follows is one task, which is to read the maps only
    ends = materialize(few.drop("_row").groupBy("_block").applyInPandas(maps, "_block long, ends array<int>"))
    starts = ends.coalesce(1).sortWithinPartitions("_block").mapInPandas(compose, "_block long, state int")
    dealt = few.join(starts, "_block").groupBy("_block").applyInPandas(deal, "_row long, _at int").filter("_at >= 0")
    name = F.element_at(F.array(*map(F.lit, TEMPLATES)), F.col("_at") + 1)
    out = rows.join(dealt, "_row").withColumns({"template": name, "probe": F.element_at("asks", F.col("_at") + 1)})
    return out.drop("_row", "_mask", "_at", "asks")


def run(expected: DataFrame, facts: DataFrame, hits: DataFrame, ladder: tuple[int, ...] = LADDER, wide: int = WIDE) -> DataFrame:
    """What retrieval makes of each probe: query_id, memory_id, rank (of the first hit), wide_rank, top_ids, top_scores.

    ``expected`` is (query_id, memory_id), ``hits`` (query_id, memory_id, score, rank) down to the wide pool.  A hit is the
    fact, another version of it, or a text with three quarters of the words in common, within the largest cut; the wide
    rank is that of the fact itself or else of its first version, null outside the pool.
    """
    h = materialize(hits.filter(F.col("rank") <= wide).select("query_id", "memory_id", "rank", "score"))
    # a fact's words are made once, and only where it is asked for or comes within the largest cut
    ids = expected.select("memory_id", F.lit(0).alias("first")).unionByName(h.select("memory_id", F.col("rank").alias("first"))).groupBy("memory_id").agg(F.min("first").alias("first"))
    words = F.when(F.col("first") <= max(ladder), word_set(F.coalesce("content", F.lit(""))))
    f = materialize(facts.select("memory_id", "chain_id", "content").join(ids, "memory_id").select("memory_id", "chain_id", words.alias("words")))
    e = expected.select("query_id", "memory_id").join(f, "memory_id").select("query_id", F.col("memory_id").alias("want"), F.col("chain_id").alias("want_chain"), F.col("words").alias("want_words"))
    h = h.join(f, "memory_id")
    own = F.col("memory_id") == F.col("want")
    version = own | (F.col("chain_id") == F.col("want_chain"))
    # sets of too different sizes can't be alike
    n, m = F.size("words"), F.size("want_words")
    alike = (F.least(n, m) >= ALIKE * F.greatest(n, m)) & (jaccard(F.col("words"), F.col("want_words")) >= ALIKE)
    near = (F.col("rank") <= max(ladder)) & (version | alike)
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "memory_id", F.round("score", 4).alias("score")))))
    found = e.join(h, "query_id").groupBy("query_id", "want").agg(
        F.min(F.when(near, F.col("rank"))).alias("rank"), F.coalesce(F.min(F.when(own, F.col("rank"))), F.min(F.when(version, F.col("rank")))).alias("wide_rank"), top.alias("top"),
    )
    none = F.array().cast("array<struct<rank:int,memory_id:string,score:double>>")
    return e.select("query_id", "want").join(found, ["query_id", "want"], "left").withColumn("top", F.coalesce("top", none)).select(
        "query_id", F.col("want").alias("memory_id"), "rank", "wide_rank", F.transform("top", lambda v: v["memory_id"]).alias("top_ids"), F.transform("top", lambda v: v["score"]).alias("top_scores")
    )


def recalls(found: DataFrame, about: DataFrame, groups: tuple[str, ...], ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """(k, by, value, n, recall): the share of probes hit at each cut, overall and by each column of ``about`` (query_id, ...)."""
    rows = found.join(about.select("query_id", *groups), "query_id").withColumn("k", F.explode(F.array(*map(F.lit, ladder))))
    by = F.explode(F.array(F.struct(F.lit("all").alias("by"), F.lit("").alias("value")), *(F.struct(F.lit(g).alias("by"), F.coalesce(F.col(g).cast("string"), F.lit("unknown")).alias("value")) for g in groups)))
    hit = F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)).cast("int")
    return rows.select("k", hit.alias("hit"), by.alias("g")).groupBy("k", "g.by", "g.value").agg(F.count("*").alias("n"), F.avg("hit").alias("recall"))


SCHEMA = "k int, by string, value string, n long, recall double, config string"


class RunLedger:
    """Finished runs below a folder of the shared store: one table of recalls a run, with the hash of its settings.

    A run is written once; a second one of the same name is an error, and one that died while it wrote is no run.
    """

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    def record(self, run_id: str, config: str, found: DataFrame) -> None:
        """``run_id`` with its recalls, under the settings' hash ``config``."""
        if self.finished(run_id):
            raise ValueError(f"run {run_id} is in the ledger")
        found.withColumn("config", F.lit(config)).select("k", "by", "value", "n", "recall", "config").write.mode("overwrite").parquet(f"{self.at}/{run_id}")

    def finished(self, run_id: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{run_id}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def read(self, run_id: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.at}/{run_id}") if self.finished(run_id) else self.spark.createDataFrame([], SCHEMA)

    def verdict(self, current: str, baseline: str, at: int = AT, drop: float = DROP) -> DataFrame:
        """One row (current, baseline, before, after, verdict): ``fail`` if the overall recall at ``at`` has fallen by more than
        ``drop``, else ``pass``; ``refused`` between different settings, ``missing`` where a run is not there."""
        total = lambda run, side: self.read(run).filter((F.col("k") == at) & (F.col("by") == "all")).select("recall", "config", F.lit(side).alias("side"))
        of = lambda column, side: F.max(F.when(F.col("side") == side, F.col(column)))
        j = total(current, "after").unionByName(total(baseline, "before")).agg(*(of(c, s).alias(n) for s in ("before", "after") for c, n in (("recall", s), ("config", f"{s}_config"))))
        fell = F.round(F.col("before") - F.col("after"), 9) > drop
        word = F.when(F.col("before").isNull() | F.col("after").isNull(), "missing").when(F.col("before_config") != F.col("after_config"), "refused").when(fell, "fail").otherwise("pass")
        return j.select(F.lit(current).alias("current"), F.lit(baseline).alias("baseline"), "before", "after", word.alias("verdict"))
