"""Aliases, ingest, batch insert, proposals, graph boosts and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as x
from memspark.functions import vectors
from memspark.operators import control, graph, iterate, ranking
from memspark.sources import tables as t
from memspark.sources.tables import NOW

from .base import query
from .graph_sessions import HIDDEN
from .rules import FOUND, REL, SENT, SENT_ALL, TURNS, VALID, facts, relations, turns
from .search import HYBRID, LEGS, QRELS, _facts, _hits


@query("alias_upkeep", """with l as (select lower(event_type) as alias, 'user-' || user_id as canonical, arg_max(case when value > 90 then 'remove' else 'set' end, epoch_us(ts)::hugeint * 1000000 + event_id) as op, max(value) as top from events group by all)
  select alias, canonical from l where op = 'set'""")
def alias_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """A log of settings and removals folded to the aliases that stand: the last word of each key."""
    e = t.read(spark, d, "events")
    op = F.when(F.col("value") > 90, "remove").otherwise("set")
    out = e.groupBy(F.lower("event_type").alias("alias"), F.concat(F.lit("user-"), "user_id").alias("canonical")).agg(F.max_by(op, F.struct("ts", "event_id")).alias("op"))
    return out.filter("op = 'set'").select("alias", "canonical")


@query("alias_reverse", "select 'region:' || r_name as canonical, list_sort(list(lower(n_name))) as aliases from nation join region on n_regionkey = r_regionkey group by r_name")
def alias_reverse(spark: SparkSession, d: str) -> DataFrame:
    n, r = t.read(spark, d, "nation"), t.read(spark, d, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.concat(F.lit("region:"), "r_name").alias("canonical")).agg(F.array_sort(F.collect_list(F.lower("n_name"))).alias("aliases"))


WS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9'']+'), lambda w: w <> ''))"


def _alike(spark: SparkSession, d: str, most: int | None = 25) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = iterate.materialize(relations(spark, d, most).filter(x.entity_valid(F.col("target"))).select("turn_id", "target").distinct())
    f = iterate.materialize(facts(spark, d, most).select("turn_id", "detail").distinct())
    both = r.join(f, "turn_id").filter(ranking.jaccard(ranking.word_set(F.col("target")), ranking.word_set(F.col("detail"))) >= 0.6)
    return r, f, both


ALIKE = f"""{TURNS}, {SENT}, {REL}, {FOUND}, r as (select distinct turn_id, target from rl where {VALID}), f as (select distinct turn_id, detail from fc where rule is not null),
  al as (select r.turn_id, target, detail from r join f using (turn_id) where len(list_distinct(list_concat({WS.format('target')}, {WS.format('detail')}))) > 0
    and len(list_intersect({WS.format('target')}, {WS.format('detail')})) >= 0.6e0 * len(list_distinct(list_concat({WS.format('target')}, {WS.format('detail')}))))"""


@query("overlap_anti", f"with {ALIKE} select turn_id, target from r where (turn_id, target) not in (select (turn_id, target) from al)")
def overlap_anti(spark: SparkSession, d: str) -> DataFrame:
    """Second-stage findings that no first-stage fact of the same turn says already."""
    r, _, both = _alike(spark, d)
    return r.join(both, ["turn_id", "target"], "left_anti")


def _only(n: str, said: str, table: str) -> str:
    return f"""select turn_id, count(*) as n_{n}, count(*) filter (where alone) as only_{n}, list({said} order by {said}) filter (where alone) as {n}_texts
   from (select turn_id, {said}, (turn_id, {said}) not in (select (turn_id, {said}) from al) as alone from {table}) group by 1"""


@query("stage_diff", f"""with {ALIKE.replace(SENT, SENT_ALL)}, a as ({_only('first', 'detail', 'f')}), b as ({_only('second', 'target', 'r')})
  select turn_id, coalesce(n_first, 0) as n_first, coalesce(n_second, 0) as n_second, coalesce(only_first, 0) as only_first, coalesce(only_second, 0) as only_second, coalesce(first_texts, []) as first_texts, coalesce(second_texts, []) as second_texts
  from (select distinct turn_id from turns) left join a using (turn_id) left join b using (turn_id)""")
def stage_diff(spark: SparkSession, d: str) -> DataFrame:
    """Both stages over every sentence of every turn: how much each found, and how much and what it alone found."""
    r, f, both = _alike(spark, d, None)

    def only(n: str, said: str, rows: DataFrame) -> DataFrame:
        alone = rows.join(both.select("turn_id", said).distinct().withColumn("met", F.lit(True)), ["turn_id", said], "left").withColumn("alone", F.col("met").isNull())
        return alone.groupBy("turn_id").agg(F.count("*").alias(f"n_{n}"), F.count_if("alone").alias(f"only_{n}"), F.array_sort(F.collect_list(F.when(F.col("alone"), F.col(said)))).alias(f"{n}_texts"))

    every = turns(spark, d).select("turn_id").distinct().join(only("first", "detail", f), "turn_id", "left").join(only("second", "target", r), "turn_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_first", "n_second", "only_first", "only_second")]
    return every.select("turn_id", *counts, *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("first_texts", "second_texts")))


@query("relation_union", f"with {TURNS}, {SENT}, {REL}, {FOUND}, u as (select turn_id, target, relation, 1 as pri from rl where {VALID} union all select turn_id, detail, 'states_' || rule, 2 from fc where rule is not null) select turn_id, target, min(relation) as relation from (select *, min(pri) over (partition by turn_id, target) as best from u) where pri = best group by turn_id, target")
def relation_union(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of relations; on equal (turn, target) the first source wins."""
    a = relations(spark, d).filter(x.entity_valid(F.col("target"))).select("turn_id", "target", "relation", F.lit(1).alias("pri"))
    b = facts(spark, d).select("turn_id", F.col("detail").alias("target"), F.concat(F.lit("states_"), "rule").alias("relation"), F.lit(2).alias("pri"))
    return a.unionByName(b).groupBy("turn_id", "target").agg(F.min(F.struct("pri", "relation"))["relation"].alias("relation"))


@query("graph_reactivate", f"with {HIDDEN} select src, relation, dst, case when count(*) filter (where memory_id not in (select memory_id from hid) or substr(memory_id, 5)::bigint % 2 = 0) = 0 then 'quarantined' else 'active' end as status from edges group by src, relation, dst", "mem", "edges")
def graph_reactivate(spark: SparkSession, d: str) -> DataFrame:
    """Quarantined facts leave the graph, those with even ids come back: new evidence revives an edge."""
    gone = t.mem(spark, d).filter("status = 'quarantined'").select("memory_id", "doc_id")
    return graph.revived(t.edges(spark, d), gone, gone.filter("doc_id % 2 = 0"))


RAW = """'```json' || chr(10) || '{"category":"' || case doc_id % 3 when 0 then category else 'nonsense' end || '","confidence":' || (doc_id % 4) * 0.5e0 || ',"content":"fact ' || case doc_id % 5 when 0 then '' else 'number ' || doc_id end || '"' || case when doc_id % 7 = 0 then '' else '}' end || chr(10) || '```'"""


@query("response_ingest", """select memory_id, case when doc_id % 3 = 0 then category else 'context_note' end as category, least(1e0, (doc_id % 4) * 0.5e0) as confidence, 'fact number ' || doc_id as content from mem where doc_id % 5 <> 0 and doc_id % 7 <> 0""", "mem")
def response_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Fenced JSON answers to valid rows: bad JSON and short contents go, confidences are clamped, unknown categories fall back."""
    raw = t.mem(spark, d).select("memory_id", F.expr(RAW.replace("chr(10)", "char(10)")).alias("raw"))
    bare = F.regexp_replace("raw", "(?s)^```[a-z]*\\s*|\\s*```$", "")
    # a truncated object has no closing brace
    j = raw.withColumn("bare", bare).filter(F.col("bare").endswith("}")).select("memory_id", F.from_json("bare", "category string, confidence double, content string").alias("j"))
    known = F.when(F.col("j.category").isin(*t.CATEGORIES), F.col("j.category")).otherwise("context_note")
    return j.filter(F.length(F.trim("j.content")) >= 10).select("memory_id", known.alias("category"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("j.confidence"))).alias("confidence"), F.col("j.content").alias("content"))


@query("reembed")
def reembed(spark: SparkSession, d: str) -> DataFrame:
    """Every non-empty fact gets a new vector; the encoder is a parameter of whoever calls, here hashed word counts of 64 places."""
    return vectors.encode(t.mem(spark, d).filter("length(trim(content)) > 0").select("memory_id", "content"))


@query("remember", f"""with old as (select distinct category, lower(trim(content)) as key from mem where doc_id % 2 = 0), n as (select category, lower(trim(content)) as key, min(doc_id) as doc_id from mem where doc_id % 2 = 1 group by all)
  select doc_id, category, case category when 'context_note' then {NOW} + 30 * 86400 when 'event' then {NOW} + 180 * 86400 end as expires_at from n where not exists (select 1 from old where old.category = n.category and old.key = n.key)""", "mem")
def remember(spark: SparkSession, d: str) -> DataFrame:
    """A batch of new facts (odd ids): copies within the batch and of the store (even ids) are left out, expiry is set."""
    key = F.lower(F.trim("content")).alias("key")
    m = t.mem(spark, d)
    new = m.filter("doc_id % 2 = 1").groupBy("category", key).agg(F.min("doc_id").alias("doc_id"))
    new = new.join(m.filter("doc_id % 2 = 0").select("category", key).distinct(), ["category", "key"], "left_anti")
    days = F.when(F.col("category") == "context_note", 30).when(F.col("category") == "event", 180)
    return new.select("doc_id", "category", (F.lit(NOW) + days * 86400).cast("long").alias("expires_at"))


@query("emit_proposals", """select 'cand-' || sha256('chain|' || chain_id)[1:16] as candidate_id, case when bool_or(status = 'quarantined') then 'context_note' else 'insight' end as category, count(*) as n_sources,
   string_agg(content[1:60], ' / ' order by doc_id)[1:200] as content from mem group by chain_id having count(*) >= 2""", "mem")
def emit_proposals(spark: SparkSession, d: str) -> DataFrame:
    """One proposal a cluster with at least two sources; equal runs give equal ids."""
    lines = F.array_sort(F.collect_list(F.struct("doc_id", F.substring("content", 1, 60).alias("c"))))
    g = t.mem(spark, d).groupBy("chain_id").agg(F.bool_or(F.col("status") == "quarantined").alias("q"), F.count("*").alias("n_sources"), lines.alias("l")).filter("n_sources >= 2")
    key = F.substring(F.sha2(F.concat(F.lit("chain|"), "chain_id"), 256), 1, 16)
    text = F.substring(F.array_join(F.transform("l", lambda v: v["c"]), " / "), 1, 200)
    return g.select(F.concat(F.lit("cand-"), key).alias("candidate_id"), F.when(F.col("q"), "context_note").otherwise("insight").alias("category"), "n_sources", text.alias("content"))


@query("chain_unfold", HYBRID + """, n as (select chain_id, count(*) as versions from mem group by chain_id), c as (select query_id, rank, m.chain_id, versions from top join mem m using (memory_id) join n on n.chain_id = m.chain_id where rank <= 3 and raw >= 0.3e0 and versions > 1)
  select query_id, arg_min(chain_id, rank) as chain_id, arg_min(versions, rank) as versions from c group by query_id""", "mem", "q", "signal")
def chain_unfold(spark: SparkSession, d: str) -> DataFrame:
    """The chain to unfold for a query: the first of its three best hits that is near enough and has a history."""
    m = t.mem(spark, d).select("memory_id", "chain_id")
    n = m.groupBy("chain_id").agg(F.count("*").alias("versions"))
    c = _hits(spark, d).filter("rank <= 3 and raw >= 0.3").join(m, "memory_id").join(n, "chain_id").filter("versions > 1")
    return c.groupBy("query_id").agg(F.min_by("chain_id", "rank").alias("chain_id"), F.min_by("versions", "rank").alias("versions"))


@query("graph_search_rank", HYBRID + """, g as (select memory_id, count(*) as n from edges where relation in ('based_in', 'lives_in') group by memory_id), b as (select query_id, top.memory_id, greatest(score, case when n is not null then 0.6e0 else 0 end) as score from top left join g using (memory_id))
  select query_id, memory_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 12) desc, memory_id) as rank from b""", "mem", "q", "signal", "edges")
def graph_search_rank(spark: SparkSession, d: str) -> DataFrame:
    """Hits that typed edges support get a floor under their score, and ranks anew."""
    g = t.edges(spark, d).filter(F.col("relation").isin("based_in", "lives_in")).select("memory_id").distinct().withColumn("linked", F.lit(0.6))
    b = _hits(spark, d).drop("rank").join(g, "memory_id", "left").withColumn("score", F.greatest("score", F.coalesce("linked", F.lit(0.0))))
    return ranking.ranked(b, 10).select("query_id", "memory_id", F.round("score", 6).alias("score"), "rank")


ARMS = LEGS + f""", {QRELS}, arms as (select 'keyword' as arm, query_id, memory_id, rank from kr where rank <= 10 union all select 'vector', query_id, memory_id, rank from vr where rank <= 10),
  hit as (select arm, query_id, count(rel.memory_id) / 10e0 as p10 from arms left join rel using (query_id, memory_id) group by all), av as (select arm, avg(p10) as p10 from hit group by arm)"""


def _arms(spark: SparkSession, d: str) -> DataFrame:
    q, f = t.search_queries(spark, d), _facts(spark, d)
    rel = q.select("query_id", "query_label").join(t.mem(spark, d).filter("label is not null").select("memory_id", "label"), F.col("query_label") == F.col("label")).select("query_id", "memory_id", F.lit(1).alias("hit"))
    arms = ranking.ranked(ranking.keyword_scores(q, f), 10).withColumn("arm", F.lit("keyword")).unionByName(vectors.top_k(q, f, 10).withColumn("arm", F.lit("vector")))
    hit = arms.join(rel, ["query_id", "memory_id"], "left").groupBy("arm", "query_id").agg((F.count("hit") / 10).alias("p10"))
    return hit.groupBy("arm").agg(F.avg("p10").alias("p10"))


@query("arm_deltas", ARMS + " select arm, round(p10, 6) as p10, round(p10 - (select p10 from av where arm = 'keyword'), 6) as delta from av", "mem", "q")
def arm_deltas(spark: SparkSession, d: str) -> DataFrame:
    a = _arms(spark, d)
    base = a.filter("arm = 'keyword'").select(F.col("p10").alias("b"))
    return a.join(F.broadcast(base), how="left").select("arm", F.round("p10", 6).alias("p10"), F.round(F.col("p10") - F.col("b"), 6).alias("delta"))


@query("verdict", ARMS + " select (select p10 from av where arm = 'vector') < (select p10 from av where arm = 'keyword') - 0.03e0 as failed", "mem", "q")
def verdict(spark: SparkSession, d: str) -> DataFrame:
    """A run fails when its precision drops by more than three points against the baseline arm."""
    p = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("p10")))
    return _arms(spark, d).agg((p("vector") < p("keyword") - 0.03).alias("failed"))


@query("pool_stats", HYBRID + f""", {t.EXPECTED} select round(avg((f.memory_id is null)::int), 6) as not_in_pool, round(avg(t.rank), 6) as mean_rank from w left join fused f using (query_id, memory_id) left join top t using (query_id, memory_id)""", "mem", "q", "signal")
def pool_stats(spark: SparkSession, d: str) -> DataFrame:
    """Share of expected facts outside the wide pool, and the mean rank of those found."""
    q, f = t.search_queries(spark, d), _facts(spark, d)
    w = t.expected_facts(spark, d)
    pool = ranking.fuse(ranking.ranked(ranking.keyword_scores(q, f), 200), vectors.top_k(q, f, 40)).select("query_id", "memory_id", F.lit(1).alias("here"))
    j = w.join(pool, ["query_id", "memory_id"], "left").join(_hits(spark, d).select("query_id", "memory_id", "rank"), ["query_id", "memory_id"], "left")
    return j.agg(F.round(F.avg(F.col("here").isNull().cast("int")), 6).alias("not_in_pool"), F.round(F.avg("rank"), 6).alias("mean_rank"))


_TITLE = "lower(trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')))[1:80]"


@query("title_match", f"with s as (select conv_id as session_id, {_TITLE} as title from conversations where turn = 0) select a.session_id as query_id, b.session_id from s a join s b using (title) where a.session_id % 50 = 0 and length(title) > 0")
def title_match(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with the title (the first line of the first turn) that is asked for: the titles of every fiftieth session."""
    line = F.lower(F.trim(F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r"\s+", " ")))
    s = t.read(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("session_id"), F.substring(line, 1, 80).alias("title")).filter("length(title) > 0")
    q = s.filter("session_id % 50 = 0").select(F.col("session_id").alias("query_id"), "title")
    return q.join(s, "title").select("query_id", "session_id")


@query("run_gate", f"select category, count(*) filter (where created_at > {NOW - 45 * 86400}) as n_new, max(created_at) as watermark, count(*) filter (where created_at > {NOW - 45 * 86400}) >= 20 and {NOW} - max(created_at) >= 86400 as runs from mem where status = 'active' group by category", "mem")
def run_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which categories are due: enough new facts, and a day since the last one."""
    new = F.count_if(F.col("created_at") > NOW - 45 * 86400)
    return t.mem(spark, d).filter("status = 'active'").groupBy("category").agg(new.alias("n_new"), F.max("created_at").alias("watermark"), ((new >= 20) & (F.lit(NOW) - F.max("created_at") >= 86400)).alias("runs"))


_STATE = f"st as (select category as scope, {NOW} - (min(doc_id) % 7) * 6 * 3600 as last_run, min(created_at) + (min(doc_id) % 5) * 7200 as watermark from mem where category <> 'goal' group by category)"


@query("run_plan", f"""with {_STATE}, f as (select * from mem where status = 'active'), g as (select f.category, count(*) filter (where watermark is null or created_at > watermark) as n_new, any_value(last_run) as last_run, any_value(watermark) as watermark from f left join st on scope = f.category group by f.category),
  r as (select *, case when {NOW} - last_run < 86400 then 'cooldown' when n_new < 20 then 'novelty' else 'due' end as reason from g),
  k as (select f.category, f.created_at, f.memory_id, row_number() over (partition by f.category order by f.created_at, f.memory_id) as n from f join r using (category) where reason = 'due' and (watermark is null or f.created_at > watermark) qualify n <= 100)
  select category, n_new, reason, (select count(*) from k where k.category = r.category) as taken, (select max(created_at) from k where k.category = r.category) as next_mark from r""", "mem")
def run_plan(spark: SparkSession, d: str) -> DataFrame:
    """Which categories a background run is due for, given when each last ran and how far; what it takes, and where its watermark would go."""
    m, i = t.mem(spark, d), F.min("doc_id")
    state = m.filter("category <> 'goal'").groupBy(F.col("category").alias("scope")).agg((NOW - i % 7 * 6 * 3600).alias("last_run"), (F.min("created_at") + i % 5 * 7200).alias("watermark"))
    f = m.filter("status = 'active'").select("category", "memory_id", "created_at")
    due = control.gate(f, state, NOW)
    taken = control.batch(f, due, F.col("memory_id")).groupBy(F.col("category").alias("_c")).agg(F.count("*").alias("taken"), F.max("created_at").alias("next_mark"))
    return due.join(taken, F.col("scope") == F.col("_c"), "left").select(F.col("scope").alias("category"), "n_new", "reason", F.coalesce("taken", F.lit(0)).alias("taken"), "next_mark")


@query("probes", "select memory_id, (row_number() over (partition by category order by doc_id) - 1) % 3 as template, case (row_number() over (partition by category order by doc_id) - 1) % 3 when 0 then 'What about ' || content[1:40] || '?' when 1 then 'When was ' || content[1:40] || '?' else 'Is it true that ' || content[1:40] || '?' end as probe from mem where status = 'active'", "mem")
def probes(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation questions from facts, templates in turn; the turn comes from places in the order of (category, doc_id)."""
    p = iterate.numbered(t.mem(spark, d).filter("status = 'active'").select("memory_id", "category", "doc_id", "content"), "place", F.col("category"), F.col("doc_id"))
    first = p.groupBy(F.col("category").alias("_c")).agg(F.min("place").alias("_first"))  # a row a category
    p = p.join(F.broadcast(first), F.col("category") == F.col("_c")).withColumn("template", (F.col("place") - F.col("_first")) % 3)
    head = F.substring("content", 1, 40)
    text = F.when(F.col("template") == 0, F.concat(F.lit("What about "), head, F.lit("?"))).when(F.col("template") == 1, F.concat(F.lit("When was "), head, F.lit("?"))).otherwise(F.concat(F.lit("Is it true that "), head, F.lit("?")))
    return p.select("memory_id", "template", text.alias("probe"))
