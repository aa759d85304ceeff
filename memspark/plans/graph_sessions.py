"""Duplicates, graph and conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators import chains, dedup, graph, querying, ranking, sessions
from memspark.sources import tables as t
from memspark.sources.tables import NOW

from .base import query

SAME = "a.category = b.category and a.user_scope is not distinct from b.user_scope and a.project_id is not distinct from b.project_id"
CONTAINED = """fl as (select memory_id, category, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) as f from mem where status = 'active' and length(trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))) >= 20),
  rep as (select category, f, min(memory_id) as id from fl group by category, f),
  con as (select fl.memory_id as short_id, rep.id as long_id from fl join rep using (category, f) where fl.memory_id <> rep.id
    union all select a.id, b.id from rep a join rep b on a.category = b.category and length(a.f) < length(b.f) and contains(b.f, a.f))"""
PAIRS = f"""act as (select * from mem where status = 'active' and embedding is not null),
  pr as (select a.memory_id as a, b.memory_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as cosine from act a join act b on {SAME} and a.memory_id < b.memory_id
    where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.35)"""
MERGED = "mg as (select src, relation, dst, list_sort(list(distinct memory_id)) as evidence from edges group by all)"


def _active(spark: SparkSession, d: str) -> DataFrame:
    return t.mem(spark, d).filter("status = 'active'")


@query("dup_containment", "with " + CONTAINED + " select short_id, long_id from con", "mem")
def dup_containment(spark: SparkSession, d: str) -> DataFrame:
    return dedup.containment_pairs(_active(spark, d))


#: Facts and, as further facts, the single sentences of every sixteenth: texts that lie inside others.
QUOTED = """qs as (select doc_id, category, status, trim(s) as content, 'q-' || doc_id || '-' || i as memory_id from (select doc_id, category, status, unnest(string_split(content, '. ')) as s, generate_subscripts(string_split(content, '. '), 1) as i from mem where doc_id % 16 = 0)),
  both_ as (select memory_id, category, status, content from mem union all select memory_id, category, status, content from qs)"""


@query("dup_quotes", "with " + QUOTED + ", " + CONTAINED.replace("from mem", "from both_") + " select short_id, long_id from con", "mem")
def dup_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Containment where it is common: sentences cut from the middle of facts, beside the facts."""
    m = t.mem(spark, d).select("memory_id", "category", "status", "content", "doc_id")
    parts = m.filter("doc_id % 16 = 0").select("doc_id", "category", "status", F.posexplode(F.split("content", "[.] ")).alias("i", "s"))
    quotes = parts.select(F.concat(F.lit("q-"), "doc_id", F.lit("-"), F.col("i") + 1).alias("memory_id"), "category", "status", F.trim("s").alias("content"))
    return dedup.containment_pairs(m.drop("doc_id").unionByName(quotes).filter("status = 'active'"))


@query("seed_star")
def seed_star(spark: SparkSession, d: str) -> DataFrame:
    """Clusters around the newest free fact, up to seven others by their likeness to it."""
    return dedup.seed_stars(_active(spark, d), 0.30)


@query("dup_semantic_pairs", "with " + PAIRS + " select a, b, round(cosine, 6) as cosine from pr", "mem")
def dup_semantic_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.semantic_pairs(_active(spark, d), 0.35).select("a", "b", F.round("cosine", 6).alias("cosine"))


LABELS = "v as (select memory_id, label, embedding::double[] as e from mem where status = 'active' and embedding is not null)"


@query("semantic_by_label", "with " + LABELS + " select a.memory_id as a, b.memory_id as b, round(list_cosine_similarity(a.e, b.e), 6) as cosine from v a join v b on a.label is not distinct from b.label and a.memory_id < b.memory_id and list_cosine_similarity(a.e, b.e) >= 0.25e0", "mem")
def semantic_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of like facts within a label, where there are many."""
    return dedup.semantic_pairs(_active(spark, d), 0.25, ("label",)).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("pair_budget", "with " + LABELS + " select coalesce(label::varchar, '') as label, count(*) as facts, (count(*) * (count(*) - 1) // 2)::bigint as pairs, count(*) * (count(*) - 1) // 2 > 1000 as over from v group by label", "mem")
def pair_budget(spark: SparkSession, d: str) -> DataFrame:
    """Pairs a group has, and whether they pass a budget of 1,000."""
    got = dedup.pair_budget(_active(spark, d), 0.25, ("label",), 1000)
    return got.select(F.get_json_object("g", "$.label").alias("label"), "facts", "pairs", "over")


@query("semantic_semi", "with " + PAIRS + " select memory_id from act where doc_id % 2 = 1 and memory_id not in (select a from pr join act x on x.memory_id = b and x.doc_id % 2 = 0 union all select b from pr join act x on x.memory_id = a and x.doc_id % 2 = 0)", "mem")
def semantic_semi(spark: SparkSession, d: str) -> DataFrame:
    """New facts (odd ids) that no current fact (even ids) of their category resembles."""
    m = _active(spark, d).filter("embedding is not null")
    p = dedup.semantic_pairs(m, 0.35).select("a", "b")
    both = p.union(p.select("b", "a"))
    old = m.filter("doc_id % 2 = 0").select(F.col("memory_id").alias("b"))
    return m.filter("doc_id % 2 = 1").select("memory_id").join(both.join(old, "b").select(F.col("a").alias("memory_id")), "memory_id", "left_anti")


@query("dup_clusters", "with recursive " + PAIRS + """, e as (select a, b from pr union select b, a from pr), r as (select a as v, a as c from e union select e.b, r.c from r join e on e.a = r.v), lab as (select v as memory_id, min(c) as cluster from r group by v),
  f as (select memory_id as s_id, count(*) filter (where kind = 'helpful') as h, count(*) filter (where kind = 'retrieved') as n, count(*) filter (where kind = 'dismissed') as x from signal group by 1),
  s as (select l.*, m.created_at, round(2 * confidence + 3 * coalesce(h, 0) + 0.1e0 * coalesce(n, 0) - 2 * coalesce(x, 0) + least(length(content) / 1000e0, 1), 9) as score from lab l join mem m using (memory_id) left join f on s_id = memory_id)
  select memory_id, cluster, first_value(memory_id) over (partition by cluster order by score desc, created_at desc, memory_id) as keeper from s""", "mem", "signal")
def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    m = _active(spark, d)
    return dedup.clusters(dedup.semantic_pairs(m, 0.35), chains.with_keeper_score(m, t.signal(spark, d)))


#: The whole of SURVEY L11: expired, stale, contained and semantic duplicates, one reason a fact.
PLAN = "with recursive " + CONTAINED + ", " + PAIRS + f""", e as (select a, b from pr union select b, a from pr), r as (select a as v, a as c from e union select e.b, r.c from r join e on e.a = r.v), lab as (select v as memory_id, min(c) as cluster from r group by v),
  f as (select memory_id as s_id, count(*) filter (where kind = 'helpful') as h, count(*) filter (where kind = 'retrieved') as n, count(*) filter (where kind = 'dismissed') as x from signal group by 1),
  s as (select memory_id, created_at, round(2 * confidence + 3 * coalesce(h, 0) + 0.1e0 * coalesce(n, 0) - 2 * coalesce(x, 0) + least(length(content) / 1000e0, 1), 9) as score from mem left join f on s_id = memory_id),
  kept as (select memory_id, first_value(memory_id) over (partition by cluster order by score desc, created_at desc, memory_id) as keeper from lab join s using (memory_id)),
  x as (select memory_id, 1 as pri, 'expired' as reason, null as keeper from mem where status = 'active' and expires_at <= {NOW}
  union all select memory_id, 2, 'stale', null from mem where status = 'active' and category in ('context_note', 'event') and created_at <= {NOW - 30 * 86400} and confidence <= 0.6e0 and memory_id not in (select memory_id from signal where kind in ('retrieved', 'helpful', 'dismissed'))
  union all select case when a.score > b.score then long_id else short_id end, 3, 'contained', case when a.score > b.score then short_id else long_id end from con join s a on a.memory_id = short_id join s b on b.memory_id = long_id
  union all select memory_id, 4, 'semantic', keeper from kept where memory_id <> keeper), plan as (select memory_id, reason, keeper from (select *, row_number() over (partition by memory_id order by pri, keeper) as r from x) where r = 1 order by pri, memory_id limit 500)"""


def _plan(spark: SparkSession, d: str, most: int | None = 500) -> DataFrame:
    m, signal = _active(spark, d), t.signal(spark, d)
    used = signal.filter(F.col("kind").isin("retrieved", "helpful", "dismissed")).select("memory_id").distinct()
    scored = chains.with_keeper_score(m, signal)
    alike = dedup.clusters(dedup.semantic_pairs(m, 0.35), scored)
    return dedup.consolidate(m, m.select("memory_id").join(used, "memory_id", "left_anti"), dedup.containment_pairs(m), alike, scored, NOW, most)


@query("consolidate", PLAN + " select * from plan", "mem", "signal")
def consolidate(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


@query("reason_counts", PLAN + " select reason, count(*) as n from plan group by reason", "mem", "signal")
def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


#: The same without the limit of actions.
PLAN_ALL = PLAN.replace(" order by pri, memory_id limit 500", "")


@query("consolidate_all", PLAN_ALL + " select * from plan", "mem", "signal")
def consolidate_all(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, None)


@query("reason_counts_all", PLAN_ALL + " select reason, count(*) as n from plan group by reason", "mem", "signal")
def reason_counts_all(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, None).groupBy("reason").agg(F.count("*").alias("n"))


@query("edge_evidence", "with " + MERGED + " select src, relation, dst, len(evidence) as n, evidence[1] as first_id from mg", "edges")
def edge_evidence(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_evidence(t.edges(spark, d)).select("src", "relation", "dst", F.size("evidence").cast("long").alias("n"), F.col("evidence")[0].alias("first_id"))


@query("node_types", "select node, case when max(string_split(node, ':')[1] in ('customer', 'supplier')) then 'person' else max(string_split(node, ':')[1]) end as type from (select src as node from edges union all select dst from edges) group by node", "edges")
def node_types(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_types(t.edges(spark, d))


@query("nodes_by_type", "select distinct node from (select src as node from edges union all select dst from edges) where node like 'nation:%'", "edges")
def nodes_by_type(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_types(t.edges(spark, d)).filter("type = 'nation'").select("node")


@query("graph_counts", "with " + MERGED + " select relation, count(*) as edges, count(distinct src) as sources, count(distinct dst) as targets from mg group by relation", "edges")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    m = graph.merge_evidence(t.edges(spark, d))
    return m.groupBy("relation").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


HIDDEN = "hid as (select memory_id from mem where status = 'quarantined')"


@query("visible_edges", f"with {HIDDEN}, v as (select * from edges where memory_id not in (select memory_id from hid)) select src, relation, dst, count(distinct memory_id) as n from v group by all", "mem", "edges")
def visible_edges(spark: SparkSession, d: str) -> DataFrame:
    hidden = t.mem(spark, d).filter("status = 'quarantined'")
    return graph.visible_edges(t.edges(spark, d), hidden).select("src", "relation", "dst", F.size("evidence").cast("long").alias("n"))


@query("graph_remove", f"with {HIDDEN} select src, relation, dst, count(distinct memory_id) filter (where memory_id not in (select memory_id from hid)) as n, case when count(*) filter (where memory_id not in (select memory_id from hid)) = 0 then 'quarantined' else 'active' end as status from edges group by src, relation, dst", "mem", "edges")
def graph_remove(spark: SparkSession, d: str) -> DataFrame:
    gone = t.mem(spark, d).filter("status = 'quarantined'")
    return graph.remove_evidence(graph.merge_evidence(t.edges(spark, d)), gone).select("src", "relation", "dst", F.size("evidence").cast("long").alias("n"), "status")


@query("edge_endpoints", "with " + MERGED + " select src, relation, dst, case when src like 'nation:%' then 'nation' else 'person' end as src_type, case when dst like 'region:%' then 'region' when dst like 'nation:%' then 'nation' else 'person' end as dst_type from mg", "edges")
def edge_endpoints(spark: SparkSession, d: str) -> DataFrame:
    e = graph.merge_evidence(t.edges(spark, d))
    n = graph.node_types(t.edges(spark, d))
    out = e.join(n.select(F.col("node").alias("src"), F.col("type").alias("src_type")), "src").join(n.select(F.col("node").alias("dst"), F.col("type").alias("dst_type")), "dst")
    return out.select("src", "relation", "dst", "src_type", "dst_type")


@query("node_edges", "with " + MERGED + " select dst as node, 'in' as way, relation, src as other from mg where dst like 'nation:%' union all select src, 'out', relation, dst from mg where src like 'nation:%'", "edges")
def node_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes = t.read(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_name").alias("node"))
    return graph.edges_of(graph.merge_evidence(t.edges(spark, d)), nodes)


TERMS = "tm as (select n_nationkey as query_id, lower(n_name) as term from nation)"


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return t.read(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.lower("n_name").alias("term"))


@query("edge_search", f"with {MERGED}, {TERMS} select query_id, src, relation, dst from mg join tm on contains(lower(src), term) or contains(lower(dst), term)", "edges")
def edge_search(spark: SparkSession, d: str) -> DataFrame:
    return graph.search_edges(graph.merge_evidence(t.edges(spark, d)), _terms(spark, d)).select("query_id", "src", "relation", "dst")


@query("graph_lexical", f"with {MERGED}, {TERMS}, h as (select query_id, unnest(evidence) as memory_id from mg join tm on contains(lower(src), term) or contains(lower(dst), term)) select query_id, memory_id, 2 * count(*) as score from h group by all", "edges")
def graph_lexical(spark: SparkSession, d: str) -> DataFrame:
    return graph.lexical_scores(graph.merge_evidence(t.edges(spark, d)), _terms(spark, d))


@query("node_lookup", f"with {TERMS}, n as (select distinct node from (select src as node from edges union all select dst from edges)), ex as (select query_id, node from tm join n on node = 'region:' || upper(term))\n select * from ex union all select query_id, node from tm join n on contains(lower(node), term) where query_id not in (select query_id from ex)", "edges")
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A region of that very name, else every node that holds the term."""
    n = graph.node_types(t.edges(spark, d)).select("node")
    q = _terms(spark, d)
    exact = q.join(n, F.col("node") == F.concat(F.lit("region:"), F.upper("term"))).select("query_id", "node")
    names, open_ = n.withColumn("text", F.lower("node")), q.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    rest = ranking.contained_terms(open_, names).join(names, "text").join(open_, "term").select("query_id", "node")
    return exact.unionByName(rest)


@query("graph_traversal", f"""with {MERGED}, ty as (select src, dst, relation, evidence from mg where relation in ('based_in', 'lives_in')), w as (select src as f, dst as t, relation, evidence from ty union all select dst, src, relation, evidence from ty),
  s as (select r_regionkey as query_id, 'region:' || r_name as node from region), h1 as (select distinct query_id, least(f, t) as x, greatest(f, t) as y, relation, evidence, t from s join w on f = node),
  n1 as (select distinct query_id, t as node from h1 except select * from s), h2 as (select distinct query_id, least(f, t) as x, greatest(f, t) as y, relation, evidence from n1 join w on f = node),
  p as (select query_id, unnest(evidence) as memory_id, 2 as wt from (select distinct query_id, x, y, relation, evidence from h1) union all select query_id, unnest(evidence), 1 from h2)
  select query_id, memory_id, sum(wt)::bigint as score from p group by all""", "edges")
def graph_traversal(spark: SparkSession, d: str) -> DataFrame:
    seeds = t.read(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("region:"), "r_name").alias("node"))
    return graph.traverse(graph.merge_evidence(t.edges(spark, d)), seeds, 2, ["based_in", "lives_in"])


@query("neighbourhood", f"""with {MERGED}, w as (select src as f, dst as t from mg where relation <> 'works_with' union select dst, src from mg where relation <> 'works_with'), s as (select 'region:' || r_name as seed from region),
  d1 as (select distinct seed, t as node from s join w on f = seed), d2 as (select distinct seed, t as node from d1 join w on f = node)
  select seed, seed as node, 0 as distance from s union all select seed, node, 1 from d1 where node <> seed union all select seed, node, 2 from d2 where node <> seed and (seed, node) not in (select (seed, node) from d1)""", "edges")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    seeds = t.read(spark, d, "region").select(F.concat(F.lit("region:"), "r_name").alias("node"))
    return graph.neighbourhood(graph.merge_evidence(t.edges(spark, d)), seeds, 2)


_ASKED = "tm as (select n_nationkey as query_id, lower(n_name) as term from nation union all select n_nationkey, lower((select b.n_name from nation b where b.n_nationkey = (a.n_nationkey + 7) % 25)) from nation a where n_nationkey % 6 <> 0)"


@query("graph_traversal_bounded", f"""with {_ASKED}, nd as (select distinct node, lower(split_part(node, ':', 2)) as name from (select src as node from edges union all select dst from edges)),
  fd as (select distinct query_id, node from tm join nd on contains(name, term)), ok as (select query_id from fd group by query_id having count(*) filter (where node not like 'region:%') >= 2),
  s0 as (select query_id, node from fd where query_id in (from ok) qualify row_number() over (partition by query_id order by node) <= 40),
  ty as (select distinct src, relation, dst, memory_id from edges where relation in ('based_in', 'lives_in')), one as (select distinct src, relation, dst from ty), w as (select src as f, dst as t, * from one union all select dst, src, * from one),
  h1 as (select query_id, w.* from s0 join w on f = node), c1 as (select query_id, t as node, count(*) as n from h1 where (query_id, t) not in (select (query_id, node) from s0) group by all),
  f1 as (select query_id, node from c1 join (select query_id, count(*) as held from s0 group by query_id) using (query_id) qualify row_number() over (partition by query_id order by n desc, node) <= least(40, 200 - any_value(held) over (partition by query_id))),
  h2 as (select query_id, w.* from f1 join w on f = node),
  p as (select query_id, memory_id, 2 as wt from (select distinct query_id, src, relation, dst from h1) join ty using (src, relation, dst) union all select query_id, memory_id, 1 from (select distinct query_id, src, relation, dst from h2) join ty using (src, relation, dst))
  select query_id, memory_id, sum(wt)::bigint as score from p group by all""", "edges")
def graph_traversal_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Facts near the nations that a query names, if it names two; hubs lead to forty nodes at most."""
    n = t.read(spark, d, "nation").select((F.col("n_nationkey")).alias("query_id"), F.lower("n_name").alias("term"))
    other = n.filter("query_id % 6 <> 0").select("query_id", ((F.col("query_id") + 7) % 25).alias("other")).join(n.toDF("other", "term"), "other").select("query_id", "term")
    e = t.edges(spark, d)
    start = graph.seeds(n.unionByName(other), graph.node_types(e).withColumn("type", graph.kind(F.col("node"))), ["region"], ["user"])
    return graph.bounded_traverse(e, start, 2, ["based_in", "lives_in"])


@query("graph_junk", """with n as (select distinct node, string_split(node, ':')[-1] as name from (select src as node from edges union all select dst from edges))
  select node, 'round' as reason from n where regexp_matches(name, '#0*[0-9]*00$') and length(name) > 2 and length(name) < 80""", "edges")
def graph_junk(spark: SparkSession, d: str) -> DataFrame:
    return graph.junk_nodes(t.edges(spark, d))


LINEAGE = """lin as (select session_id, session_id as here, coalesce(end_reason = 'compression', false) as c, parent_session_id as p from sessions
    union all select l.session_id, s.session_id, l.c or coalesce(s.end_reason = 'compression', false), s.parent_session_id from lin l join sessions s on s.session_id = l.p),
  root as (select session_id, here as root, c as compressed from lin x where p is null or p not in (select session_id from sessions))"""


@query("session_lineage", "with recursive " + LINEAGE + " select session_id, root, compressed from root", "sessions")
def session_lineage(spark: SparkSession, d: str) -> DataFrame:
    return sessions.lineage(t.sessions(spark, d))


@query("message_window", """with m as (select *, row_number() over (partition by session_id order by turn, message_id) as place, count(*) over (partition by session_id) as n from messages), a as (select * from m where turn = 2)
  select a.message_id as anchor, m.message_id, m.place - a.place as "offset", greatest(a.place - 3, 0) as before, greatest(a.n - a.place - 2, 0) as after from a join m on m.session_id = a.session_id and m.place between a.place - 2 and a.place + 2""", "messages")
def message_window(spark: SparkSession, d: str) -> DataFrame:
    m = t.messages(spark, d)
    return sessions.message_window(m, m.filter("turn = 2").select("message_id"), 2)


@query("bookends", """with m as (select *, row_number() over (partition by session_id order by turn, message_id) as up, row_number() over (partition by session_id order by turn desc, message_id desc) as down from messages)
  select session_id, message_id, case when up <= 2 then 'first' else 'last' end as part from m where up <= 2 or down <= 2""", "messages")
def bookends(spark: SparkSession, d: str) -> DataFrame:
    return sessions.bookends(t.messages(spark, d), 2)


@query("session_read", """with m as (select *, row_number() over (partition by session_id order by turn, message_id) as place, count(*) over (partition by session_id) as n from messages)
  select session_id, message_id, place from m where n <= 4 or place <= 2 or place > n - 1""", "messages")
def session_read(spark: SparkSession, d: str) -> DataFrame:
    return sessions.read_session(t.messages(spark, d), 4, 2, 1)


@query("session_browse", "select session_id, max(\"at\") as last_active, count(*) as n from messages join sessions using (session_id) where parent_session_id is null and source <> 'subagent' group by session_id order by last_active desc, session_id limit 20", "messages", "sessions")
def session_browse(spark: SparkSession, d: str) -> DataFrame:
    return sessions.browse(t.messages(spark, d), t.sessions(spark, d), ["subagent"], 20)


@query("message_shape", "select message_id, role, content[1:200] as content, length(content) as full_length, length(content) > 200 as cut, turn = 0 as is_anchor from messages", "messages")
def message_shape(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("content")
    return t.messages(spark, d).select("message_id", "role", F.substring("content", 1, 200).alias("content"), n.cast("long").alias("full_length"), (n > 200).alias("cut"), (F.col("turn") == 0).alias("is_anchor"))


BM25 = """ask as (select distinct query_id, unnest(list_distinct(list_filter(string_split_regex(lower(query), '[^\\p{L}0-9]+'), lambda w: w <> ''))) as term from q),
  ms as (select message_id, session_id, list_filter(string_split_regex(lower(content), '[^\\p{L}0-9]+'), lambda w: w <> '') as words from messages where role in ('user', 'assistant')),
  st as (select count(*) as docs, avg(len(words)) as mean from ms), ix as (select message_id, len, term, count(*) as tf from (select message_id, len(words) as len, unnest(words) as term from ms) group by all),
  dfs as (select term, count(*) as df from ix group by term),
  sc as (select query_id, message_id, sum(ln(1 + (docs - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / mean))) as score from ix join dfs using (term) join ask using (term), st group by query_id, message_id),
  rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, message_id) as rank from sc qualify rank <= 300)"""


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    m = t.messages(spark, d).filter(F.col("role").isin("user", "assistant"))
    return sessions.bm25(m, t.search_queries(spark, d), 300)


@query("bm25_search", "with " + BM25 + " select query_id, message_id, round(score, 6) as score, rank from rk where rank <= 20", "messages", "q")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).filter("rank <= 20").select("query_id", "message_id", F.round("score", 6).alias("score"), "rank")


@query("session_discover", "with recursive " + LINEAGE + ", " + BM25 + """, h as (select rk.query_id, r.root, s.source in ('cron') as late, rk.rank, rk.message_id from rk join ms using (message_id) join sessions s using (session_id) join root r using (session_id) where s.source <> 'subagent'),
  b as (select *, row_number() over (partition by query_id, root order by late, rank, message_id) as r from h), p as (select *, row_number() over (partition by query_id order by late, rank, message_id) as pos from b where r = 1)
  select query_id, root, message_id, late, pos from p where pos <= 10""", "messages", "sessions", "q")
def session_discover(spark: SparkSession, d: str) -> DataFrame:
    s = t.sessions(spark, d)
    return sessions.discover(_bm25(spark, d), t.messages(spark, d), s, sessions.lineage(s), ["subagent"], ["cron"], 10)


@query("boolean_match", """with m as (select message_id, list_filter(string_split_regex(lower(content), '[^\\p{L}0-9]+'), lambda w: w <> '') as w, lower(content) as low from messages)
  select message_id from m where list_contains(w, 'the') and (list_contains(w, 'and') or list_contains(w, 'of')) and not list_contains(w, 'is') and len(list_filter(w, lambda x: starts_with(x, 'th'))) > 0""", "messages")
def boolean_match(spark: SparkSession, d: str) -> DataFrame:
    """the AND (and OR of) AND NOT is AND th*"""
    w = sessions.terms(F.col("content"))
    m = t.messages(spark, d).select("message_id", w.alias("w"))
    has = lambda x: F.array_contains("w", x)
    return m.filter(has("the") & (has("and") | has("of")) & ~has("is") & F.exists("w", lambda x: x.startswith("th"))).select("message_id")


#: Query shapes, each with what it asks for, said in SQL over the words ``w`` of a message (None: malformed).
_HAS, _PRE, _SEQ = "list_contains(w, '{}')".format, "len(list_filter(w, lambda x: starts_with(x, '{}'))) > 0".format, "contains(' ' || array_to_string(w, ' ') || ' ', ' {}')".format
SHAPES: tuple[tuple[str | None, str | None], ...] = (
    ("the and", f"{_HAS('the')} and {_HAS('and')}"), ("the AND of", f"{_HAS('the')} and {_HAS('of')}"), ("the OR la", f"{_HAS('the')} or {_HAS('la')}"), ("the NOT is", f"{_HAS('the')} and not {_HAS('is')}"),
    ('"of the"', _SEQ("of the ")), ("thr*", _PRE("thr")), ("the (of OR la)", f"{_HAS('the')} and ({_HAS('of')} or {_HAS('la')})"), ('"of the" OR "de la"', f"{_SEQ('of the ')} or {_SEQ('de la ')}"),
    ("the NOT (is OR it)", f"{_HAS('the')} and not ({_HAS('is')} or {_HAS('it')})"), ("of to NOT is that", f"{_HAS('of')} and {_HAS('to')} and not ({_HAS('is')} and {_HAS('that')})"),
    ("the AND of OR der AND und", f"({_HAS('the')} and {_HAS('of')}) or ({_HAS('der')} and {_HAS('und')})"), ("the OR of AND NOT", None), ("NOT the", None), ('"of the', None), ("(the of", None), ("the of)", None), ("", None), (None, None),
    ("of-the", _SEQ("of the ")), ('"of th"*', _SEQ("of th")), ("((the))", _HAS("the")), ("THE Of", f"{_HAS('the')} and {_HAS('of')}"), ("or not and", f"{_HAS('or')} and {_HAS('not')} and {_HAS('and')}"),
    ("the NOT of NOT is", f"{_HAS('the')} and not {_HAS('of')} and not {_HAS('is')}"), ('"the"', _HAS("the")), ("zzzzqq", "false"), ('de AND (la OR le) NOT "de la"', f"{_HAS('de')} and ({_HAS('la')} or {_HAS('le')}) and not {_SEQ('de la ')}"),
    ("*", None), ("the!", _HAS("the")), ("the OR (of AND)", None), ('"in the" (a OR an*) NOT "of a"', f"{_SEQ('in the ')} and ({_HAS('a')} or {_PRE('an')}) and not {_SEQ('of a ')}"),
)
_WORDS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}0-9]+'), lambda w: w <> '')"
_SHAPE_ROWS = "\n    union all ".join(f"select {i} as query_id, message_id from w where {c}" for i, (_, c) in enumerate(SHAPES) if c)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Every shape, and a phrase, a word and an exclusion from each benchmark item."""
    fixed = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(SHAPES)], "query_id long, query string")
    w = sessions.terms(F.col("text"))
    own = t.read(spark, d, "benchmark").select((F.col("item_id") + 1000).alias("query_id"), w.alias("w")).filter(F.size("w") >= 6)
    at = lambda i: F.element_at("w", i)
    return fixed.unionByName(own.select("query_id", F.concat(F.lit('"'), at(3), F.lit(" "), at(4), F.lit('" OR '), at(5), F.lit(" NOT "), at(6)).alias("query")))


@query("query_search", f"""with w as (select message_id, {_WORDS.format('content')} as w from messages), own as (select item_id + 1000 as query_id, {_WORDS.format('text')} as q from benchmark)
    {_SHAPE_ROWS}
    union all select query_id, message_id from own join w on len(q) >= 6 and (contains(' ' || array_to_string(w, ' ') || ' ', ' ' || q[3] || ' ' || q[4] || ' ') or (list_contains(w, q[5]) and not list_contains(w, q[6])))""", "messages")
def query_search(spark: SparkSession, d: str) -> DataFrame:
    """Queries written in the search language against all messages, phrases by their places."""
    return querying.search(_asked(spark, d), querying.positional_index(t.messages(spark, d)))


@query("query_check", "select * from (values " + ", ".join(f"({i}, {str(c is not None).lower()})" for i, (_, c) in enumerate(SHAPES)) + ") v(query_id, ok) union all select item_id + 1000, true from benchmark where len(" + _WORDS.format("text") + ") >= 6")
def query_check(spark: SparkSession, d: str) -> DataFrame:
    return querying.compiled(_asked(spark, d)).select("query_id", "ok")


@query("discover_context", "with recursive " + LINEAGE + ", " + BM25 + """, h as (select rk.query_id, r.root, s.source in ('cron') as late, rk.rank, rk.message_id from rk join ms using (message_id) join sessions s using (session_id) join root r using (session_id) where s.source <> 'subagent'),
  b as (select *, row_number() over (partition by query_id, root order by late, rank, message_id) as r from h), p as (select *, row_number() over (partition by query_id order by late, rank, message_id) as pos from b where r = 1 qualify pos <= 10),
  m as (select *, row_number() over (partition by session_id order by turn, message_id) as place, count(*) over (partition by session_id) as n from messages),
  x as (select p.query_id, p.root, p.message_id, p.pos, a.place as hit, m.place, m.n, m.message_id as other, abs(m.place - a.place) <= 2 as near from p join m a using (message_id) join m on m.session_id = a.session_id)
  select query_id, root, message_id, pos, coalesce(list(other order by place) filter (where near), []) as around, coalesce(list(other order by place) filter (where not near and place <= 2), []) as opening, coalesce(list(other order by place) filter (where not near and place > 2 and place > n - 2), []) as closing,
    max(greatest(hit - 3, 0)) as before, max(greatest(n - hit - 2, 0)) as after from x group by all""", "messages", "sessions", "q")
def discover_context(spark: SparkSession, d: str) -> DataFrame:
    """Discovery hits with the messages around them and both ends of their session."""
    return sessions.with_surroundings(session_discover(spark, d).select("query_id", "root", "message_id", "pos"), t.messages(spark, d), 2, 2)


@query("anchor_rebind", "with recursive " + LINEAGE + """, a as (select session_id - session_id % 3 as session_id, message_id + case when session_id % 11 = 0 then 900 else 0 end as message_id from messages where turn = 1)
  select a.session_id, a.message_id, m.session_id as owner, case when m.session_id is null or r.root is null then 'missing' when m.session_id = a.session_id then 'own' when r.root = o.root then 'rebound' else 'foreign' end as state
  from a left join messages m using (message_id) left join root r on r.session_id = a.session_id left join root o on o.session_id = m.session_id""", "messages", "sessions")
def anchor_rebind(spark: SparkSession, d: str) -> DataFrame:
    """Anchors asked for in a session that may be another one of the lineage, a foreign one, or none."""
    m, i = t.messages(spark, d), F.col("session_id")
    a = m.filter("turn = 1").select((i - i % 3).alias("session_id"), (F.col("message_id") + F.when(i % 11 == 0, 900).otherwise(0)).alias("message_id"))
    return sessions.rebind(a, m, sessions.lineage(t.sessions(spark, d)))


@query("context_enrich", """with u as (select *, row_number() over (partition by session_id order by turn, message_id) as r from messages where role = 'user'),
  c as (select a.message_id, b.r, sum(length(b.content)) over (partition by a.message_id order by b.r desc) as used from u a join u b on a.session_id = b.session_id and b.r < a.r and b.r >= a.r - 3)
  select u.message_id, count(c.used) filter (where used <= 400) as n_context, coalesce(max(used) filter (where used <= 400), 0)::bigint as n_chars from u left join c using (message_id) group by u.message_id""", "messages")
def context_enrich(spark: SparkSession, d: str) -> DataFrame:
    return sessions.context_window(t.messages(spark, d), 3, 400)
