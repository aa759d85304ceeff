"""Retrieval over the fact table for the benchmark's query table, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import vectors
from memspark.operators import evaluate, ranking, vector_index, visibility
from memspark.sources import tables as t
from memspark.sources.tables import NOW

from .base import query
from .facts import USER, VISIBLE

# The legs as SQL, for queries that build on them.
LEGS = f"""with vis as (select * from mem where {VISIBLE}),
 words as (select query_id, list_filter(string_split_regex(lower(query), '\\s+'), lambda w: length(w) > 2)[1:4] as words from q),
 kw as (select query_id, memory_id, len(list_filter(words, lambda w: contains(lower(content), w))) / len(words)::double as score from words, vis where len(words) > 0),
 kr as (select *, row_number() over (partition by query_id order by round(score, 12) desc, memory_id) as rank from kw where score > 0 qualify rank <= 200),
 vs as (select query_id, memory_id, list_cosine_similarity(query_vec::double[], embedding::double[]) as score from q, vis where query_vec is not null and embedding is not null),
 vr as (select *, row_number() over (partition by query_id order by round(score, 12) desc, memory_id) as rank from vs qualify rank <= 40),
 legs as (select query_id, memory_id, score, rank, 1 as leg from kr union all select query_id, memory_id, score, rank, 2 from vr),
 two as (select query_id, min(leg) <> max(leg) as two from legs group by query_id),
 fused as (select query_id, memory_id, case when two then rrf else own end as score, case when two then 'rrf' else 'single' end as score_kind
   from (select query_id, memory_id, sum(1e0 / (20 + rank)) / (2e0 / 21) as rrf, max(score) as own from legs group by query_id, memory_id) join two using (query_id))"""
COUNTERS = """cnt as (select memory_id, count(*) filter (where kind = 'helpful') as helpful, count(*) filter (where kind = 'dismissed') as dismissed, count(*) filter (where kind = 'retrieved') as retrieved,
   max("at") as last_at, max("at") filter (where kind = 'retrieved') as last_retrieved from signal group by memory_id)"""
ADJUST = f"""adj as (select memory_id, content, category, created_at, label,
   greatest(-0.03e0, least(0.03e0, 0.1e0 * exp(-age / 90e0) - 0.0005e0 * least(age, 730) - case when last_retrieved is not null then 0.001e0 * least(greatest(floor(({NOW} - last_retrieved) / 86400e0), 0), 365) else 0 end))
   + greatest(-0.08e0, least(0.08e0, 0.05e0 * coalesce(helpful, 0) - case when dismissed > 0 then 0.1e0 * dismissed * greatest(0, 1 - greatest(floor(({NOW} - last_at) / 86400e0), 0) / 180e0) else 0 end
     + 0.08e0 * (confidence - 0.5e0) + 0.02e0 * least(coalesce(retrieved, 0), 20))) as adj
   from (select *, greatest(floor(({NOW} - created_at) / 86400e0), 0) as age from vis) left join cnt using (memory_id))"""
HYBRID = f"""{LEGS}, {COUNTERS}, {ADJUST},
 hits as (select query_id, memory_id, score as raw, greatest(0, score + adj) as score, score_kind, content, category, created_at, label from fused join adj using (memory_id)),
 top as (select *, row_number() over (partition by query_id order by round(score, 12) desc, memory_id) as rank from hits qualify rank <= 10)"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return visibility.visible(t.mem(spark, d), USER, NOW)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return ranking.hybrid(t.search_queries(spark, d), _facts(spark, d), t.signal(spark, d), NOW)


def _told(spark: SparkSession, d: str) -> DataFrame:
    """Hits with the columns of their facts."""
    return _hits(spark, d).join(_facts(spark, d).select("memory_id", "content", "category", "created_at", "label"), "memory_id")


@query("keyword_search", LEGS + " select query_id, memory_id, round(score, 6) as score, rank from kr", "mem", "q")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    k = ranking.ranked(ranking.keyword_scores(t.search_queries(spark, d), _facts(spark, d)), 200)
    return k.select("query_id", "memory_id", F.round("score", 6).alias("score"), "rank")


@query("vector_topk", LEGS + " select query_id, memory_id, round(score, 6) as score, rank from vr", "mem", "q")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.top_k(t.search_queries(spark, d), _facts(spark, d), 40).select("query_id", "memory_id", F.round("score", 6).alias("score"), "rank")


@query("rrf_fuse", LEGS + " select query_id, memory_id, round(score, 6) as score, score_kind from fused", "mem", "q")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    q, f = t.search_queries(spark, d), _facts(spark, d)
    out = ranking.fuse(ranking.ranked(ranking.keyword_scores(q, f), 200), vectors.top_k(q, f, 40))
    return out.select("query_id", "memory_id", F.round("score", 6).alias("score"), "score_kind")


@query("hybrid_search", HYBRID + " select query_id, memory_id, round(score, 6) as score, round(raw, 6) as raw, score_kind, rank from top", "mem", "q", "signal")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("query_id", "memory_id", F.round("score", 6).alias("score"), F.round("raw", 6).alias("raw"), "score_kind", "rank")


@query("importance_rerank", f"with vis as (select * from mem where {VISIBLE}), {COUNTERS}, {ADJUST} select memory_id, round(adj, 6) as adj from adj", "mem", "signal")
def importance_rerank(spark: SparkSession, d: str) -> DataFrame:
    f = ranking.with_counters(_facts(spark, d), t.signal(spark, d))
    return f.select("memory_id", F.round(ranking.importance(NOW), 6).alias("adj"))


@query("rerank_blend", HYBRID + """, x as (select *, length(content)::double as other from top), m as (select *, min(other) filter (where rank <= 5) over w as lo, max(other) filter (where rank <= 5) over w as hi from x window w as (partition by query_id))
  select query_id, memory_id, round(case when rank <= 5 then 0.8e0 * score + 0.2e0 * case when hi > lo then (other - lo) / (hi - lo) else 0.5e0 end else score end, 6) as blended from m""", "mem", "q", "signal")
def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    """Another model's scores come as a column; here the length of the text stands for them."""
    rows = ranking.blend(_told(spark, d).withColumn("other", F.length("content").cast("double")), "other", 5)
    return rows.select("query_id", "memory_id", F.round("blended", 6).alias("blended"))


STOP = ["the", "a", "an", "of", "to", "and", "is", "in"]


@query("phrase_lift", HYBRID + f""", w as (select query_id, list_filter(regexp_extract_all(lower(query), '[\\p{{L}}0-9]+'), lambda w: not list_contains({STOP}, w)) as w from q),
  p as (select query_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as p from w)
  select query_id, memory_id, round(case when len(p) > 0 then len(list_filter(p, lambda x: contains(lower(content), x))) / len(p)::double else 0 end, 6) as share from top join p using (query_id)""", "mem", "q", "signal")
def phrase_lift(spark: SparkSession, d: str) -> DataFrame:
    asked = t.search_queries(spark, d).select("query_id", ranking.phrases(F.col("query"), STOP).alias("phrases"))
    rows = _told(spark, d).withColumn("low", F.lower("content")).join(asked, "query_id")
    return rows.select("query_id", "memory_id", F.round(ranking.phrase_share("phrases", "low"), 6).alias("share"))


@query("newer_wins", HYBRID + """, s as (select *, list_distinct(list_filter(string_split_regex(lower(content), '[^a-z0-9'']+'), lambda w: w <> '')) as ws from top),
  l as (select b.query_id, b.memory_id, max(a.score) + 0.005e0 as fl from s a join s b on a.query_id = b.query_id and abs(a.rank - b.rank) <= 3 and a.created_at < b.created_at
    where len(list_intersect(a.ws, b.ws)) >= 0.6e0 * len(list_distinct(list_concat(a.ws, b.ws))) and len(list_concat(a.ws, b.ws)) > 0 group by all)
  select query_id, memory_id, round(greatest(score, coalesce(fl, score)), 6) as score from top left join l using (query_id, memory_id)""", "mem", "q", "signal")
def newer_wins(spark: SparkSession, d: str) -> DataFrame:
    return ranking.newer_wins(_told(spark, d)).select("query_id", "memory_id", F.round("score", 6).alias("score"))


@query("date_rerank", HYBRID + f""" select query_id, memory_id, row_number() over (partition by query_id order by abs(created_at // 86400 - ({NOW} // 86400 - query_id % 50)), rank) as date_rank from top""", "mem", "q", "signal")
def date_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Hits by distance in days from the query's date, the earlier rank first among equals."""
    target = F.lit(NOW // 86400) - F.col("query_id") % 50
    return evaluate.date_rank(_told(spark, d), target).select("query_id", "memory_id", "date_rank")


@query("chrono_order", HYBRID + " select query_id, memory_id, row_number() over (partition by query_id order by created_at, memory_id) as pos from top", "mem", "q", "signal")
def chrono_order(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.chronological(_told(spark, d)).select("query_id", "memory_id", "pos")


@query("subquery_merge", HYBRID + """, s as (select query_id // 4 as parent, memory_id, sum(1e0 / (20 + rank)) as s from top group by all) select parent, memory_id, round(s / max(s) over (partition by parent), 6) as score from s""", "mem", "q", "signal")
def subquery_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = _hits(spark, d).withColumn("parent", F.floor(F.col("query_id") / 4))
    return ranking.merge_subqueries(rows).select("parent", "memory_id", F.round("score", 6).alias("score"))


@query("weak_queries", HYBRID + ", b as (select query_id, max(raw) as best from top group by query_id) select query_id, round(coalesce(best, 0), 6) as best, coalesce(best, 0) < 0.3e0 and length(query) >= 10 as expand from q left join b using (query_id)", "mem", "q", "signal")
def weak_queries(spark: SparkSession, d: str) -> DataFrame:
    """Each query's best raw score; those below .3 are the ones to expand, if they are long enough."""
    best = _hits(spark, d).groupBy("query_id").agg(F.max("raw").alias("best"))
    q = t.search_queries(spark, d).join(best, "query_id", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return q.select("query_id", F.round("best", 6).alias("best"), ((F.col("best") < 0.3) & (F.length("query") >= 10)).alias("expand"))


@query("render_context", HYBRID + """, f as (select *, regexp_replace(content, '\\s+', ' ', 'g') as flat from top)
  select query_id, string_agg('[' || strftime(to_timestamp(created_at) at time zone 'UTC', '%Y-%m-%d') || '] [' || category || '] ' || case when length(flat) <= 800 then flat else regexp_replace(flat[1:800], ' [^ ]*$', '') || '...' end
    || ' (' || printf('%.3f', floor(score * 1000 + 1e-6) / 1000) || ') [' || memory_id || ']', chr(10) order by rank) as context from f group by query_id""", "mem", "q", "signal")
def render_context(spark: SparkSession, d: str) -> DataFrame:
    return ranking.render(_told(spark, d))


@query("vector_topk_lsh")
def vector_topk_lsh(spark: SparkSession, d: str) -> DataFrame:
    """Approximate top 10 by random-projection buckets, exact scores within them, with recall against the exact list."""
    return evaluate.lsh_recall(t.search_queries(spark, d), t.mem(spark, d), 10)


@query("vector_topk_index")
def vector_topk_index(spark: SparkSession, d: str) -> DataFrame:
    """Approximate top 10 from a stored index (cells, product codes, exact re-rank of 5 % at most), with recall and the shares looked at."""
    q, m = t.search_queries(spark, d), t.mem(spark, d)
    return vector_index.recall(q, m, 10, evaluate.retrieve("exact", q, m, 10))


QRELS = "rel as (select q.query_id, m.memory_id from q join mem m on m.label = q.query_label)"


@query("ir_metrics", HYBRID + f""", {QRELS}, n as (select query_id, count(*) as n from rel group by query_id),
  h as (select top.query_id, top.rank, rel.memory_id is not null as hit from top left join rel on rel.query_id = top.query_id and rel.memory_id = top.memory_id),
  m as (select query_id, count(*) filter (where hit and rank <= 5) / 5e0 as p5, count(*) filter (where hit) / 10e0 as p10, sum(case when hit then 1 / log2(rank + 1e0) else 0 end) as dcg, coalesce(1e0 / min(rank) filter (where hit), 0) as rr, count(*) filter (where hit) as hits from h group by query_id)
  select query_id, round(coalesce(p5, 0), 6) as p5, round(coalesce(p10, 0), 6) as p10, round(coalesce(hits, 0) / n::double, 6) as r10, round(coalesce(dcg, 0) / (select sum(1 / log2(i + 1e0)) from range(1, 11) r(i) where i <= n), 6) as ndcg10, round(coalesce(rr, 0), 6) as rr
  from n left join m using (query_id)""", "mem", "q", "signal")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    rel = t.search_queries(spark, d).select("query_id", "query_label").join(t.mem(spark, d).filter("label is not null").select("memory_id", "label"), F.col("query_label") == F.col("label")).select("query_id", "memory_id")
    return evaluate.ir_metrics(_hits(spark, d), rel, 10)


@query("why_not", HYBRID + f""", {t.EXPECTED},
  x as (select w.query_id, w.memory_id, m.memory_id is not null as known, m.status, m.valid_to, m.expires_at, m.user_scope, t.rank, t.raw from w left join mem m using (memory_id) left join top t on t.query_id = w.query_id and t.memory_id = w.memory_id)
  select query_id, memory_id, rank is not null as found, rank, list_filter([case when not known then 'not found' end, case when status = 'quarantined' then 'quarantined' end, case when valid_to is not null then 'superseded' end,
    case when expires_at <= {NOW} then 'expired' end, case when user_scope <> '{USER}' then 'scope' end, case when raw < 0.3e0 then 'low similarity' end, case when known and rank is null then 'ranked below k' end], lambda r: r is not null) as reasons from x""", "mem", "q", "signal")
def why_not(spark: SparkSession, d: str) -> DataFrame:
    """Why an expected fact is not among a query's hits."""
    expected = t.expected_facts(spark, d)
    return evaluate.why_not(expected, t.mem(spark, d), _hits(spark, d), NOW, USER)


@query("probe_hits", HYBRID + f""", {t.EXPECTED}, e as (select w.query_id, m.memory_id, m.chain_id from w join mem m using (memory_id)),
  h as (select e.query_id, min(t.rank) as rank from e join top t using (query_id) join mem m on m.memory_id = t.memory_id where m.memory_id = e.memory_id or m.chain_id = e.chain_id group by e.query_id)
  select e.query_id, k, coalesce(rank <= k, false) as hit from e left join h using (query_id), (select unnest([1, 3, 5, 10]) as k)""", "mem", "q", "signal")
def probe_hits(spark: SparkSession, d: str) -> DataFrame:
    """Whether an expected fact, or another version of it, is within each cut of the ladder."""
    expected = t.expected_facts(spark, d)
    return evaluate.probe_hits(expected, t.mem(spark, d), _hits(spark, d), [1, 3, 5, 10])


@query("cosine", "select query_id, memory_id, round(list_cosine_similarity(query_vec::double[], embedding::double[]), 6) as cosine from q join mem on label = query_label where embedding is not null and query_vec is not null", "mem", "q")
def cosine(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each query with the facts of its own label."""
    m = t.mem(spark, d).filter("embedding is not null")
    j = t.search_queries(spark, d).filter("query_vec is not null").join(m, F.col("query_label") == F.col("label"))
    return j.select("query_id", "memory_id", F.round(vectors.cosine("query_vec", "embedding"), 6).alias("cosine"))


@query("embedding_check", """select label, round(avg(list_cosine_similarity(embedding::double[], c::double[])), 6) as mean_cosine, count(*) as n
  from embeddings join (select label, [avg(embedding[i]::double) for i in range(1, 65)] as c from embeddings group by label) using (label) group by label""".replace("[avg(embedding[i]::double) for i in range(1, 65)]", "list(x order by i)").replace("from embeddings group by label)", "from (select label, i, avg(v::double) as x from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings) group by label, i) group by label)"))
def embedding_check(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine of stored vectors with their label's centroid: a changed encoder shows as a drop."""
    return evaluate.embedding_check(t.read(spark, d, "embeddings"))


@query("supersede_options")
def supersede_options(spark: SparkSession, d: str) -> DataFrame:
    """The three current facts nearest to each pending candidate with a vector."""
    c = t.candidates(spark, d).filter("status = 'pending'").select("doc_id", "candidate_id")
    e = t.read(spark, d, "embeddings")
    q = c.join(e, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return vectors.top_k(q, t.mem(spark, d).filter("valid_to is null and status = 'active'"), 3)
