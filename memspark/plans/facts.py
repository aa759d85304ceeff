"""Scans, filters, joins, aggregates and windows over the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators import chains, iterate, visibility
from memspark.sources import tables as t
from memspark.sources.tables import NOW

from .base import query

USER = "u1"
VISIBLE = f"status = 'active' and valid_to is null and (user_scope is null or user_scope = '{USER}') and (expires_at is null or expires_at > {NOW})"
AT = NOW - 45 * 86400


@query("visible_scan", f"select memory_id, category, content, confidence from mem where {VISIBLE} and (project_id is null or project_id = 'src3')", "mem")
def visible_scan(spark: SparkSession, d: str) -> DataFrame:
    return visibility.visible(t.mem(spark, d), USER, NOW, project="src3").select("memory_id", "category", "content", "confidence")


@query("as_of_scan", f"""select memory_id, category, valid_from, valid_to from mem
  where status = 'active' and (user_scope is null or user_scope = '{USER}') and valid_from <= {AT} and (valid_to is null or valid_to > {AT}) and (expires_at is null or expires_at > {AT})""", "mem")
def as_of_scan(spark: SparkSession, d: str) -> DataFrame:
    return visibility.as_of(t.mem(spark, d), USER, AT).select("memory_id", "category", "valid_from", "valid_to")


@query("fetch_by_ids", f"""select ids.pos, m.memory_id, m.status, m.category from mem m join (select distinct 'mem-' || vec_id as memory_id, 1000000 - vec_id as pos from embeddings) ids using (memory_id)
  where status = 'active' and (expires_at is null or expires_at > {NOW})""", "mem")
def fetch_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = t.read(spark, d, "embeddings").select(F.concat(F.lit("mem-"), "vec_id").alias("memory_id"), (1000000 - F.col("vec_id")).alias("pos"))
    return visibility.fetch(t.mem(spark, d), ids, NOW).select("pos", "memory_id", "status", "category")


@query("list_recent", f"select memory_id, category, created_at from mem where {VISIBLE} order by created_at desc, memory_id limit 50", "mem")
def list_recent(spark: SparkSession, d: str) -> DataFrame:
    return visibility.visible(t.mem(spark, d), USER, NOW).orderBy(F.desc("created_at"), "memory_id").limit(50).select("memory_id", "category", "created_at")


@query("candidate_list", "select candidate_id, status, created_at from candidates where status = 'pending' order by created_at desc, candidate_id limit 500", "candidates")
def candidate_list(spark: SparkSession, d: str) -> DataFrame:
    return t.candidates(spark, d).filter("status = 'pending'").orderBy(F.desc("created_at"), "candidate_id").limit(500).select("candidate_id", "status", "created_at")


@query("schema_backfill", """select memory_id, coalesce(nullif(src, ''), 'import') as source, case when status is null or status not in ('active', 'quarantined') then 'active' else status end as status,
    case when category in ('context_note', 'event') then 'temporary' else 'durable' end as durability, case when src = 'src1' then 0.45e0 else confidence end as confidence, valid_from
  from (select memory_id, tags[2] as src, status, category, confidence, created_at as valid_from from mem)""", "mem")
def schema_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Old snapshots lack columns; they are added by name, then filled by rule (rows of src1 count as model-made)."""
    old = t.mem(spark, d).select("memory_id", F.col("tags")[1].alias("src"), "status", "category", "confidence", "created_at")
    return chains.backfill(old).select("memory_id", "source", "status", "durability", "confidence", "valid_from")


@query("legacy_import", """select 'cand-' || sha256('legacy|' || memory_id)[1:16] as candidate_id, 'pending' as status, category, trim(content) as content, 'mem-' || doc_id as legacy_id
  from mem where status = 'active' and length(trim(content)) > 0""", "mem")
def legacy_import(spark: SparkSession, d: str) -> DataFrame:
    m = t.mem(spark, d).filter("status = 'active' and length(trim(content)) > 0")
    key = F.substring(F.sha2(F.concat(F.lit("legacy|"), "memory_id"), 256), 1, 16)
    return m.select(F.concat(F.lit("cand-"), key).alias("candidate_id"), F.lit("pending").alias("status"), "category", F.trim("content").alias("content"), F.col("memory_id").alias("legacy_id"))


@query("export_json")
def export_json(spark: SparkSession, d: str) -> DataFrame:
    """Full rows as JSON text, newest first."""
    m = t.mem(spark, d).drop("embedding")
    return m.orderBy(F.desc("created_at"), "memory_id").limit(1000).select("memory_id", F.to_json(F.struct(*m.columns)).alias("json"))


@query("assign_ttl", f"""select memory_id, case when doc_id % 10 = 0 then null when doc_id % 10 = 1 then {NOW} when category in ('context_note', 'event')
      then created_at + case category when 'context_note' then 30 when 'event' then 180 when 'goal' then 180 else 90 end * 86400 end as new_expiry from mem""", "mem")
def assign_ttl(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id") % 10
    rows = t.mem(spark, d).withColumns({"explicit": i < 2, "given": F.when(i == 1, F.lit(NOW).cast("long")), "durability": F.when(F.col("category").isin("context_note", "event"), "temporary").otherwise("durable")})
    return visibility.assign_expiry(rows, t.TTL_DAYS).select("memory_id", "new_expiry")


@query("insights_by_tag", f"""select memory_id, created_at from mem where category = 'insight' and {VISIBLE} and list_has_any(tags, ['fr', 'src2', 'src7']) and created_at >= {t.START + 86400}
  order by created_at desc, memory_id limit 100""", "mem")
def insights_by_tag(spark: SparkSession, d: str) -> DataFrame:
    m = visibility.visible(t.mem(spark, d), USER, NOW, category="insight").filter(F.arrays_overlap("tags", F.array(F.lit("fr"), F.lit("src2"), F.lit("src7"))))
    return m.filter(F.col("created_at") >= t.START + 86400).orderBy(F.desc("created_at"), "memory_id").limit(100).select("memory_id", "created_at")


@query("evidence_join", "select m.memory_id, e.session_id, e.role, length(e.evidence) as n_chars from mem m left join evidence e using (memory_id) where m.user_scope is null or m.user_scope = 'u1'", "mem", "evidence")
def evidence_join(spark: SparkSession, d: str) -> DataFrame:
    m = t.mem(spark, d).filter(visibility.in_scope(USER)).select("memory_id")
    return m.join(t.evidence(spark, d), "memory_id", "left").select("memory_id", "session_id", "role", F.length("evidence").cast("long").alias("n_chars"))


@query("evidence_backfill", """select m.memory_id, c.candidate_id, sha256(c.content) as retention_hash
  from candidates c join mem m on m.content = c.content and m.doc_id = c.doc_id
  where c.status = 'approved' and m.status = 'active' and length(c.content) > 0 and m.memory_id not in (select memory_id from evidence)""", "mem", "candidates", "evidence")
def evidence_backfill(spark: SparkSession, d: str) -> DataFrame:
    c = t.candidates(spark, d).filter("status = 'approved' and length(content) > 0").select("candidate_id", "content", F.col("doc_id").alias("c_doc"))
    m = t.mem(spark, d).filter("status = 'active'").select("memory_id", "doc_id", F.col("content").alias("m_content"))
    out = c.join(m, (F.col("c_doc") == F.col("doc_id")) & (F.col("content") == F.col("m_content"))).join(t.evidence(spark, d).select("memory_id"), "memory_id", "left_anti")
    return out.select("memory_id", "candidate_id", F.sha2(F.col("content"), 256).alias("retention_hash"))


@query("evidence_carry", """select m.superseded_by as memory_id, e.session_id, e.role from evidence e join mem m using (memory_id) where m.superseded_by is not null
  and m.superseded_by not in (select memory_id from evidence)""", "mem", "evidence")
def evidence_carry(spark: SparkSession, d: str) -> DataFrame:
    """Provenance follows a fact to its new version, where that has none of its own."""
    e = t.evidence(spark, d)
    m = t.mem(spark, d).filter("superseded_by is not null").select("memory_id", "superseded_by")
    out = e.join(m, "memory_id").select(F.col("superseded_by").alias("memory_id"), "session_id", "role")
    return out.join(e.select("memory_id"), "memory_id", "left_anti")


@query("as_of_join", "select s.event_id, m.memory_id from signal s join mem k on k.memory_id = s.memory_id join mem m on m.chain_id = k.chain_id and m.valid_from <= s.\"at\" and (m.valid_to is null or m.valid_to > s.\"at\")", "mem", "signal")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """For each event the version of its chain that was valid then."""
    m = t.mem(spark, d)
    keyed = t.signal(spark, d).join(m.select("memory_id", "chain_id"), "memory_id").select("event_id", "at", "chain_id")
    return chains.as_of_join(keyed, m.select("memory_id", "chain_id", "valid_from", "valid_to")).select("event_id", "memory_id")


@query("count_current", "select count(*) as n from mem where valid_to is null and (user_scope is null or user_scope = 'u1')", "mem")
def count_current(spark: SparkSession, d: str) -> DataFrame:
    return t.mem(spark, d).filter(F.col("valid_to").isNull() & visibility.in_scope(USER)).agg(F.count("*").alias("n"))


@query("category_counts", f"select category, count(*) as n from mem where {VISIBLE} group by category", "mem")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return visibility.visible(t.mem(spark, d), USER, NOW).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


@query("repeated_content", "select content, count(*) as n from mem group by content having count(*) > 1 order by n desc, content limit 10", "mem")
def repeated_content(spark: SparkSession, d: str) -> DataFrame:
    return t.mem(spark, d).groupBy("content").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "content").limit(10)


@query("novelty_count", f"select count(*) filter (where created_at > {AT}) as n_new, count(*) as n_all, count(*) filter (where created_at > {AT}) >= 20 as enough from mem where {VISIBLE}", "mem")
def novelty_count(spark: SparkSession, d: str) -> DataFrame:
    new = F.count_if(F.col("created_at") > AT)
    return visibility.visible(t.mem(spark, d), USER, NOW).agg(new.alias("n_new"), F.count("*").alias("n_all"), (new >= 20).alias("enough"))


@query("expiry_report", f"select category, count(*) filter (where expires_at <= {NOW}) as expired, count(*) filter (where expires_at > {NOW} and expires_at <= {NOW + 7 * 86400}) as soon from mem where valid_to is null group by category", "mem")
def expiry_report(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("expires_at")
    return t.mem(spark, d).filter("valid_to is null").groupBy("category").agg(F.count_if(e <= NOW).alias("expired"), F.count_if((e > NOW) & (e <= NOW + 7 * 86400)).alias("soon"))


@query("unanimous_project", "select chain_id, case when count(distinct project_id) = 1 then max(project_id) end as project_id from mem group by chain_id", "mem")
def unanimous_project(spark: SparkSession, d: str) -> DataFrame:
    # smallest equals largest says the same as one distinct value, without a second shuffle
    one = F.min("project_id") == F.max("project_id")
    return t.mem(spark, d).groupBy("chain_id").agg(F.when(one, F.max("project_id")).alias("project_id"))


@query("feedback_fold", """select memory_id, count(*) filter (where kind = 'helpful') as helpful, count(*) filter (where kind = 'dismissed') as dismissed,
    count(*) filter (where kind = 'approved') as approved, max("at") as last_at from signal group by memory_id""", "signal")
def feedback_fold(spark: SparkSession, d: str) -> DataFrame:
    return chains.fold_feedback(t.signal(spark, d))


@query("retrieval_fold", """select m.memory_id, coalesce(r.n, 0) as retrieved, r.last_at as last_retrieved from mem m left join (select memory_id, count(*) as n, max("at") as last_at from signal where kind = 'retrieved' group by memory_id) r using (memory_id)
  where m.status = 'active' and m.valid_to is null""", "mem", "signal")
def retrieval_fold(spark: SparkSession, d: str) -> DataFrame:
    seen = t.signal(spark, d).filter("kind = 'retrieved'").groupBy("memory_id").agg(F.count("*").alias("n"), F.max("at").alias("last_retrieved"))
    m = t.mem(spark, d).filter("status = 'active' and valid_to is null").select("memory_id")
    return m.join(seen, "memory_id", "left").select("memory_id", F.coalesce("n", F.lit(0)).alias("retrieved"), "last_retrieved")


@query("review_counts", "select status, count(*) as n, round(avg(confidence), 6) as mean_confidence from candidates group by status", "candidates")
def review_counts(spark: SparkSession, d: str) -> DataFrame:
    return t.candidates(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("latency_p95", """with w as (select user_id, event_id, value, list(value) over (partition by user_id order by "at", event_id rows between 49 preceding and current row) as l from signal)
  select user_id, event_id, round(list_avg(l), 6) as mean_ms, round(list_sort(l)[greatest(0, floor(len(l) * 0.95)::int - 1) + 1], 6) as p95_ms, round(list_max(l), 6) as max_ms from w where len(l) >= 5""", "signal")
def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    """Rolling window of the last 50 latencies of a source."""
    return chains.rolling_latency(t.signal(spark, d), "user_id", "at", "event_id", "value")


@query("scale_alarm", """with w as (select user_id, "at", event_id, list(value) over (partition by user_id order by "at", event_id rows between 49 preceding and current row) as l, row_number() over (partition by user_id order by "at" desc, event_id desc) as r from signal)
  select user_id, round(list_sort(l)[greatest(0, floor(len(l) * 0.95)::int - 1) + 1], 6) as p95_ms, list_sort(l)[greatest(0, floor(len(l) * 0.95)::int - 1) + 1] > 300 as alarm from w where r = 1 and len(l) >= 5""", "signal")
def scale_alarm(spark: SparkSession, d: str) -> DataFrame:
    """The newest window of each source against the limit of 300 ms."""
    rows = chains.rolling_latency(t.signal(spark, d), "user_id", "at", "event_id", "value")
    rows = rows.join(t.signal(spark, d).select("event_id", "at"), "event_id")
    last = rows.groupBy("user_id").agg(F.max_by("p95_ms", F.struct("at", "event_id")).alias("p95_ms"))
    return last.withColumn("alarm", F.col("p95_ms") > 300)


@query("dup_fingerprint", """with r as (select memory_id, row_number() over (partition by category, lower(content)[1:60] order by length(content) desc, created_at, memory_id) as r,
    first_value(memory_id) over (partition by category, lower(content)[1:60] order by length(content) desc, created_at, memory_id) as keeper from mem where status = 'active')
  select memory_id, keeper from r where r > 1""", "mem")
def dup_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Later near copies by the first 60 characters, with the fact that is kept."""
    m = t.mem(spark, d).filter("status = 'active'")
    key = [F.col("category"), F.substring(F.lower("content"), 1, 60)]
    # the keeper comes from an aggregate with map-side combine, so a common opening does not meet in one window
    kept = m.groupBy(key[0].alias("k1"), key[1].alias("k2")).agg(F.min_by("memory_id", F.struct(-F.length("content"), F.col("created_at"), F.col("memory_id"))).alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    return m.join(kept, (key[0] == F.col("k1")) & (key[1] == F.col("k2"))).filter("memory_id <> keeper").select("memory_id", "keeper")


@query("chain_versions", "select memory_id, chain_id, row_number() over (partition by chain_id order by created_at, doc_id) as version, count(*) over (partition by chain_id) as versions, valid_to is null as is_current from mem", "mem")
def chain_versions(spark: SparkSession, d: str) -> DataFrame:
    return chains.number_versions(t.mem(spark, d)).select("memory_id", "chain_id", "version", "versions", "is_current")


@query("chain_diff", """with p as (select *, lag(content) over w as pc, lag(category) over w as pk, lag(tags) over w as pt from mem window w as (partition by chain_id order by doc_id))
  select memory_id, content <> pc as content_changed, category <> pk as category_changed, list_sort(list_filter(tags, lambda x: not list_contains(pt, x))) as added, list_sort(list_filter(pt, lambda x: not list_contains(tags, x))) as removed
  from p where pc is not null""", "mem")
def chain_diff(spark: SparkSession, d: str) -> DataFrame:
    return chains.diff_versions(t.mem(spark, d))


@query("scd_build", """select memory_id, created_at as valid_from, lead(created_at) over (partition by chain_id order by created_at, doc_id) as valid_to, lead(memory_id) over (partition by chain_id order by created_at, doc_id) as superseded_by from mem""", "mem")
def scd_build(spark: SparkSession, d: str) -> DataFrame:
    facts = t.mem(spark, d).select("memory_id", "chain_id", "doc_id", "created_at")
    return chains.build_validity(facts).select("memory_id", "valid_from", "valid_to", "superseded_by")


@query("stratified_sample")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """About 140 facts: by category in proportion, half of each from its newest third; a seeded hash decides."""
    return chains.stratified_sample(t.mem(spark, d), "category", 140, seed=7).select("memory_id", "category", "is_new")


@query("revisit_pick")
def revisit_pick(spark: SparkSession, d: str) -> DataFrame:
    """One seeded insight older than three days for each user, else any."""
    m = t.mem(spark, d).filter("category = 'insight' and status = 'active'").withColumn("recent", F.col("created_at") > NOW - 3 * 86400)
    return m.groupBy("user_scope").agg(F.min_by("memory_id", F.struct("recent", F.xxhash64("memory_id", F.lit(7)))).alias("memory_id"))


@query("high_signal", """select f.memory_id, helpful + approved - dismissed as feedback, coalesce(r.n, 0) as retrieved from
   (select memory_id, count(*) filter (where kind = 'helpful') as helpful, count(*) filter (where kind = 'approved') as approved, count(*) filter (where kind = 'dismissed') as dismissed, count(*) filter (where kind = 'retrieved') as n from signal group by memory_id) f
   join (select memory_id as m2, count(*) filter (where kind = 'retrieved') as n from signal group by memory_id) r on m2 = f.memory_id
  where helpful + approved - dismissed > 0 order by feedback desc, retrieved desc, memory_id limit 20""", "signal")
def high_signal(spark: SparkSession, d: str) -> DataFrame:
    f = chains.fold_feedback(t.signal(spark, d), retrieved=True).withColumn("feedback", F.col("helpful") + F.col("approved") - F.col("dismissed"))
    return f.filter("feedback > 0").orderBy(F.desc("feedback"), F.desc("retrieved"), "memory_id").limit(20).select("memory_id", "feedback", "retrieved")


@query("keeper_score", """select m.memory_id, round(2 * confidence + 3 * coalesce(h, 0) + 0.1 * coalesce(r, 0) - 2 * coalesce(x, 0) + least(length(content) / 1000.0e0, 1), 6) as score from mem m left join
  (select memory_id, count(*) filter (where kind = 'helpful') as h, count(*) filter (where kind = 'retrieved') as r, count(*) filter (where kind = 'dismissed') as x from signal group by memory_id) s using (memory_id)""", "mem", "signal")
def keeper_score(spark: SparkSession, d: str) -> DataFrame:
    return chains.with_keeper_score(t.mem(spark, d), t.signal(spark, d)).select("memory_id", F.round("score", 6).alias("score"))


@query("payload_merge", """select memory_id, '{"kind":"' || category || '","lang":"' || tags[1] || '","source":"' || tags[2] || '"}' as payload from mem""", "mem")
def payload_merge(spark: SparkSession, d: str) -> DataFrame:
    """A JSON payload gets default keys; its own keys win.  Keys come out sorted, so equal payloads are equal text."""
    m = t.mem(spark, d).withColumn("payload", F.to_json(F.create_map(F.lit("lang"), F.col("tags")[0], F.lit("source"), F.col("tags")[1])))
    return chains.merge_payload(m, {"kind": F.col("category"), "lang": F.lit("en")}).select("memory_id", "payload")


@query("update_versions", f"""with upd as (select * from mem where valid_to is null and doc_id % 3 = 0)
  select memory_id, case when doc_id % 3 = 0 and valid_to is null then {NOW} else valid_to end as valid_to, case when doc_id % 3 = 0 and valid_to is null then memory_id || '-v2' else superseded_by end as superseded_by from mem
  union all select memory_id || '-v2', null, null from upd""", "mem")
def update_versions(spark: SparkSession, d: str) -> DataFrame:
    """Heads with doc_id divisible by three get a new version; the old row closes."""
    m = t.mem(spark, d)
    changes = m.filter("valid_to is null and doc_id % 3 = 0").select("memory_id", F.concat("memory_id", F.lit("-v2")).alias("new_id"), F.concat("content", F.lit(" (edited)")).alias("new_content"))
    return chains.apply_updates(m, changes, NOW).select("memory_id", "valid_to", "superseded_by")


@query("delete_versions", """with del as (select memory_id, chain_id, doc_id, valid_to is null as head from mem where doc_id % 10 in (3, 4, 7)),
   stay as (select chain_id, max(doc_id) as doc_id from mem where memory_id not in (select memory_id from del) group by chain_id),
   reopened as (select 'mem-' || stay.doc_id as memory_id from stay join del on del.chain_id = stay.chain_id and head)
  select memory_id, case when memory_id in (select memory_id from del) then 'quarantined' else status end as status, case when memory_id in (select memory_id from reopened) then null else valid_to end as valid_to
  from mem where memory_id not in (select memory_id from del where head)""", "mem")
def delete_versions(spark: SparkSession, d: str) -> DataFrame:
    """A deleted head goes and the latest version that stays reopens; deleted older versions are quarantined."""
    m = t.mem(spark, d)
    return chains.apply_deletes(m, m.filter("doc_id % 10 in (3, 4, 7)").select("memory_id")).select("memory_id", "status", "valid_to")


@query("chain_history", """with recursive up as (select memory_id, memory_id as here, superseded_by from mem union all select u.memory_id, m.memory_id, m.superseded_by from up u join mem m on m.memory_id = u.superseded_by),
   root as (select memory_id, here as head from up where superseded_by is null)
  select m.memory_id, r.head, row_number() over (partition by r.head order by m.valid_from, m.memory_id) as version, count(*) over (partition by r.head) as versions from mem m join root r using (memory_id)""", "mem")
def chain_history(spark: SparkSession, d: str) -> DataFrame:
    """Chains are found from the forward pointers alone, by pointer doubling."""
    return chains.history(t.mem(spark, d).select("memory_id", "superseded_by", "valid_from"))


@query("chain_membership", "select memory_id, count(*) over (partition by chain_id) as versions, count(*) over (partition by chain_id) > 1 as has_history from mem qualify valid_to is null", "mem")
def chain_membership(spark: SparkSession, d: str) -> DataFrame:
    m = t.mem(spark, d)
    n = m.groupBy("chain_id").agg(F.count("*").alias("versions"))
    return m.filter("valid_to is null").join(n, "chain_id").select("memory_id", "versions", (F.col("versions") > 1).alias("has_history"))


@query("chain_arc", """select chain_id, string_agg('v' || v || ': ' || case when status = 'quarantined' then '[withheld]' else replace(content, chr(10), ' ')[1:120] end || case when valid_to is null then ' (current)' else '' end, ' | ' order by v) as arc
  from (select *, row_number() over (partition by chain_id order by created_at, doc_id) as v from mem) group by chain_id""", "mem")
def chain_arc(spark: SparkSession, d: str) -> DataFrame:
    return chains.arcs(t.mem(spark, d))


@query("quarantine_fold", """select m.memory_id, case when x.memory_id is not null then 'quarantined' when r.memory_id is not null then 'active' else m.status end as status from mem m
  left join (select distinct memory_id from signal where kind = 'dismissed' and value > 80) x on x.memory_id = m.memory_id left join (select distinct memory_id from signal where kind = 'approved') r on r.memory_id = m.memory_id""", "mem", "signal")
def quarantine_fold(spark: SparkSession, d: str) -> DataFrame:
    """Strong dismissals quarantine a fact; an approval restores one that has none."""
    s = t.signal(spark, d).groupBy("memory_id").agg(F.bool_or((F.col("kind") == "dismissed") & (F.col("value") > 80)).alias("out"), F.bool_or(F.col("kind") == "approved").alias("back"))
    return t.mem(spark, d).join(s, "memory_id", "left").select("memory_id", F.when(F.col("out"), "quarantined").when(F.col("back"), "active").otherwise(F.col("status")).alias("status"))


@query("resume_set", "select memory_id from mem where status = 'active' and memory_id not in (select memory_id from signal)", "mem", "signal")
def resume_set(spark: SparkSession, d: str) -> DataFrame:
    return t.mem(spark, d).filter("status = 'active'").select("memory_id").join(t.signal(spark, d).select("memory_id").distinct(), "memory_id", "left_anti")


@query("ordered_union", """select memory_id, min(pos) as pos from (select 'mem-' || doc_id as memory_id, row_number() over (order by quality desc, doc_id) as pos from labels
   union all select 'mem-' || vec_id, (select count(*) from labels) + row_number() over (order by label, vec_id) from embeddings) group by memory_id""")
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists as one: every id at its first position; places come from ranges of the order, not from one task."""
    first = t.read(spark, d, "labels")
    a = iterate.numbered(first.select("doc_id", "quality"), "pos", F.desc("quality"), F.col("doc_id"))
    b = iterate.numbered(t.read(spark, d, "embeddings").select("vec_id", "label"), "pos", F.col("label"), F.col("vec_id"))
    both = a.select(F.concat(F.lit("mem-"), "doc_id").alias("memory_id"), "pos").unionByName(b.select(F.concat(F.lit("mem-"), "vec_id").alias("memory_id"), (F.col("pos") + first.count()).alias("pos")))
    return both.groupBy("memory_id").agg(F.min("pos").alias("pos"))
