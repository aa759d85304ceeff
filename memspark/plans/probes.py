"""Evaluation of retrieval by probes: questions in turn, what a run finds, and verdicts between stored runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import vectors
from memspark.operators import evaluate, iterate, probing, ranking
from memspark.sources import tables as t
from memspark.sources.tables import NOW

from .base import query
from .rules import READ_LEX, dated_sql, lit
from .search import HYBRID, _facts

#: Names for words of the given texts.
SYNONYMS = {"the": "that", "und": "sowie", "les": "quelques", "los": "unos", "of": "from"}
_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9'']+')"
_KEYS = f"list_filter({_TOKENS}, lambda w: length(w) > 2 and w not in {probing.STOP})"
_SUBJECT = f"array_to_string((case when len({_KEYS}) > 0 then {_KEYS} else list_filter({_TOKENS}, lambda w: length(w) > 1) end)[1:4], ' ')"
_CLIP = "case when length({0}) <= 24 then {0} when contains(substring({0}, 1, 24), ' ') then regexp_replace(substring({0}, 1, 24), ' [^ ]*$', '') else substring({0}, 1, 24) end"
_BARE = "regexp_replace(lower({}), '[^a-z]', '', 'g')"
_SYN = "map {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in SYNONYMS.items()) + "}"


def subject_sql(c: str) -> str:
    return _SUBJECT.replace("{}", c)


@query("probe_templates", f"""with recursive b as (select memory_id, doc_id, category, tags, created_at, trim(coalesce(content, '') || case when doc_id % 3 = 0 then ' as of yesterday' else '' end) as txt from mem where status = 'active'), l as (select doc_id as turn_id, created_at // 86400 as day, lower(txt) as low from b), {READ_LEX}, {dated_sql()},
  s as (select *, string_split_regex(txt, '\\s+') as ws from b), p as (select *, list_position(list_transform(ws, lambda w: {_BARE.format('w')} in {tuple(SYNONYMS)}), true) as nth from s),
  n as (select *, case when nth > 0 then array_to_string(list_concat(ws[1:nth - 1], [{_SYN}[{_BARE.format('ws[nth]')}]], ws[nth + 1:]), ' ') end as new from p),
  a as (select memory_id, doc_id, {subject_sql('txt')} as sub, {_CLIP.format('txt')} as rest, coalesce(({_KEYS.format('txt')})[2], '') as verb, category, tags, created_at, doc_id in (select turn_id from dated where day is not null) as dated, new, {subject_sql('new')} as sub2, {_CLIP.format('new')} as rest2 from n),
  k as (select memory_id, doc_id, row_number() over (order by created_at, memory_id) as place, [case when sub <> '' then 'what is ' || sub || ' ' || rest || '?' end, case when sub <> '' and dated then 'when did ' || sub || ' ' || rest || '?' end, case when sub <> '' and category = 'preference' then 'what does the user prefer about ' || sub || '?' end,
    case when sub <> '' and len(tags) > 0 then sub || ' ' || verb || '?' end, case when sub <> '' then 'who is NOT ' || sub end, case when new is not null and sub2 <> '' then 'what is ' || sub2 || ' ' || rest2 || '?' end] as asks from a),
  walk(place, state, chosen) as (select 0::bigint, 0, null::int union all
    select k.place, case when c is null then state else (c + 1) % 6 end, c from (select k.place, walk.state, list_filter([(walk.state + o) % 6 for o in range(6)], lambda j: asks[(j + 1)::int] is not null)[1]::int as c from walk join k on k.place = walk.place + 1) k)
  select memory_id, {list(probing.TEMPLATES)}[chosen + 1] as template, asks[chosen + 1] as probe from walk join k using (place) where chosen is not null""", "mem")
def probe_templates(spark: SparkSession, d: str) -> DataFrame:
    """A probe for every active fact, six templates in turn over all of them, those that don't apply skipped; every third fact is dated."""
    told = F.concat(F.coalesce("content", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " as of yesterday").otherwise(""))
    m = t.mem(spark, d).filter("status = 'active'").select("memory_id", "category", told.alias("content"), "tags", "created_at")
    asked = probing.questions(m, SYNONYMS).select("memory_id", "created_at", "asks")
    return probing.in_turn(asked, F.col("created_at"), F.col("memory_id")).select("memory_id", "template", "probe")


_WORDS = "list_distinct(list_filter(string_split_regex(lower(coalesce({}, '')), '[^a-z0-9'']+'), lambda w: w <> ''))"
_ALIKE = f"coalesce(len(list_intersect({_WORDS.format('m.content')}, ws))::double / nullif(len(list_distinct(list_concat({_WORDS.format('m.content')}, ws))), 0), 0) >= {probing.ALIKE}e0"
_EXPECT = f"e as (select w.query_id, m.memory_id as want, m.chain_id as want_chain, {_WORDS.format('m.content')} as ws from w join mem m using (memory_id))"


@query("probe_run", HYBRID + f""", {t.EXPECTED}, {_EXPECT}, wide as (select *, row_number() over (partition by query_id order by round(score, 12) desc, memory_id) as r from hits qualify r <= {probing.WIDE}),
  j as (select e.query_id, want, wide.memory_id, r, score, m.memory_id = want as own, m.memory_id = want or m.chain_id = want_chain as version, r <= {max(probing.LADDER)} and (m.chain_id = want_chain or {_ALIKE}) as near from e join wide using (query_id) join mem m on m.memory_id = wide.memory_id)
  select e.query_id, want as memory_id, min(r) filter (where near) as rank, coalesce(min(r) filter (where own), min(r) filter (where version)) as wide_rank, coalesce(list(j.memory_id order by r) filter (where r <= 5), []) as top_ids, coalesce(list(round(score, 4) order by r) filter (where r <= 5), []) as top_scores
  from e left join j using (query_id, want) group by all""", "mem", "q", "signal")
def probe_run(spark: SparkSession, d: str) -> DataFrame:
    """Each expected fact's rank by the hit rule, its rank in a pool of 512, and the five best hits."""
    hits = ranking.hybrid(t.search_queries(spark, d), _facts(spark, d), t.signal(spark, d), NOW, probing.WIDE, vector_pool=40)
    return probing.run(t.expected_facts(spark, d), t.mem(spark, d), hits)


_RUN = f"select '{{0}}' as run, e.query_id, min(r) filter (where r <= {max(probing.LADDER)} and (m.chain_id = want_chain or {_ALIKE})) as rank from e left join (select query_id as q_id, memory_id, rank as r from {{1}}) h on q_id = e.query_id left join mem m on m.memory_id = h.memory_id group by e.query_id"
PAIRS = (("vector", "keyword"), ("keyword", "vector"), ("hybrid", "keyword"), ("vector", "never"))


@query("regression_verdict", HYBRID + f""", {t.EXPECTED}, {_EXPECT}, wide as (select *, row_number() over (partition by query_id order by round(score, 12) desc, memory_id) as rank from hits), runs as ({_RUN.format('keyword', 'kr')} union all {_RUN.format('vector', 'vr')} union all {_RUN.format('hybrid', 'wide')}),
  t as (select run, avg(coalesce(rank <= {probing.AT}, false)::int) as recall from runs group by run)
  select current, baseline, round(b.recall, 6) as before, round(a.recall, 6) as after, case when a.recall is null or b.recall is null then 'missing' when (a.run = 'hybrid') <> (b.run = 'hybrid') then 'refused' when round(b.recall - a.recall, 9) > {probing.DROP}e0 then 'fail' else 'pass' end as verdict
  from (values {', '.join(map(str, PAIRS))}) p(current, baseline) left join t a on a.run = current left join t b on b.run = baseline""", "mem", "q", "signal")
def regression_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts between runs of a ledger: two legs of one configuration, the hybrid of another, and a run that was never made."""
    q, f = t.search_queries(spark, d), _facts(spark, d)
    expected = iterate.materialize(t.expected_facts(spark, d))
    # each leg is made once, and the facts that a run can ask for are read once for all runs
    made = {"keyword": iterate.materialize(ranking.ranked(ranking.keyword_scores(q, f), 200)), "vector": iterate.materialize(vectors.top_k(q, f, 40))}
    made["hybrid"] = iterate.materialize(ranking.combined(made["keyword"], made["vector"], f, t.signal(spark, d), NOW, probing.WIDE))
    ids = reduce(DataFrame.union, (x.select("memory_id") for x in (expected, *made.values()))).distinct()
    m = iterate.materialize(t.mem(spark, d).select("memory_id", "chain_id", "content", "category").join(ids, "memory_id", "left_semi"))
    about = expected.join(m, "memory_id").select("query_id", "category")
    ledger = probing.RunLedger(spark, iterate.shared_dir(spark, "runs"))
    for name, hits in made.items():
        config = spark.range(1).select(evaluate.config_hash({"legs": F.lit(2 if name == "hybrid" else 1), "wide": F.lit(probing.WIDE)})).first()[0]
        ledger.record(name, config, probing.recalls(probing.run(expected, m, hits), about, ("category",)))
    rows = [ledger.verdict(*p) for p in PAIRS]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumns({c: F.round(c, 6) for c in ("before", "after")})
