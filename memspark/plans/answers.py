"""Model answers over the given facts: what they say, what is refused, and the candidates they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as x
from memspark.operators import responses
from memspark.sources import tables as t
from memspark.sources.tables import CATEGORIES

from .base import query
from .rules import lit

# An answer a chain, made by one expression that both engines read: {j} is the JSON text of a string, {k} the place of the chain.
_ID = "'\"mem-' || ({}) || '\"'"
_BODY = """'{{"facts": [{{"content": ' || {quote} || ', "category": "' || category || '", "confidence": ' || case when {k} % 3 = 0 then '"high"' else '' || ({k} % 4) end || ', "tags": ["Alpha", " beta ", "", "c", "D", "e", "f"], "sources": [' || {one} || ', ' || {far} || ']}}, {{"content": "no"}}, {{"content": "all invented here", "sources": [' || {far} || ']}}]'
  || ', "insights": [{{"content": "often of ' || category || '", "confidence": "' || case when {k} % 2 = 0 then 'Low' else 'sure' end || '"}}, ' || case when {k} % 5 = 0 then '"loose text"' else '{{"content": ' || {quote} || '}}' end || ']'
  || ', "guardrails": ' || case when {k} % 7 = 0 then '"none"' else '[{{"content": "ask before number ' || doc_id % 40 || ' is used"}}]' end
  || ', "relations": [{{"target": "the ' || category || ' club", "relation": "Member Of"}}, {{"source": "User", "target": "' || category || ' Club", "relation": "member-of"}}, {{"source": "group ' || {k} || '", "target": "it", "relation": "is"}}, {{"source": "group ' || {k} || '", "target": "town ' || {k} || '", "relation": "", "target_type": "place"}}]'
  || ', "decisions": [{{"id": ' || {one} || ', "action": "Keep"}}, {{"id": ' || {one} || ', "action": "drop"}}, {{"id": ' || {far} || ', "action": "keep"}}, {{"id": ' || {two} || ', "action": "' || case when {k} % 2 = 0 then 'merge' else 'burn' end || '"}}]'
  || ', "contradictions": [{{"a_id": ' || {one} || ', "b_id": ' || {two} || ', "reason": ' || {quote} || '}}, {{"a_id": ' || {one} || ', "b_id": ' || {far} || ', "reason": "x"}}]}}'"""


def _raw(quote: str, newline: str) -> str:
    k = "(doc_id // 5)" if newline == "chr(10)" else "(doc_id div 5)"
    body = _BODY.format(k=k, quote=quote, one=_ID.format("doc_id"), two=_ID.format("doc_id + 1"), far=_ID.format("doc_id + 7"))
    fence = f"'```json' || {newline} || ({body}) || {newline} || '```'"
    return f"case {k} % 13 when 1 then null when 2 then '  ' when 3 then 'no answer' when 4 then ({body}) || ' I hope this helps' when 5 then ({body}) when 6 then '[{{\"content\": ' || {quote} || '}}, {{\"target\": \"Old Harbour\", \"relation\": \"near\"}}]' else {fence} end"


_HEAD = "substring(content, 1, 250)"
SPARK_RAW = _raw(f"substring(to_json(named_struct('c', {_HEAD})), 6, length(to_json(named_struct('c', {_HEAD}))) - 6)", "char(10)")
DUCK_RAW = _raw(f"to_json({_HEAD})::varchar", "chr(10)")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer for the first fact of each chain, some of them broken."""
    m = t.mem(spark, d).filter("doc_id % 5 = 0 and content is not null")
    return m.select(F.concat(F.lit("answer-"), "doc_id").alias("answer_id"), F.col("chain_id").alias("cluster"), F.expr(SPARK_RAW).alias("raw"))


def shown(spark: SparkSession, d: str) -> DataFrame:
    return t.mem(spark, d).select(F.col("chain_id").alias("cluster"), "memory_id")


def _listed(part: str, path: str) -> str:
    at = f"json_extract(doc, '{path}')"
    return f"select answer_id, cluster, {part} as part, unnest(case when json_type({at}) = 'ARRAY' then ({at})::json[] end) as item, generate_subscripts(case when json_type({at}) = 'ARRAY' then ({at})::json[] end, 1) - 1 as pos from ok"


_SHORT = "length(coalesce(trim(item->>'$.content'), '')) < 5"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower({}), '\\s+', ' ', 'g')), '^[^a-z0-9]+|[^a-z0-9#]+$', '', 'g'), '^(the|a|an|my) ', ''), ' (now|today|currently|lately|anymore)$', '')"
_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(item->>'$.relation', '')), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g'), ''), 'related_to')"
_BAD = f"length(dst) < 3 or length(dst) >= 80 or len(string_split(dst, ' ')) > 6 or dst in {x.NO_ENTITY} or regexp_matches(dst, {lit(x.CLAUSE)})"
_TYPE = "coalesce(" + ", ".join(f"case when regexp_matches(dst, {lit(p)}) then '{k}' end" for k, p in x.TYPE_ENDINGS) + ", 'concept')"
_CITED = "list_distinct(coalesce(try_cast(json_extract(item, '$.sources') as varchar[]), []))"

SAID = f"""seen as (select chain_id as cluster, memory_id from mem), a as (select 'answer-' || doc_id as answer_id, chain_id as cluster, ({DUCK_RAW}) as raw from mem where doc_id % 5 = 0 and content is not null),
  u as (select *, regexp_replace(coalesce(raw, ''), '^\\s+|\\s+$', '', 'g') as bare from a), w as (select answer_id, cluster, case when starts_with(bare, '```') then regexp_replace(bare, '^```[A-Za-z]*\\s*|\\s*```$', '', 'g') else bare end as txt from u),
  p as (select answer_id, cluster, txt, try_cast(txt as json) as doc from w), ok as (select * from p where doc is not null and json_type(doc) in ('OBJECT', 'ARRAY')),
  i0 as ({' union all '.join(_listed(lit(n), '$.' + n) for n in responses.PARTS)} union all {_listed("'list'", '$')}),
  i as (select * replace (case when part <> 'list' then part when item->>'$.target' is not null then 'relations' else 'facts' end as part), json_type(item) = 'OBJECT' as is_object from i0),
  c as (select answer_id, part, pos, count(*) as n_cited, coalesce(list_sort(list(id) filter (where (cluster, id) in (select (cluster, memory_id) from seen))), []) as known from (select answer_id, cluster, part, pos, unnest({_CITED}) as id from i where part in ('facts', 'insights', 'guardrails') and is_object) group by all),
  f as (select i.*, trim(item->>'$.content') as content, known, case when not is_object then 'no object' when {_SHORT} then 'short' when n_cited > 0 and len(known) = 0 then 'invented ids' end as fault from i left join c using (answer_id, part, pos) where part in ('facts', 'insights', 'guardrails')),
  facts as (select answer_id, cluster, part, pos, case when part = 'facts' then case when item->>'$.category' in {CATEGORIES} then item->>'$.category' else 'context_note' end when part = 'insights' then 'insight' else 'context_note' end as category, case when part = 'facts' then content else content[1:200] end as content,
     case when part <> 'facts' then case when lower(item->>'$.confidence') in {responses.UNSURE_WORDS} then 0.5e0 else 0.7e0 end else case when try_cast(item->>'$.confidence' as double) is null then 0.45e0 else greatest(0e0, least(1e0, try_cast(item->>'$.confidence' as double))) end end as confidence,
     list_filter(list_transform(coalesce(try_cast(json_extract(item, '$.tags') as varchar[]), []), lambda v: lower(trim(v))), lambda v: v <> '')[1:5] as tags, case when len(known) > 0 then known end as sources from f where fault is null),
  r0 as (select answer_id, pos, is_object, {_CLEAN.format("coalesce(item->>'$.source', 'user')")} as src, {_SLUG} as relation, {_CLEAN.format("coalesce(item->>'$.target', '')")} as dst, nullif(item->>'$.target_type', '') as told from i where part = 'relations'),
  r1 as (select *, case when not is_object then 'no object' when src = '' then 'no source' when {_BAD} then 'bad target' end as fault from r0),
  r as (select * replace (case when fault is null and row_number() over (partition by answer_id, fault, src, relation, dst order by pos) > 1 then 'repeated' else fault end as fault) from r1),
  d1 as (select answer_id, cluster, pos, item->>'$.id' as id, lower(item->>'$.action') as action, case when (cluster, item->>'$.id') not in (select (cluster, memory_id) from seen) then 'invented ids' when lower(item->>'$.action') not in {responses.ACTIONS} then 'unknown action' end as fault from i where part = 'decisions'),
  d as (select * replace (case when fault is null and row_number() over (partition by answer_id, fault, id order by pos) > 1 then 'repeated' else fault end as fault) from d1),
  k as (select answer_id, cluster, pos, item->>'$.a_id' as a_id, item->>'$.b_id' as b_id, trim(item->>'$.reason') as reason, case when (cluster, item->>'$.a_id') not in (select (cluster, memory_id) from seen) or (cluster, item->>'$.b_id') not in (select (cluster, memory_id) from seen) then 'invented ids' when coalesce(trim(item->>'$.reason'), '') = '' then 'no reason' end as fault from i where part = 'contradictions'),
  cons as (select answer_id, cluster, pos, substring('Possible contradiction between ' || a_id || ' and ' || b_id || ': ' || substring(reason, 1, 140), 1, 200) as content, a_id, b_id from k where fault is null)"""


@query("model_answers", f"""with {SAID} select 'fact' as kind, answer_id, part, pos, category as detail, content as text, round(confidence, 6) as confidence, tags, coalesce(sources, []) as ids from facts
  union all select 'relation', answer_id, 'relations', pos, relation, src || ' > ' || dst, null, [], [coalesce(told, {_TYPE})] from r where fault is null union all select 'decision', answer_id, 'decisions', pos, action, '', null, [], [id] from d where fault is null
  union all select 'contradiction', answer_id, 'contradictions', pos, '', content, null, [], [a_id, b_id] from cons
  union all select 'fault', answer_id, part, pos, fault, '', null, [], [] from f where fault is not null union all select 'fault', answer_id, 'relations', pos, fault, '', null, [], [] from r where fault is not null
  union all select 'fault', answer_id, 'decisions', pos, fault, '', null, [], [] from d where fault is not null union all select 'fault', answer_id, 'contradictions', pos, fault, '', null, [], [] from k where fault is not null
  union all select 'fault', answer_id, 'answer', -1, case when txt = '' then 'empty' when doc is null then 'not JSON' else 'no object or list' end, '', null, [], [] from p where answer_id not in (select answer_id from ok)
  union all select 'fault', answer_id, q, -1, 'no list', '', null, [], [] from (select answer_id, doc, unnest({list(responses.PARTS)}) as q from ok where json_type(doc) = 'OBJECT') where json_type(json_extract(doc, '$.' || q)) not in ('ARRAY', 'NULL')""", "mem")
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """All that an answer a chain says, by kind: facts, relations, decisions, contradictions, and each refusal with its reason."""
    got = responses.split(answers(spark, d), shown(spark, d))
    none, empty = F.array().cast("array<string>"), F.lit("")

    def row(df: DataFrame, kind: str, part, detail, text, ids, confidence=None, tags=none) -> DataFrame:
        sure = F.lit(None).cast("double") if confidence is None else F.round(confidence, 6)
        return df.select(F.lit(kind).alias("kind"), "answer_id", part.alias("part"), "pos", detail.alias("detail"), text.alias("text"), sure.alias("confidence"), tags.alias("tags"), ids.alias("ids"))

    c = F.col
    return (
        row(got.facts, "fact", c("part"), c("category"), c("content"), F.coalesce("sources", none), c("confidence"), c("tags"))
        .unionByName(row(got.relations, "relation", F.lit("relations"), c("relation"), F.concat("source", F.lit(" > "), "target"), F.array("target_type")))
        .unionByName(row(got.decisions, "decision", F.lit("decisions"), c("action"), empty, F.array("id")))
        .unionByName(row(got.contradictions, "contradiction", F.lit("contradictions"), empty, c("content"), F.array("a_id", "b_id")))
        .unionByName(row(got.faults, "fault", c("part"), c("reason"), empty, none))
    )


@query("model_proposals", f"""with {SAID}, n as (select cluster, count(*) as n from seen group by cluster),
  e as (select 'cand-' || sha256('answer|' || answer_id || '|' || part || '|' || pos)[1:16] as candidate_id, cluster, category, trim(content) as content, confidence, len(sources) as cited from facts where part <> 'facts' union all
    select 'cand-' || sha256('answer|' || answer_id || '|contradiction|' || pos)[1:16], cluster, 'context_note', trim(content), 0.5e0, null from cons)
  select candidate_id, category, content, round(confidence, 6) as confidence, coalesce(cited, n) as n_sources from e join n using (cluster) where (category, content) not in (select (category, trim(content)) from candidates where status = 'pending' and coalesce(user_scope, '') = '' and content is not null)
  qualify row_number() over (partition by category, content order by candidate_id) = 1""", "mem", "candidates")
def model_proposals(spark: SparkSession, d: str) -> DataFrame:
    """The candidates that the answers lead to, without copies and without what is pending already."""
    said = shown(spark, d)
    got = responses.emitted(responses.split(answers(spark, d), said), said, t.candidates(spark, d).filter("status = 'pending'"))
    return got.withColumn("confidence", F.round("confidence", 6))
