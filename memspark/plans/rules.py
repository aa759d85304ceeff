"""Text rules, extraction, review and evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as x
from memspark.operators import proposals, ranking
from memspark.sources import tables as t
from memspark.sources.tables import NOW

from .base import query

LOW = "lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))"
ITEMS = f"items as (select 'm' || message_id as id, {LOW} as low, content, 'context_note' as category from messages union all select memory_id, {LOW}, content, category from mem)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(p: str) -> str:
    return f"regexp_matches(low, {lit(p)})"


def items(spark: SparkSession, d: str) -> DataFrame:
    """All texts: conversation turns and facts."""
    a = t.messages(spark, d).select(F.concat(F.lit("m"), "message_id").alias("id"), "content", F.lit("context_note").alias("category"))
    b = t.mem(spark, d).select(F.col("memory_id").alias("id"), "content", "category")
    return a.unionByName(b).withColumn("low", x.low())


_OPEN = " or length(low) - length(replace(low, '(', '')) > length(low) - length(replace(low, ')', ''))"
FLAG_LIST = "list_sort(list_filter([" + ", ".join(f"case when {has(p)}{_OPEN if n == 'junk' else ''} then {lit(n)} end" for n, p in x.FLAGS.items()) + ", case when category in ('context_note', 'event') then 'short_lived' end], lambda f: f is not null))"
HARD_LIST = f"list_filter({FLAG_LIST}, lambda f: list_contains({list(x.HARD)}, f))"
LABEL = "coalesce(" + ", ".join(f"case when {has(p)} then {lit(n)} end" for n, p in x.IDENTIFIERS.items()) + ")"


def hits(words: tuple) -> str:
    single = f"len(list_intersect(list_distinct(string_split_regex(low, '[^a-z0-9'']+')), {[w for w in words if ' ' not in w]}))"
    return "(" + " + ".join([single, *(f"{has(x.word(w))}::int" for w in words if " " in w)]) + ")"


def _sum(*terms: str) -> str:
    return "round(least(1e0, " + " + ".join(terms) + "), 6)"


_M = hits(x._MONTHS)
TEMPORAL = _sum(f"case when {_M} > 0 then {x.MONTH_WEIGHTS[0]}e0 + {x.MONTH_WEIGHTS[1]}e0 * least({_M} - 1, 2) else 0 end", *(f"case when {has(p)} then {w}e0 else 0 end" for w, p in x.TEMPORAL))
_SOME = "(" + " + ".join(hits(words) for _, words in x.HOP_WORDS.values()) + " > 0)"
_NAMES = f"list_filter(regexp_extract_all(content, {lit(x.NAME)}, 1), lambda w: lower(w) not in {(*x._MONTHS, *x._WEEKDAYS)})"
MULTIHOP = _sum(
    *(f"{w}e0 * least({hits(words)}, 2)" for w, words in x.HOP_WORDS.values()), f"case when {has(x.YOU_SAID[1])} then {x.YOU_SAID[0]}e0 else 0 end", f"case when {_SOME} and len({_NAMES}) > 0 then {x.NAME_WEIGHT}e0 else 0 end",
    f"case when {_SOME} and {has(x.TOPIC[1])} then {x.TOPIC[0]}e0 else 0 end", f"case when {_SOME} and regexp_matches(content, {lit(x.NAME_PAIR[1])}) then {x.NAME_PAIR[0]}e0 else 0 end",
)


@query("quality_flags", f"with {ITEMS} select id, {FLAG_LIST} as flags from items", "messages", "mem")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", x.flags(F.col("low"), F.col("category")).alias("flags"))


@query("hard_flags", f"with {ITEMS} select id, len({HARD_LIST}) as n from items", "messages", "mem")
def hard_flags(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", F.size(x.flags(F.col("low"), among=x.HARD)).cast("long").alias("n"))


@query("cleanup_junk", f"""with {ITEMS}, c as (select id as memory_id, {HARD_LIST} as hard, first_value(id) over (partition by category, lower(content)[1:60] order by length(content) desc, id) as keeper from items where id like 'mem-%')
  select memory_id, case when len(hard) > 0 then 'flags' else 'near copy' end as reason from c where len(hard) > 0 or memory_id <> keeper""", "messages", "mem")
def cleanup_junk(spark: SparkSession, d: str) -> DataFrame:
    """Facts to quarantine: hard flags, or a later near copy by the first 60 characters."""
    m = items(spark, d).filter("id like 'mem-%'")
    key = [F.col("category"), F.substring(F.lower("content"), 1, 60)]
    keep = m.groupBy(key[0].alias("k1"), key[1].alias("k2")).agg(F.min_by("id", F.struct(-F.length("content"), "id")).alias("keeper"))
    n = F.size(x.flags(F.col("low"), among=x.HARD))
    out = m.withColumn("hard", n).join(keep, (key[0] == F.col("k1")) & (key[1] == F.col("k2")))
    return out.filter("hard > 0 or id <> keeper").select(F.col("id").alias("memory_id"), F.when(F.col("hard") > 0, "flags").otherwise("near copy").alias("reason"))


@query("pii_label", f"with {ITEMS} select id, {LABEL} as label from items where {LABEL} is not null", "messages", "mem")
def pii_label(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).withColumn("label", x.identifier(F.col("low"))).filter("label is not null").select("id", "label")


@query("egress_filter", f"with {ITEMS} select id from items where {LABEL} is null or id like 'mem-%'", "messages", "mem")
def egress_filter(spark: SparkSession, d: str) -> DataFrame:
    """What may leave: texts derived from the store, and any other without an identifier."""
    return items(spark, d).filter(x.identifier(F.col("low")).isNull() | F.col("id").startswith("mem-")).select("id")


#: Words of health, money, faith and secrets: what is asked about before it is kept.
SENSITIVE = x.word("addiction|allergy|anxiety|bankruptcy|cancer|debt|depression|diagnosed|diagnosis|disability|divorce|doctor|faith|health|income|loan|medication|mortgage|password|pregnant|religion|religious|salary|surgery|therapist|therapy|wage")
_SENSITIVE_SQL = f"(category = 'relationship' or (category in ('personal_fact', 'insight', 'context_note') and {has(SENSITIVE)}))"


def sensitive() -> Column:
    """Relationships always; personal facts, insights and notes by their words."""
    return (F.col("category") == "relationship") | (F.col("category").isin("personal_fact", "insight", "context_note") & x.found(F.col("low"), SENSITIVE))


@query("sensitive_flag", f"with {ITEMS} select id, {_SENSITIVE_SQL} as sensitive from items", "messages", "mem")
def sensitive_flag(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", sensitive().alias("sensitive"))


@query("referential_flag", f"with {ITEMS} select id, length(low) <= 300 and {has(x.REFERENTIAL)} as referential from items", "messages", "mem")
def referential_flag(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("id", ((F.length("low") <= 300) & x.found(F.col("low"), x.REFERENTIAL)).alias("referential"))




# Questions and statements about the store's own rows, so that every term of the scores occurs.
ASKED = """case {0} % 12 when 0 then 'When did ' || n_name || ' and Region first trade, before or after March ' || {0} % 28 || '?' when 1 then 'What did you say about ' || n_name || ' and Europe?' when 2 then 'Do I still work with ' || n_name || ' these days?'
  when 3 then 'Did Alice say she moved because Bob suggested ' || n_name || ' yesterday?' when 4 then 'What has changed in ' || n_name || ' since 2019?' when 5 then 'Compare ' || n_name || ' and Peru: is one better than the other?' when 6 then 'How many weeks ago was I in ' || n_name || '?'
  when 7 then n_name || ' was visited last month' when 8 then 'Where did we meet on Monday, 2 weeks ago?' when 9 then 'On 2024-01-15 we met in January and February.' when 10 then 'Which of them asked Clara about ' || n_name || ', and why?' else 'Tell me the history of ' || n_name end"""
_ASKED = f"asked as (select 'c' || c_custkey as id, {ASKED.format('c_custkey')} as content from customer join nation on c_nationkey = n_nationkey), low_ as (select *, {LOW} as low from asked union all select id, content, low from items)"


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Questions about nations beside all given texts."""
    c, n = t.read(spark, d, "customer"), t.read(spark, d, "nation")
    q = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.expr(ASKED.format("c_custkey")).alias("content"))
    return q.withColumn("low", x.low()).unionByName(items(spark, d).select("id", "content", "low"))


@query("temporal_score", f"with {ITEMS}, {_ASKED} select id, {TEMPORAL} as score from low_", "messages", "mem")
def temporal_score(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("id", x.temporal_score(F.col("low")).alias("score"))


@query("multihop_score", f"with {ITEMS}, {_ASKED} select id, {MULTIHOP} as score from low_", "messages", "mem")
def multihop_score(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("id", x.multihop_score(F.col("low"), F.col("content")).alias("score"))


@query("change_intent", f"with {ITEMS}, {_ASKED} select id, {has(x.CHANGE)} as change from low_", "messages", "mem")
def change_intent(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("id", x.found(F.col("low"), x.CHANGE).alias("change"))


@query("route_flag", f"with {ITEMS}, {_ASKED} select id, {has(x.QUESTION)} and ({TEMPORAL} >= {x.ROUTE_FROM}e0 or {MULTIHOP} >= {x.ROUTE_FROM}e0) as routed from low_", "messages", "mem")
def route_flag(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("id", x.routed(F.col("low"), F.col("content")).alias("routed"))


SENTENCES = "list_filter(string_split(regexp_replace(trim(regexp_replace(content, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))[1:25], lambda s: length(s) >= 15)"


@query("sentence_split", f"select message_id, {SENTENCES} as sentences from messages", "messages")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return t.messages(spark, d).select("message_id", x.sentences(F.col("content")).alias("sentences"))


# First-person statements that the relational tables hold, as text.
SAID = """case c_custkey % 24 when 0 then 'I live in ' || n_name || '. I usually buy ' || lower(c_mktsegment) || ' goods for 3 weeks.' when 1 then 'My partner is ' || c_name || '. I work for ' || n_name || ' Trading now.'
  when 2 then 'I switched from ' || lower(c_mktsegment) || ' to something else 2 weeks ago. I prefer the ' || lower(n_name) || ' market.' when 3 then 'I want to visit ' || n_name || ' for 10 days! I am a ' || lower(c_mktsegment) || ' buyer.'
  when 4 then 'Yesterday I met ' || c_name || '. My boss is ' || n_name || ' today.' when 5 then 'What changed in ' || n_name || ' last month?' when 6 then 'My favourite market is ' || n_name || ' (since the fair). I always order early, on Mondays.'
  when 7 then 'I own a ' || lower(c_mktsegment) || ' shop; I use a ledger. We opened it on March ' || (c_custkey % 28 + 1) || 'th.' when 8 then 'I learned that ' || n_name || ' pays late. It was three months ago.' when 9 then 'I attended the ' || n_name || ' fair last Friday. I am tired of queues.'
  when 10 then 'I am learning the language of ' || n_name || '. The exam is until 15 Dec 2024 or so.' when 11 then 'I am busy. I''m a ' || lower(c_mktsegment) || ' manager, and my rival is Mr Jones-Smith.' when 12 then 'I prefer ' || lower(n_name) || ' over peru. I noticed that prices fell the Tuesday two weeks ago.'
  when 13 then 'My sister is Anna Lee. My landlord is Otto. I work as a clerk in ' || n_name || '.' when 14 then 'I met him on February 30th, the day before yesterday.' when 15 then 'I plan to open in ' || n_name || ' by 3 May. On Valentine''s Day I visited ' || n_name || '.'
  when 16 then 'I attended a show last weekend. I moved from ' || n_name || ' to the coast a year ago.' when 17 then 'My wife is Dr Grace; i''m married to the sea. My shop is in ' || n_name || '.' when 18 then 'I finished the book 2.5 weeks ago, last year.' when 19 then 'I hate ' || lower(c_mktsegment) || ' and love ' || n_name || ' on December 31.'
  when 20 then 'I hope to retire next 2 years. I realized that time flies.' when 21 then 'I am working on ' || n_name || ' for 2 months. Last Sunday I met Customer#' || c_custkey || '.' when 22 then 'Nothing to say about it.' else 'I never pay ' || n_name || ' early. My cat is Tom.' end"""
TURNS = f"turns as (select c_custkey as turn_id, {SAID} as content from customer join nation on c_nationkey = n_nationkey)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    c, n = t.read(spark, d, "customer"), t.read(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("turn_id"), F.expr(SAID).alias("content"))


SENT = f"sent as (select turn_id, lower(unnest({SENTENCES})) as low from turns)"
#: Every sentence of a turn, however many it has.
SENT_ALL = SENT.replace("[1:25]", "")
def _fits(p: str, block: str | None) -> str:
    return has(x._A + p) + (f" and not {has(block)}" if block else "")


FACT = "case " + " ".join(f"when {_fits(p, k)} then {lit(n)}" for n, _, p, k in x.FACTS) + " end"
KIND = "case " + " ".join(f"when {_fits(p, k)} then {lit(c)}" for _, c, p, k in x.FACTS) + " end"
DETAIL = "case " + " ".join(f"when {_fits(p, k)} then trim(regexp_extract(low, {lit(p)}, {x.last_group(p)}))" for _, _, p, k in x.FACTS) + " end"
FOUND = f"fc as (select turn_id, {FACT} as rule, {KIND} as category, {DETAIL} as detail from sent)"


def facts(spark: SparkSession, d: str, most: int | None = 25) -> DataFrame:
    """Each sentence's fact: turn_id, rule, category, detail."""
    s = turns(spark, d).select("turn_id", F.explode(x.sentences(F.col("content"), most)).alias("s"))
    return s.select("turn_id", F.inline(x.facts(F.lower("s"))))


@query("extract_facts", f"with {TURNS}, {SENT}, {FOUND} select turn_id, rule, category, detail from fc where rule is not null")
def extract_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d)


CONTENT = "case rule " + " ".join(f"when {lit(n)} then {lit(w)}" for n, w in x.WORDING.items()) + " end || detail"


@query("extract_turns", f"""with {TURNS}, {SENT}, {FOUND}, o as (select turn_id, rule, category, {CONTENT} as content from fc where rule is not null), w as (select *, {LOW} as low from o), g as (select *, {FLAG_LIST} as flags from w)
  select turn_id, rule, category, content, 0.75e0 as confidence, case when category in ('context_note', 'event') then 'temporary' else 'durable' end as durability, flags from g where not list_contains(flags, 'junk')""")
def extract_turns(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the turns as rows for the queue: worded, with confidence, durability and flags; junk is dropped."""
    f = facts(spark, d).withColumn("content", x.worded(F.col("rule"), F.col("detail"))).select("*", F.inline(x.kept(F.col("content"), F.col("category"))))
    durability = F.when(F.col("category").isin("context_note", "event"), "temporary").otherwise("durable")
    return f.select("turn_id", "rule", "category", "content", F.lit(0.75).alias("confidence"), durability.alias("durability"), "flags")


@query("needs_second_stage", f"with {TURNS}, {SENT}, {FOUND}, n as (select turn_id, count(rule) as n from fc group by turn_id) select turn_id, coalesce(n, 0) as n_facts, length(content) >= 60 and (coalesce(n, 0) <= 1 or len(string_split(content, ' ')) / n > 80) as needed from turns left join n using (turn_id)")
def needs_second_stage(spark: SparkSession, d: str) -> DataFrame:
    n = facts(spark, d).groupBy("turn_id").agg(F.count("*").alias("n"))
    r = turns(spark, d).join(n, "turn_id", "left").withColumn("n_facts", F.coalesce("n", F.lit(0)))
    return r.select("turn_id", "n_facts", ((F.length("content") >= 60) & ((F.col("n_facts") <= 1) | (F.size(F.split("content", " ")) / F.col("n") > 80))).alias("needed"))


def clean(e: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower({e}), '\\s+', ' ', 'g')), '^[^a-z0-9]+|[^a-z0-9#]+$', '', 'g'), '^(the|a|an|my) ', ''), ' (now|today|currently|lately|anymore)$', '')[1:100]"


def _rel(n: str, p: str, kind: str) -> str:
    target = clean(f"regexp_extract(low, {lit(p)}, {x.last_group(p)})")
    usual = " ".join(f"when regexp_matches(target, {lit(e)}) then {lit(k)}" for k, e in x.TYPE_ENDINGS)
    return f"select turn_id, relation, target, case {usual} else {lit(kind)} end as type from (select turn_id, {lit(n)} as relation, {target} as target from sent where {_fits(p, x.TRANSIENT if n == 'is_a' else None)})"


REL = "rl as (" + " union all ".join(_rel(*r) for r in x.RELATIONS) + ")"
FAULT = f"case when length(target) < 3 then 'short' when length(target) >= 80 then 'long' when len(string_split(target, ' ')) > 6 then 'words' when list_contains({list(x.NO_ENTITY)}, target) then 'stop word' when regexp_matches(target, {lit(x.CLAUSE)}) then 'clause' end"
VALID = f"({FAULT}) is null"


def relations(spark: SparkSession, d: str, most: int | None = 25) -> DataFrame:
    s = turns(spark, d).select("turn_id", F.explode(x.sentences(F.col("content"), most)).alias("s"))
    return s.select("turn_id", F.inline(F.flatten(F.transform(F.array(F.lower("s")), x.relations))))


@query("extract_relations", f"with {TURNS}, {SENT}, {REL} select distinct turn_id, relation, target, type from rl where {VALID}")
def extract_relations(spark: SparkSession, d: str) -> DataFrame:
    return relations(spark, d).filter(x.entity_valid(F.col("target"))).distinct()


@query("entity_clean", f"with {TURNS}, {SENT}, {REL} select distinct target, {VALID} as valid from rl")
def entity_clean(spark: SparkSession, d: str) -> DataFrame:
    return relations(spark, d).select("target", x.entity_valid(F.col("target")).alias("valid")).distinct()


@query("entity_valid", f"with {TURNS}, {SENT}, {REL} select target, relation, {FAULT} as fault, count(*) as n from rl group by all")
def entity_valid(spark: SparkSession, d: str) -> DataFrame:
    """Names that relations bring up, how often, and why one is no entity."""
    return relations(spark, d).groupBy("target", "relation").agg(F.count("*").alias("n")).select("target", "relation", x.entity_fault(F.col("target")).alias("fault"), "n")


@query("needs_typing", f"with {TURNS}, {SENT}, {REL}, n as (select turn_id, count(*) as n from (select distinct turn_id, relation, target from rl where {VALID}) group by turn_id) select turn_id, coalesce(n, 0) as n_typed, coalesce(n, 0) < 3 and length(content) >= 60 as needed from turns left join n using (turn_id)")
def needs_typing(spark: SparkSession, d: str) -> DataFrame:
    """Turns of some length with fewer than three typed relations: they go to a second stage."""
    n = relations(spark, d).filter(x.entity_valid(F.col("target"))).select("turn_id", "relation", "target").distinct().groupBy("turn_id").agg(F.count("*").alias("n"))
    r = turns(spark, d).join(n, "turn_id", "left").withColumn("n_typed", F.coalesce("n", F.lit(0)))
    return r.select("turn_id", "n_typed", ((F.col("n_typed") < 3) & (F.length("content") >= 60)).alias("needed"))


# "My X is Name" in the text as written: a role's word is an alias, any other word waits for review.
_MINE = "My ([a-z]+) is ([A-Z][^.!?;,]+)"
_PEOPLE = "mine as (select distinct lower(regexp_extract(content, '" + _MINE + "', 1)) as alias, " + clean("regexp_extract(content, '" + _MINE + "', 2)") + " as canonical from (select unnest(" + SENTENCES + ") as content from turns) where regexp_matches(content, '" + _MINE + "'))"


def _mine(spark: SparkSession, d: str) -> DataFrame:
    s = turns(spark, d).select(F.explode(x.sentences(F.col("content"))).alias("s")).filter(F.col("s").rlike(_MINE))
    return s.select(F.lower(F.regexp_extract("s", _MINE, 1)).alias("alias"), x.entity(F.regexp_extract("s", _MINE, 2)).alias("canonical")).distinct()


@query("role_aliases", f"with {TURNS}, {_PEOPLE} select alias, canonical from mine where alias in {tuple(x._ROLES.split('|'))}")
def role_aliases(spark: SparkSession, d: str) -> DataFrame:
    return _mine(spark, d).filter(F.col("alias").isin(*x._ROLES.split("|")))


@query("role_review", f"with {TURNS}, {_PEOPLE} select alias, count(*) as n from mine where alias not in {tuple(x._ROLES.split('|'))} group by alias")
def role_review(spark: SparkSession, d: str) -> DataFrame:
    """Words for people that are no known role, for somebody to look at."""
    return _mine(spark, d).filter(~F.col("alias").isin(*x._ROLES.split("|"))).groupBy("alias").agg(F.count("*").alias("n"))


@query("graph_index", f"with {TURNS}, {SENT}, {REL} select 'user' as src, relation, target as dst, max(type) as type, count(distinct turn_id) as n_evidence from rl where {VALID} group by relation, target")
def graph_index(spark: SparkSession, d: str) -> DataFrame:
    r = relations(spark, d).filter(x.entity_valid(F.col("target")))
    return r.groupBy("relation", F.col("target").alias("dst")).agg(F.max("type").alias("type"), F.count_distinct("turn_id").alias("n_evidence")).withColumn("src", F.lit("user"))


def cases(value: str, table: dict) -> str:
    return f"case {value} " + " ".join(f"when {lit(k)} then {v}" for k, v in table.items()) + " end"


def day_of(y: str, m: str, d: str) -> str:
    return f"(try_cast(printf('%04d-%02d-%02d', ({y})::int, ({m})::int, ({d})::int) as date) - date '1970-01-01')"


def _got(p: str, i: int) -> str:
    return f"regexp_extract(low, {lit(p)}, {i})"


TODAY = NOW // 86400
_SHORT = {m[:3]: i for i, m in enumerate(x._MONTHS, 1)}
_LASTS = f"{cases(_got(x.LASTS, 2), x.UNIT_DAYS)} * try_cast({_got(x.LASTS, 1)} as int)"
_UNTIL = f"{day_of(f'coalesce(try_cast(trim({_got(x.UNTIL, 3)}) as int), 2024)', cases(_got(x.UNTIL, 2), _SHORT), f'try_cast({_got(x.UNTIL, 1)} as int)')} - {TODAY}"


@query("suggest_expiry", f"with {TURNS}, {SENT}, f as (select turn_id, low, {KIND} as category from sent) select turn_id, category, case when category not in {x.DURABLE} then coalesce(case when {_LASTS} > 0 then {_LASTS} end, {_UNTIL}, case category when 'context_note' then 30 when 'event' then 180 when 'goal' then 180 else 90 end) end as days from f where category is not null")
def suggest_expiry(spark: SparkSession, d: str) -> DataFrame:
    s = turns(spark, d).select("turn_id", F.explode(x.sentences(F.col("content"))).alias("s")).withColumn("low", F.lower("s")).withColumn("category", x.fact(F.col("low"))["category"]).filter("category is not null")
    return s.select("turn_id", "category", x.expiry_days(F.col("low"), F.col("category"), t.TTL_DAYS, TODAY).alias("days"))


def _past(m: str, d: str) -> str:
    this, last = day_of("year(date '1970-01-01' + day::int)", m, d), day_of("year(date '1970-01-01' + day::int) - 1", m, d)
    return f"case when {this} > day then {last} else {this} end"


_LEX = ", ".join(f"('{w}', '{k}', {v})" for w, (k, v) in x.LEXICON.items())
_ONTO = "(day - pv2 * pv1)"
#: Readings (rank, day) of a token by its neighbours: p before, n behind; w words, k kinds, v values.
_READ = f"""case when w = 'on' and nk1 = 'month' and dom <> '' then [1, {_past('nv1', 'dom')}] when regexp_matches(w, {lit(x.FEAST)}) and nw1 = 'day' then [2, {_past(*map(str, x.FEAST_DAY))}]
  when w = 'yesterday' then case when pw3 = 'the' and pw2 = 'day' and pw1 = 'before' then [3, day - 2] else [4, day - 1] end when w = 'weekend' and pw1 in ('past', 'previous', 'last') then [5, day - ((day + 3) % 7 + 1) % 7]
  when w = 'ago' and pk1 = 'unit' and pk2 = 'number' then case when pk3 = 'weekday' and pw4 = 'the' and pv1 in (7, 30) then [6, {_ONTO} - (({_ONTO} + 3 - pv3) % 7 + 7) % 7] when pv2 <= {x.MOST_AGO} then [7, day - pv2 * pv1] end
  when w = 'last' and nk1 = 'weekday' then [8, day - case when ((day + 3) % 7 - nv1 + 7) % 7 = 0 then 7 else ((day + 3) % 7 - nv1 + 7) % 7 end] when w = 'last' and nw1 in ('week', 'month', 'year') then [9, day - nv1] end"""
_NEAR = ", ".join(f"{f}({c}, {n}) over t as {p}{a}{n}" for p, f, cs in (("p", "lag", "wkv"), ("n", "lead", "wkv")) for a in cs for c in ({"w": "w", "k": "kind", "v": "value"}[a],) for n in ((1, 2, 3, 4) if p == "p" else (1, 2)))


READ_LEX = f"lex(word, kind, value) as (values {_LEX})"


def dated_sql() -> str:
    """``dated`` (turn_id, day) from ``l`` (turn_id, day, low) and ``lex``: the reading that counts, its day perhaps null."""
    number = "regexp_matches(w, '^[0-9]{1,9}$')"
    return f"""o as (select turn_id, day, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select turn_id, day, regexp_extract_all(low, {lit(x.DATE_TOKEN)}) as ws from l)),
  tok as (select turn_id, day, w, i, coalesce(lex.kind, case when {number} then 'number' end) as kind, coalesce(lex.value, case when {number} then w::int end)::bigint as value from o left join lex on w = word),
  near as (select *, {_NEAR} from tok window t as (partition by turn_id order by i)), dom as (select *, regexp_extract(nw2, '^([0-9]{{1,2}})(st|nd|rd|th)?$', 1) as dom from near), rd as (select turn_id, i, {_READ} as got from dom),
  dated as (select turn_id, got[2] as day from rd where got is not null qualify row_number() over (partition by turn_id order by got[1], i) = 1)"""


@query("resolve_date", f"""with {TURNS}, l as (select turn_id, {TODAY} - turn_id % 400 as day, lower(content) as low from turns), {READ_LEX}, {dated_sql()} select turn_id, day::bigint as day from dated where day is not null""")
def resolve_date(spark: SparkSession, d: str) -> DataFrame:
    """What a turn's first date phrase points to from the day it was said."""
    r = turns(spark, d).select("turn_id", x.resolved_day(F.lower("content"), (F.lit(TODAY) - F.col("turn_id") % 400).cast("int")).cast("long").alias("day"))
    return r.filter("day is not null")


@query("alias_resolve", f"with {TURNS}, al as (select distinct lower(n_name) as alias, 'nation:' || n_name as canonical from nation) select turn_id, list_sort(list(distinct canonical)) as canonicals from turns join al on contains(lower(content), alias) group by turn_id")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Names behind the aliases that a text holds; the alias side is sent while its size is within the bound."""
    al = t.read(spark, d, "nation").select(F.lower("n_name").alias("alias"), F.concat(F.lit("nation:"), "n_name").alias("canonical"))
    j = turns(spark, d).join(ranking.sent(al), F.contains(F.lower("content"), F.col("alias")))
    return j.groupBy("turn_id").agg(F.array_sort(F.collect_set("canonical")).alias("canonicals"))


@query("token_jaccard", """with w as (select chain_id, memory_id, doc_id, list_distinct(list_filter(string_split_regex(lower(content), '[^a-z0-9'']+'), lambda w: w <> '')) as ws from mem)
  select a.memory_id as a, b.memory_id as b, round(case when len(list_distinct(list_concat(a.ws, b.ws))) > 0 then len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))::double else 0 end, 6) as jaccard from w a join w b on a.chain_id = b.chain_id and a.doc_id < b.doc_id""", "mem")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of the versions of each chain."""
    m = t.mem(spark, d).select("chain_id", "doc_id", "memory_id", ranking.word_set(F.col("content")).alias("ws"))
    a, b = m.toDF("chain_id", "a_doc", "a", "a_ws"), m.toDF("chain_id", "b_doc", "b", "b_ws")
    return a.join(b, "chain_id").filter("a_doc < b_doc").select("a", "b", F.round(ranking.jaccard(F.col("a_ws"), F.col("b_ws")), 6).alias("jaccard"))


@query("candidate_dedup", """with p as (select distinct category, trim(content) as content, coalesce(user_scope, '') as scope from candidates where status = 'pending'), n as (select category, trim(content) as content, coalesce(user_scope, '') as scope, min(candidate_id) as candidate_id from candidates where status <> 'pending' group by all)
  select candidate_id, category, scope from n where not exists (select 1 from p where p.category = n.category and p.content = n.content and p.scope = n.scope)""", "mem", "candidates")
def candidate_dedup(spark: SparkSession, d: str) -> DataFrame:
    c = t.candidates(spark, d)
    return proposals.new_candidates(c.filter("status <> 'pending'"), c.filter("status = 'pending'")).select("candidate_id", "category", "scope")


DECIDED = f"""cd as (select *, {LOW} as low from candidates), dc as (select candidate_id, status, cd.confidence, case when len({HARD_LIST}) > 0 then 'quarantine' when e.session_id is null then 'confirm' when {LABEL} is not null then 'confirm'
   when {_SENSITIVE_SQL} then 'confirm' when cd.confidence < 0.85e0 then 'confirm' else 'approve' end as decision from cd left join evidence e on e.memory_id = 'mem-' || cd.doc_id)"""


def decisions(spark: SparkSession, d: str) -> DataFrame:
    e = t.evidence(spark, d).select(F.col("memory_id").alias("e_id"), F.col("session_id").alias("proof"))
    c = t.candidates(spark, d).withColumn("low", x.low()).join(e, F.concat(F.lit("mem-"), "doc_id") == F.col("e_id"), "left")
    return c.withColumn("decision", proposals.decide(F.col("confidence"), x.flags(F.col("low"), among=x.HARD), x.identifier(F.col("low")), F.col("proof"), sensitive()))


@query("auto_review", f"with {DECIDED} select candidate_id, decision from dc where status in ('pending', 'reviewed_approved', 'pending_user_confirmation')", "mem", "messages", "evidence", "candidates")
def auto_review(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).filter(F.col("status").isin(*proposals.OPEN)).select("candidate_id", "decision")


@query("review_fold", f"with {DECIDED} select case when status in ('pending', 'reviewed_approved', 'pending_user_confirmation') then case decision when 'approve' then 'reviewed_approved' when 'confirm' then 'pending_user_confirmation' else 'quarantined' end else status end as status, count(*) as n from dc group by 1", "mem", "messages", "evidence", "candidates")
def review_fold(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by status after the automatic decisions; closed ones do not move."""
    after, _ = proposals.review(t.candidates(spark, d), decisions(spark, d).select("candidate_id", "decision"))
    return after.groupBy("status").agg(F.count("*").alias("n"))


@query("proposal_packs", "select chain_id as cluster, count(*) as n, sum(length(content[1:300]))::bigint as n_chars from mem where status = 'active' group by chain_id", "mem")
def proposal_packs(spark: SparkSession, d: str) -> DataFrame:
    m = t.mem(spark, d).filter("status = 'active'").withColumn("cluster", F.col("chain_id"))
    packs = proposals.packs(m)
    lengths = F.from_json("pack", "array<struct<memory_id:string,content:string>>")
    return packs.select("cluster", "n", F.aggregate(lengths, F.lit(0).cast("long"), lambda s, v: s + F.length(v["content"])).alias("n_chars"))


@query("source_check", "select e.memory_id, m.memory_id is not null as known from edges e left join mem m using (memory_id) group by all", "mem", "edges")
def source_check(spark: SparkSession, d: str) -> DataFrame:
    """Ids that the graph cites, and whether the store has them."""
    cited = t.edges(spark, d).select("memory_id").distinct()
    return cited.join(t.mem(spark, d).select("memory_id", F.lit(True).alias("k")), "memory_id", "left").select("memory_id", F.coalesce("k", F.lit(False)).alias("known"))


@query("recall_grouped", """with h as (select category, case when length(content) < 100 then 'short' when length(content) <= 500 then 'medium' else 'long' end as size, status = 'active' as hit from mem)
  select category, size, count(*) as n, round(avg(hit::int), 6) as share from h group by grouping sets ((), (category), (size))""", "mem")
def recall_grouped(spark: SparkSession, d: str) -> DataFrame:
    """A share overall, by category and by length, as grouping sets."""
    n = F.length("content")
    size = F.when(n < 100, "short").when(n <= 500, "medium").otherwise("long")
    h = t.mem(spark, d).select("category", size.alias("size"), (F.col("status") == "active").cast("int").alias("hit"))
    return h.groupingSets([[], [F.col("category")], [F.col("size")]], "category", "size").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("share"))


@query("event_windows", """select floor(epoch(ts) / 3600)::bigint as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly tumbling counts; the streaming job of the same name keeps them up to date."""
    e = t.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.floor(F.unix_timestamp("w.start") / 3600).alias("hour"), "event_type", "n", "total")


@query("event_sessions", """with o as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) > interval '30 minutes', true)::int as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts, new desc rows unbounded preceding) as s from o)
  select user_id, floor(epoch(min(ts)))::bigint as began, count(*) as n from s group by user_id, s""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Activity sessions that end after half an hour of rest."""
    e = t.read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("b"))
    return s.select("user_id", F.floor(F.unix_micros("b") / 1000000).alias("began"), "n")
