"""Model answers as tables: one parse to VARIANT, then facts, relations, decisions, contradictions and what was refused.

An answer is (answer_id, cluster, raw): JSON, perhaps between code fences.  Its root is an object with lists under the names
of ``PARTS``, or a bare list whose items are facts or relations by their fields.  ``shown`` holds (cluster, memory_id), the
facts that the model saw; other ids count as invented.

Every item ends either in one of the tables or in ``faults`` with a reason; an answer that can't be read is one fault.
Nulls, empty texts, text behind the JSON and wrong types of any field have such a reason, and no field makes a job fail.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as x
from memspark.sources.tables import CATEGORIES

from .iterate import materialize
from .proposals import new_candidates

PARTS = ("facts", "insights", "guardrails", "relations", "decisions", "contradictions")
# Bounds and defaults of the fields.
LEAST, MOST, TAGS = 5, 200, 5
EXTRACTED, DISTILLED, UNSURE = 0.45, 0.7, 0.5
UNSURE_WORDS = ("low", "low confidence", "uncertain")
DURABILITY, ACTIONS = ("durable", "permanent", "temporary"), ("drop", "keep", "merge")

_TEXTS = ("content", "category", "confidence", "durability", "source", "relation", "target", "target_type", "id", "action", "a_id", "b_id", "reason")


@dataclass
class Answers:
    """What a set of answers says, each a table keyed by (answer_id, pos)."""

    facts: DataFrame  # part, category, content, confidence, durability, tags, sources (null: the whole cluster)
    relations: DataFrame  # source, relation, target, target_type
    decisions: DataFrame  # id, action
    contradictions: DataFrame  # a_id, b_id, content
    faults: DataFrame  # part, reason


def unfenced(raw: Column) -> Column:
    """An answer without the code fences around it."""
    bare = F.regexp_replace(raw, r"^\s+|\s+$", "")
    return F.when(bare.startswith("```"), F.regexp_replace(bare, r"^```[A-Za-z]*\s*|\s*```$", "")).otherwise(bare)


def parsed(answers: DataFrame) -> DataFrame:
    """``answers`` with ``doc`` (VARIANT, null if unreadable) and ``fault``.

    The parser stops where a value ends, so the text is parsed inside a list and inside an object: only a text that is one
    whole value passes both.  Texts are written once without their fences, for the tables and the faults both read them.
    """
    bare = materialize(answers.select("answer_id", "cluster", F.coalesce(unfenced(F.col("raw")), F.lit("")).alias("text")))
    text = F.col("text")
    listed, boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    one = (F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1) & boxed.isNotNull()
    found = bare.select("answer_id", "cluster", "text", F.when(one, F.try_variant_get(listed, "$[0]", "variant")).alias("doc"))
    kind = F.schema_of_variant("doc")
    fault = F.when(F.col("text") == "", "empty").when(F.col("doc").isNull(), "not JSON").when(~(kind.startswith("OBJECT") | kind.startswith("ARRAY")), "no object or list")
    return found.withColumn("fault", fault)


def items(read: DataFrame) -> DataFrame:
    """One row an item: answer_id, cluster, part, pos, is_object, the fields as texts, tags and sources as arrays."""

    def listed(path: str, part: Column) -> Column:
        rows = F.try_variant_get("doc", path, "array<variant>")
        return F.coalesce(F.transform(rows, lambda v, i: F.struct(part.alias("part"), i.alias("pos"), v.alias("item"))), F.array().cast("array<struct<part:string,pos:int,item:variant>>"))

    every = F.concat(*(listed(f"$.{p}", F.lit(p)) for p in PARTS), listed("$", F.lit("list")))
    rows = read.filter("fault is null").select("answer_id", "cluster", F.explode(every).alias("e")).select("answer_id", "cluster", "e.*")
    texts = [F.trim(F.try_variant_get("item", f"$.{n}", "string")).alias(n) for n in _TEXTS]
    arrays = [F.coalesce(F.try_variant_get("item", f"$.{n}", "array<string>"), F.array_compact(F.array(F.try_variant_get("item", f"$.{n}", "string")))).alias(n) for n in ("tags", "sources")]
    out = rows.select("answer_id", "cluster", "part", "pos", F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False)).alias("is_object"), *texts, *arrays)
    bare = F.when(F.col("target").isNotNull(), "relations").otherwise("facts")
    return out.withColumn("part", F.when(F.col("part") == "list", bare).otherwise(F.col("part")))


def _fault(*cases: tuple[Column, str]) -> Column:
    return F.coalesce(F.when(~F.col("is_object"), F.lit("no object")), *(F.when(c, F.lit(r)) for c, r in cases))


def confidence(part: Column, told: Column) -> Column:
    """A number from 0 to 1; words and missing values give the part's default, words of doubt a low one."""
    distilled = F.when(F.lower(told).isin(*UNSURE_WORDS), UNSURE).otherwise(DISTILLED)
    number = told.try_cast("double")
    return F.when(part != "facts", distilled).when(number.isNull() | F.isnan(number), EXTRACTED).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def split(answers: DataFrame, shown: DataFrame) -> Answers:
    """The tables that ``answers`` hold; ids are held against those shown in the answer's own cluster by joins."""
    read = parsed(answers)
    rows = materialize(items(read))
    seen = shown.select(F.col("cluster").alias("_c"), F.col("memory_id").alias("_m")).distinct()
    key = ["answer_id", "part", "pos"]

    def known(df: DataFrame, name: str) -> DataFrame:
        """``df`` with ``<name>_known``: whether the id was shown."""
        s = seen.withColumn(f"{name}_known", F.lit(True))
        return df.join(s, (F.col("cluster") == F.col("_c")) & (F.col(name) == F.col("_m")), "left").drop("_c", "_m").withColumn(f"{name}_known", F.coalesce(f"{name}_known", F.lit(False)))

    # facts: cited ids that were shown stay; a fact that cites only others is refused
    f = rows.filter(F.col("part").isin(*PARTS[:3]))
    cited = f.select(*key, "cluster", F.explode(F.array_distinct("sources")).alias("cited"))
    kept = known(cited, "cited").groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("cited_known"), F.col("cited")))).alias("known"), F.count("*").alias("n_cited"))
    f = f.join(kept, key, "left")
    none = (F.col("n_cited") > 0) & (F.size("known") == 0)
    f = f.withColumn("fault", _fault((F.length(F.coalesce("content", F.lit(""))) < LEAST, "short"), (none, "invented ids")))
    word = F.lower("durability")
    tags = F.slice(F.filter(F.transform("tags", lambda v: F.lower(F.trim(v))), lambda v: v != ""), 1, TAGS)
    usual = F.when(F.col("part") == "insights", "insight").otherwise("context_note")
    facts = f.filter("fault is null").select(
        *key, "cluster", F.when((F.col("part") == "facts") & F.col("category").isin(*CATEGORIES), F.col("category")).otherwise(usual).alias("category"),
        F.when(F.col("part") == "facts", F.col("content")).otherwise(F.substring("content", 1, MOST)).alias("content"), confidence(F.col("part"), F.col("confidence")).alias("confidence"),
        F.when(word.isin(*DURABILITY), word).otherwise("durable").alias("durability"), tags.alias("tags"), F.when(F.size("known") > 0, F.col("known")).alias("sources"),
    )

    # relations: cleaned ends, the first of equal ones of an answer
    r = rows.filter("part = 'relations'").select(*key, "is_object", x.entity(F.coalesce("source", F.lit("user"))).alias("source"), x.slug(F.coalesce("relation", F.lit(""))).alias("relation"), x.entity(F.coalesce("target", F.lit(""))).alias("target"), F.nullif("target_type", F.lit("")).alias("target_type"))
    r = r.withColumn("fault", _fault((F.col("source") == "", "no source"), (~x.entity_valid(F.col("target")), "bad target")))
    first = Window.partitionBy("answer_id", "fault", "source", "relation", "target").orderBy("pos")
    r = r.withColumn("fault", F.when(F.col("fault").isNull() & (F.row_number().over(first) > 1), "repeated").otherwise(F.col("fault")))
    relations = r.filter("fault is null").select("answer_id", "pos", "source", "relation", "target", F.coalesce("target_type", x.entity_type(F.col("target"), "concept")).alias("target_type"))

    # decisions: the first word on an id that was shown
    d = known(rows.filter("part = 'decisions'"), "id").withColumn("action", F.lower("action"))
    d = d.withColumn("fault", _fault((~F.col("id_known"), "invented ids"), (~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown action")))
    d = d.withColumn("fault", F.when(F.col("fault").isNull() & (F.row_number().over(Window.partitionBy("answer_id", "fault", "id").orderBy("pos")) > 1), "repeated").otherwise(F.col("fault")))
    decisions = d.filter("fault is null").select("answer_id", "pos", "id", "action")

    c = known(known(rows.filter("part = 'contradictions'"), "a_id"), "b_id")
    c = c.withColumn("fault", _fault((~(F.col("a_id_known") & F.col("b_id_known")), "invented ids"), (F.coalesce("reason", F.lit("")) == "", "no reason")))
    told = F.concat(F.lit("Possible contradiction between "), "a_id", F.lit(" and "), "b_id", F.lit(": "), F.substring("reason", 1, 140))
    contradictions = c.filter("fault is null").select("answer_id", "cluster", "pos", "a_id", "b_id", F.substring(told, 1, MOST).alias("content"))

    faults = read.filter("fault is not null").select("answer_id", F.lit("answer").alias("part"), F.lit(-1).alias("pos"), F.col("fault").alias("reason"))
    for part in (f, r, d, c):
        faults = faults.unionByName(part.filter("fault is not null").select(*key, F.col("fault").alias("reason")))
    scalars = [F.when(F.try_variant_get("doc", f"$.{p}", "array<variant>").isNull() & F.try_variant_get("doc", f"$.{p}", "string").isNotNull(), F.lit(p)) for p in PARTS]
    wrong = read.filter("fault is null").select("answer_id", F.explode(F.array_compact(F.array(*scalars))).alias("part"))
    return Answers(facts, relations, decisions, contradictions, faults.unionByName(wrong.select("answer_id", "part", F.lit(-1).alias("pos"), F.lit("no list").alias("reason"))))


def emitted(found: Answers, shown: DataFrame, pending: DataFrame) -> DataFrame:
    """Candidates from insights, guardrails and contradictions: (candidate_id, category, content, confidence, n_sources).

    Of equal ones the first id stays, those pending already are left out.  A fact without cited sources rests on its whole
    cluster, and so does every contradiction; a candidate's id is a hash, so that a repeated run gives the same rows.
    """
    sizes = shown.select(F.col("cluster").alias("_c"), "memory_id").distinct().groupBy("_c").agg(F.count("*").alias("_n"))
    rows = found.facts.filter("part <> 'facts'").select("cluster", F.col("part").alias("kind"), "category", "content", "confidence", F.size("sources").alias("cited"), "answer_id", "pos")
    rows = rows.unionByName(found.contradictions.select("cluster", F.lit("contradiction").alias("kind"), F.lit("context_note").alias("category"), "content", F.lit(UNSURE).alias("confidence"), F.lit(None).cast("int").alias("cited"), "answer_id", "pos"))
    ident = F.concat(F.lit("cand-"), F.substring(F.sha2(F.concat_ws("|", F.lit("answer"), "answer_id", "kind", "pos"), 256), 1, 16))
    rows = rows.join(sizes, F.col("cluster") == F.col("_c"), "left").select(
        ident.alias("candidate_id"), "category", F.trim("content").alias("content"), "confidence", F.when(F.col("cited") > 0, F.col("cited").cast("long")).otherwise(F.coalesce("_n", F.lit(0))).alias("n_sources"), F.lit(None).cast("string").alias("user_scope")
    )
    return rows.join(new_candidates(rows, pending).select("candidate_id"), "candidate_id", "left_semi").drop("user_scope")
