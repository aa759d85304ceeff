"""The proposal queue: saving, reviewing and folding candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import materialize
from .remember import layers

# The states of a candidate.
OPEN = ("pending", "reviewed_approved", "pending_user_confirmation")
#: From which states a decision may lead where; nothing leads to ``approved`` but a person's own word.
MOVES = {"approve": "reviewed_approved", "confirm": "pending_user_confirmation", "reject": "rejected", "quarantine": "quarantined", "accept": "approved"}


def new_candidates(rows: DataFrame, pending: DataFrame) -> DataFrame:
    """``rows`` whose (category, trimmed content, scope) is not pending yet, one of each; the first id stays."""
    key = lambda: [F.col("category"), F.trim("content").alias("content"), F.coalesce("user_scope", F.lit("")).alias("scope")]
    own = rows.select("candidate_id", *key()).groupBy("category", "content", "scope").agg(F.min("candidate_id").alias("candidate_id"))
    return own.join(pending.select(*key()).distinct(), ["category", "content", "scope"], "left_anti")


def decide(confidence: Column, hard: Column, label: Column, evidence: Column, sensitive: Column, least: float = 0.85) -> Column:
    """The automatic decision, by the first rule that applies."""
    return (
        F.when(F.size(hard) > 0, "quarantine").when(evidence.isNull(), "confirm").when(label.isNotNull(), "confirm")
        .when(sensitive, "confirm").when(confidence < least, "confirm").otherwise("approve")
    )


def review(candidates: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates after the decisions, rejected decisions); a decision holds only for an open candidate."""
    d = decisions.select(F.col("candidate_id").alias("d_id"), "decision")
    both = candidates.join(d, F.col("candidate_id") == F.col("d_id"), "left")
    to = F.coalesce(*(F.when(F.col("decision") == k, F.lit(v)) for k, v in MOVES.items()))
    valid = F.col("status").isin(*OPEN) & to.isNotNull()
    after = both.withColumn("status", F.when(valid, to).otherwise(F.col("status"))).select(*candidates.columns)
    bad = both.filter(F.col("decision").isNotNull() & ~valid).select("candidate_id", "decision", "status")
    return after, bad


def packs(members: DataFrame, width: int = 300) -> DataFrame:
    """One row a cluster: its size and its facts as JSON, texts cut to ``width``."""
    item = F.struct("memory_id", F.substring("content", 1, width).alias("content"))
    return members.groupBy("cluster").agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_list(item))).alias("pack"))


def apply_review(candidates: DataFrame, decisions: DataFrame, facts: DataFrame, threshold: float = 0.85) -> DataFrame:
    """What decisions (candidate_id, actor, decision, supersedes) change: rows (kind, id, detail).

    * ``status``: the new state of a candidate; ``refused``: a decision that doesn't hold, with it.  Of several
      decisions on one candidate the first by actor and word counts, the others are refused; so is an ``accept`` by
      anyone but a person, for nothing automatic approves;
    * ``fact``: a fact made from an accepted candidate, with its category; one that equals, contains or resembles a
      current fact, or an earlier accepted candidate of this batch that makes one, ends as ``deduplicated``;
    * ``evidence``: the new fact's retention hash; ``closed``: a current fact that it supersedes, with the new id.
    """
    order = Window.partitionBy("candidate_id").orderBy("actor", "decision", "supersedes")
    every = decisions.select("candidate_id", "actor", "decision", "supersedes").withColumn("nth", F.row_number().over(order))
    allowed = (F.col("nth") == 1) & ((F.col("decision") != "accept") | (F.col("actor") == "person"))
    every = materialize(every.withColumn("allowed", F.coalesce(allowed, F.lit(False))))
    d = every.filter("allowed")
    after, bad = review(candidates, d)
    after, bad = materialize(after), materialize(bad)
    moved = candidates.join(d.select("candidate_id", "decision", "supersedes"), "candidate_id").join(bad.select("candidate_id"), "candidate_id", "left_anti")
    moved = materialize(moved.join(after.select("candidate_id", F.col("status").alias("now")), "candidate_id"))
    current = materialize(facts.filter("status = 'active' and valid_to is null"))
    columns = ["category", "content", "user_scope", "project_id"]
    new = moved.filter("now = 'approved'").select(F.col("candidate_id").alias("memory_id"), *columns, F.lit(None).cast(current.schema["embedding"].dataType).alias("embedding"), F.col("created_at").alias("ord"))
    verdicts = materialize(layers(new, current, threshold))
    moved = moved.join(verdicts.withColumnRenamed("memory_id", "candidate_id"), "candidate_id", "left")
    made = moved.filter("verdict = 'stored'").withColumn("new_id", F.concat(F.lit("mem-"), F.substring(F.sha2(F.concat(F.lit("review|"), "candidate_id"), 256), 1, 16)))
    row = lambda df, kind, ident, detail: df.select(F.lit(kind).alias("kind"), F.col(ident).alias("id"), detail.alias("detail"))
    return (
        row(moved, "status", "candidate_id", F.when(F.col("verdict") != "stored", "deduplicated").otherwise(F.col("now")))
        .unionByName(row(bad, "refused", "candidate_id", F.col("decision"))).unionByName(row(every.filter("not allowed"), "refused", "candidate_id", F.col("decision")))
        .unionByName(row(made, "fact", "new_id", F.col("category"))).unionByName(row(made, "evidence", "new_id", F.sha2(F.col("content"), 256)))
        .unionByName(row(made.join(current.select(F.col("memory_id").alias("supersedes")), "supersedes"), "closed", "supersedes", F.col("new_id")))
    )
