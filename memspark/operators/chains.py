"""Version chains: validity, numbering, history, folds of changes and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import materialize


def backfill(old: DataFrame) -> DataFrame:
    """An older snapshot (memory_id, src, status, category, confidence, created_at) in today's columns."""
    status = F.when(F.col("status").isin("active", "quarantined"), F.col("status")).otherwise("active")
    return old.select(
        "memory_id", F.coalesce(F.nullif(F.col("src"), F.lit("")), F.lit("import")).alias("source"), status.alias("status"),
        F.when(F.col("category").isin("context_note", "event"), "temporary").otherwise("durable").alias("durability"),
        F.when(F.col("src") == "src1", 0.45).otherwise(F.col("confidence")).alias("confidence"), F.col("created_at").alias("valid_from"),
    )


def as_of_join(keyed: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows (chain_id, at) with the version valid then: equal chain, half-open range."""
    v = versions.withColumnRenamed("chain_id", "v_chain")
    inside = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at")))
    return keyed.join(v, (F.col("chain_id") == F.col("v_chain")) & inside).drop("v_chain")


def fold_feedback(signals: DataFrame, retrieved: bool = False) -> DataFrame:
    kinds = ("helpful", "dismissed", "approved") + (("retrieved",) if retrieved else ())
    return signals.groupBy("memory_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.max("at").alias("last_at"))


def rolling_latency(rows: DataFrame, key: str, at: str, ident: str, value: str, size: int = 50, least: int = 5) -> DataFrame:
    """Mean, p95 (by index) and maximum of the last ``size`` values of a key; none below ``least`` values."""
    w = Window.partitionBy(key).orderBy(at, ident).rowsBetween(1 - size, 0)
    rows = rows.withColumn("l", F.collect_list(value).over(w)).filter(F.size("l") >= least)
    place = F.greatest(F.lit(0), F.floor(F.size("l") * 0.95) - 1).cast("int")
    total = F.aggregate("l", F.lit(0.0), lambda a, x: a + x)
    return rows.select(key, ident, F.round(total / F.size("l"), 6).alias("mean_ms"), F.round(F.get(F.sort_array("l"), place), 6).alias("p95_ms"), F.round(F.array_max("l"), 6).alias("max_ms"))


def number_versions(facts: DataFrame) -> DataFrame:
    w = Window.partitionBy("chain_id")
    return facts.withColumns({"version": F.row_number().over(w.orderBy("created_at", "doc_id")).cast("long"), "versions": F.count("*").over(w), "is_current": F.col("valid_to").isNull()})


def diff_versions(facts: DataFrame) -> DataFrame:
    """Each version against the one before: changed fields, tags added and removed."""
    w = Window.partitionBy("chain_id").orderBy("doc_id")
    p = facts.withColumns({f"_{c}": F.lag(c).over(w) for c in ("content", "category", "tags")}).filter("_content is not null")
    return p.select("memory_id", (F.col("content") != F.col("_content")).alias("content_changed"), (F.col("category") != F.col("_category")).alias("category_changed"), F.array_sort(F.array_except("tags", "_tags")).alias("added"), F.array_sort(F.array_except("_tags", "tags")).alias("removed"))


def build_validity(facts: DataFrame) -> DataFrame:
    """Ordered facts of chains become versions: valid_from, valid_to, superseded_by."""
    w = Window.partitionBy("chain_id").orderBy("created_at", "doc_id")
    return facts.withColumns({"valid_from": F.col("created_at"), "valid_to": F.lead("created_at").over(w), "superseded_by": F.lead("memory_id").over(w)})


def stratified_sample(facts: DataFrame, stratum: str, size: int, seed: int) -> DataFrame:
    """``size`` rows: strata in proportion (one at least), half from the newest third of each, by seeded hash.

    Each task first keeps its own first rows of a stratum's half, so no window holds a whole stratum.
    """
    bounds = facts.groupBy(stratum).agg(F.count("*").alias("_n"), F.percentile_approx("created_at", 2 / 3).alias("_new")).withColumnRenamed(stratum, "_s")
    total = facts.count()
    rows = facts.join(bounds, F.col(stratum).eqNullSafe(F.col("_s"))).withColumns({"is_new": F.col("created_at") > F.col("_new"), "_h": F.xxhash64("memory_id", F.lit(seed)), "_task": F.pmod(F.xxhash64("memory_id"), F.lit(64))})
    quota = F.ceil(F.greatest(F.lit(1.0), F.lit(float(size)) * F.col("_n") / F.lit(float(max(total, 1)))) / 2)
    first = F.row_number().over(Window.partitionBy(stratum, "is_new", "_task").orderBy("_h", "memory_id"))
    rows = rows.withColumn("_r", first).filter(F.col("_r") <= quota)
    w = Window.partitionBy(stratum, "is_new").orderBy("_h", "memory_id")
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= quota).drop("_r", "_n", "_new", "_s", "_h", "_task")


def with_keeper_score(facts: DataFrame, signals: DataFrame) -> DataFrame:
    """The score by which the best of several duplicates is kept."""
    s = fold_feedback(signals, retrieved=True).withColumnRenamed("memory_id", "s_id")
    n = lambda c: F.coalesce(c, F.lit(0))
    score = 2 * F.col("confidence") + 3 * n("helpful") + 0.1 * n("retrieved") - 2 * n("dismissed") + F.least(F.length("content") / 1000.0, F.lit(1.0))
    return facts.join(s, F.col("memory_id") == F.col("s_id"), "left").select(*facts.columns, score.alias("score"))


def merge_payload(rows: DataFrame, defaults: dict[str, Column], column: str = "payload") -> DataFrame:
    """Default keys below a JSON object's own keys; keys sorted, nulls left out."""
    own = F.from_json(column, "map<string,string>")
    base = F.create_map(*(x for k, v in defaults.items() for x in (F.lit(k), v)))
    absent = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k) | own.isNull())
    both = F.map_concat(absent, F.coalesce(own, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    return rows.withColumn(column, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both)))))


def apply_updates(facts: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """New versions for ``changes`` (memory_id, new_id, new_content): old rows close, counters and expiry carry over."""
    c = changes.withColumnRenamed("memory_id", "c_id")
    both = facts.join(c, facts["memory_id"] == F.col("c_id"), "left")
    hit = F.col("new_id").isNotNull() & (F.col("new_content") != F.col("content"))
    old = both.withColumns({"valid_to": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("valid_to")), "superseded_by": F.when(hit, F.col("new_id")).otherwise(F.col("superseded_by"))}).select(*facts.columns)
    kinds = dict(facts.dtypes)
    fresh = both.filter(hit).withColumns({"memory_id": F.col("new_id"), "content": F.col("new_content"), "created_at": F.lit(now).cast("long"), "valid_from": F.lit(now).cast("long"), "valid_to": F.lit(None).cast(kinds["valid_to"]), "superseded_by": F.lit(None).cast("string"), "embedding": F.lit(None).cast(kinds["embedding"])})
    return old.unionByName(fresh.select(*facts.columns))


def apply_deletes(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """Deleted heads go, and the latest predecessor that stays reopens; deleted older versions are quarantined."""
    d = facts.join(gone.select("memory_id").distinct().withColumn("_gone", F.lit(True)), "memory_id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    head = F.col("valid_to").isNull()
    # a run of deleted versions that ends at a deleted head leaves the chain open before it
    run = d.filter("_gone").select("memory_id", "superseded_by")
    ends = d.filter(F.col("_gone") & head).select(F.col("memory_id").alias("head"))
    dead = heads(run).join(ends, "head", "left_semi").select(F.col("memory_id").alias("h_id"), F.lit(True).alias("h_gone"))
    d = d.join(dead, F.col("superseded_by") == F.col("h_id"), "left")
    reopen = F.coalesce("h_gone", F.lit(False)) & ~F.col("_gone")
    d = d.withColumns({"status": F.when(F.col("_gone"), "quarantined").otherwise(F.col("status")), "_was_head": head})
    d = d.filter(~(F.col("_gone") & F.col("_was_head")))
    return d.withColumns({"valid_to": F.when(~reopen, F.col("valid_to")), "superseded_by": F.when(~reopen, F.col("superseded_by"))}).select(*facts.columns)


def heads(facts: DataFrame, rounds: int = 40) -> DataFrame:
    """(memory_id, head) from superseded_by pointers by pointer doubling: log2 of the longest chain in joins.

    A pointer to an unknown id ends the chain; a cycle never ends by itself, so ``rounds`` bounds the doubling
    and a row of a cycle gets the cycle's smallest id.
    """
    known = facts.select(F.col("memory_id").alias("k"))
    p = facts.join(known, F.col("superseded_by") == F.col("k"), "left")
    p = materialize(p.select("memory_id", F.coalesce("k", "memory_id").alias("head"), F.col("memory_id").alias("least")))
    ends = p.filter("head = memory_id").select(F.col("memory_id").alias("end_id"))
    for _ in range(rounds):
        q = p.select(F.col("memory_id").alias("q_id"), F.col("head").alias("q_head"), F.col("least").alias("q_least"))
        new = p.join(q, F.col("head") == F.col("q_id"), "left").select("memory_id", F.coalesce("q_head", "head").alias("head"), F.least("least", "q_least").alias("least"), (F.col("head") != F.coalesce("q_head", "head")).alias("moved"))
        new = materialize(new)
        p = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    return p.join(ends, F.col("head") == F.col("end_id"), "left").select("memory_id", F.coalesce("end_id", "least").alias("head"))


def history(facts: DataFrame) -> DataFrame:
    h = facts.join(heads(facts), "memory_id")
    w = Window.partitionBy("head")
    return h.select("memory_id", "head", F.row_number().over(w.orderBy("valid_from", "memory_id")).cast("long").alias("version"), F.count("*").over(w).alias("versions"))


def _lines(n: DataFrame, width: int) -> DataFrame:
    """Adds ``line``: a version's number, its text cut to ``width`` (withheld where quarantined), and whether it is current."""
    body = F.when(F.col("status") == "quarantined", "[withheld]").otherwise(F.substring(F.regexp_replace("content", "\n", " "), 1, width))
    return n.withColumn("line", F.concat(F.lit("v"), "version", F.lit(": "), body, F.when(F.col("is_current"), " (current)").otherwise("")))


def _joined() -> Column:
    lines = F.array_sort(F.collect_list(F.struct("version", "line")))
    return F.array_join(F.transform(lines, lambda x: x["line"]), " | ").alias("arc")


def arcs(facts: DataFrame, width: int = 120) -> DataFrame:
    """One line a chain: its versions oldest first, withheld ones marked."""
    return _lines(number_versions(facts), width).groupBy("chain_id").agg(_joined())


def unfold(hits: DataFrame, facts: DataFrame, versions: int, tokens: int, width: int = 120) -> DataFrame:
    """(query_id, chain_id, arc): of each query's hits the first that has a history, with its newest versions.

    Versions are taken from the newest back while they are within ``versions`` and, at four characters a token, ``tokens``.
    """
    n = number_versions(facts).filter("versions > 1")
    pick = hits.join(n.select("memory_id", "chain_id"), "memory_id").groupBy("query_id").agg(F.min_by("chain_id", "rank").alias("chain_id"))
    lines = _lines(n.filter(F.col("versions") - F.col("version") < versions), width).join(pick, "chain_id")
    used = F.sum(F.length("line")).over(Window.partitionBy("query_id").orderBy(F.desc("version")))
    return lines.withColumn("used", used).filter(F.col("used") <= 4 * tokens).groupBy("query_id", "chain_id").agg(_joined())
