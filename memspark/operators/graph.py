"""The typed entity graph: evidence, types, search, removal and bounded traversal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import materialize
from .ranking import contained_terms

PERSON_KINDS = ("customer", "supplier")


def merge_evidence(edges: DataFrame) -> DataFrame:
    """One row an edge (src, relation, dst) with the sorted set of facts behind it."""
    return edges.groupBy("src", "relation", "dst").agg(F.array_sort(F.collect_set("memory_id")).alias("evidence"))


def kind(node: Column) -> Column:
    return F.substring_index(node, ":", 1)


def node_types(edges: DataFrame) -> DataFrame:
    """Type of each node; a person stays a person whatever else is said of it."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    person = F.bool_or(kind(F.col("node")).isin(*PERSON_KINDS))
    return ends.groupBy("node").agg(F.when(person, "person").otherwise(F.max(kind(F.col("node")))).alias("type"))


def visible_edges(edges: DataFrame, hidden: DataFrame) -> DataFrame:
    """Edges with at least one fact that is not ``hidden`` (memory_id), with what evidence is left."""
    left = edges.join(hidden.select("memory_id").distinct(), "memory_id", "left_anti")
    return merge_evidence(left)


def remove_evidence(merged: DataFrame, gone: DataFrame) -> DataFrame:
    """Takes facts out of evidence; an edge left without any is quarantined, not lost."""
    out = merged.withColumn("m", F.explode("evidence")).join(gone.select(F.col("memory_id").alias("g")).distinct(), F.col("m") == F.col("g"), "left")
    out = out.groupBy("src", "relation", "dst").agg(F.array_sort(F.collect_set(F.when(F.col("g").isNull(), F.col("m")))).alias("evidence"))
    return out.withColumn("status", F.when(F.size("evidence") == 0, "quarantined").otherwise("active"))


def revived(edges: DataFrame, gone: DataFrame, back: DataFrame) -> DataFrame:
    """(src, relation, dst, status) after the facts ``gone`` (memory_id) left and those of them in ``back`` came again: an
    edge is active if it has any other evidence.  Evidence stays in rows and each edge becomes one truth value."""
    left = gone.select("memory_id").distinct().join(back.select("memory_id"), "memory_id", "left_anti").withColumn("left", F.lit(True))
    return edges.join(left, "memory_id", "left").groupBy("src", "relation", "dst").agg(F.when(F.bool_or(F.col("left").isNull()), "active").otherwise("quarantined").alias("status"))


def edges_of(merged: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of the given nodes (node), in both directions."""
    out = merged.join(nodes, F.col("src") == F.col("node")).select("node", F.lit("out").alias("way"), "relation", F.col("dst").alias("other"))
    back = merged.join(nodes, F.col("dst") == F.col("node")).select("node", F.lit("in").alias("way"), "relation", F.col("src").alias("other"))
    return out.unionByName(back)


def search_edges(merged: DataFrame, terms: DataFrame) -> DataFrame:
    """Edges with a term (query_id, term) inside either end's name, case-insensitively."""
    ends = merged.select(F.col("src").alias("node")).union(merged.select("dst")).distinct().withColumn("text", F.lower("node"))
    named = contained_terms(terms, ends).join(ends, "text").join(terms, "term").select("query_id", "term", "node")
    one = merged.join(named, F.col("src") == F.col("node")).drop("node")
    two = merged.join(named, F.col("dst") == F.col("node")).drop("node")
    return one.unionByName(two).dropDuplicates(["query_id", "term", "src", "relation", "dst"])


def lexical_scores(merged: DataFrame, terms: DataFrame) -> DataFrame:
    """Facts for query terms through the graph: two points for each edge and term that names them."""
    found = search_edges(merged, terms).withColumn("memory_id", F.explode("evidence"))
    return found.groupBy("query_id", "memory_id").agg((2 * F.count("*")).alias("score"))


def traverse(merged: DataFrame, seeds: DataFrame, depth: int, relations: list[str]) -> DataFrame:
    """(query_id, memory_id, score): facts on typed edges reached from seeds (query_id, node), nearer ones weigh more.

    Breadth first; a node is visited once a query.  A hop of weight 2, later hops of weight 1.  An edge is its
    source, relation and target, so a -> b and b -> a each bring their own evidence.
    """
    typed = merged.filter(F.col("relation").isin(relations))
    edge = ["src", "relation", "dst"]
    ways = typed.select(F.col("src").alias("from"), F.col("dst").alias("to"), "evidence", *edge).unionByName(typed.select(F.col("dst").alias("from"), F.col("src").alias("to"), "evidence", *edge))
    ways = materialize(ways)
    frontier = visited = materialize(seeds.select("query_id", "node").distinct())
    scores = None
    for hop in range(1, depth + 1):
        step = frontier.join(ways, F.col("node") == F.col("from")).select("query_id", "to", "evidence", *edge)
        # an edge inside the frontier is met from both ends and counts once
        part = step.dropDuplicates(["query_id", *edge]).withColumn("memory_id", F.explode("evidence")).groupBy("query_id", "memory_id").agg((F.count("*") * (2 if hop == 1 else 1)).alias("score"))
        scores = part if scores is None else scores.unionByName(part)
        if hop < depth:
            frontier = materialize(step.select("query_id", F.col("to").alias("node")).distinct().join(visited, ["query_id", "node"], "left_anti"))
            visited = visited.unionByName(frontier)
    return scores.groupBy("query_id", "memory_id").agg(F.sum("score").alias("score"))


def seeds(terms: DataFrame, types: DataFrame, concepts: list[str], hubs: list[str], least: int = 2) -> DataFrame:
    """(query_id, node): nodes whose name holds a term (query_id, term), hubs left out; of queries that name at least
    ``least`` nodes that are no ``concepts``, since broad ones lead everywhere.  ``types`` is (node, type)."""
    names = types.filter(~F.col("node").isin(hubs)).withColumn("text", F.lower(F.substring_index("node", ":", -1)))
    found = contained_terms(terms, names).join(names, "text").join(terms, "term").select("query_id", "node", "type").distinct()
    found = materialize(found)
    named = found.groupBy("query_id").agg(F.count_if(~F.col("type").isin(concepts)).alias("n")).filter(F.col("n") >= least)
    return found.join(named, "query_id", "left_semi").select("query_id", "node")


def bounded_traverse(edges: DataFrame, start: DataFrame, depth: int, relations: list[str], frontier: int = 40, visited: int = 200) -> DataFrame:
    """(query_id, memory_id, score): facts on typed edges met from ``start`` (query_id, node), hop by hop.

    From one hop to the next go the ``frontier`` nodes that most of the hop's edges lead to, by name where equal, and
    never more than ``visited`` nodes a query in all; of the start, the first by name.  The first hop's edges weigh 2,
    later ones 1.  Evidence stays in rows (edge, fact), so an edge with any number of facts is no larger than another.
    """
    edge = ["src", "relation", "dst"]
    typed = materialize(edges.filter(F.col("relation").isin(relations)).select(*edge, "memory_id").distinct())
    one = typed.select(*edge).distinct()
    ways = materialize(one.select(F.col("src").alias("from"), F.col("dst").alias("to"), *edge).unionByName(one.select(F.col("dst").alias("from"), F.col("src").alias("to"), *edge)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("node"))
    front = seen = materialize(start.select("query_id", "node").distinct().withColumn("place", place).filter(F.col("place") <= min(frontier, visited)).select("query_id", "node"))
    scores = []
    for hop in range(1, depth + 1):
        step = materialize(front.join(ways, F.col("node") == F.col("from")).select("query_id", "to", *edge))
        met = step.select("query_id", *edge).distinct()
        scores.append(materialize(met.join(typed, edge).groupBy("query_id", "memory_id").agg((F.count("*") * (2 if hop == 1 else 1)).alias("score"))))
        if hop == depth:
            break
        held = seen.groupBy("query_id").agg(F.count("*").alias("held"))
        ranked = Window.partitionBy("query_id").orderBy(F.desc("n"), "node")
        new = step.groupBy("query_id", F.col("to").alias("node")).agg(F.count("*").alias("n")).join(seen, ["query_id", "node"], "left_anti")
        new = new.withColumn("place", F.row_number().over(ranked)).join(held, "query_id").filter(F.col("place") <= F.least(F.lit(frontier), F.lit(visited) - F.col("held")))
        front = materialize(new.select("query_id", "node"))
        seen = seen.unionByName(front)
    return reduce(DataFrame.unionByName, scores).groupBy("query_id", "memory_id").agg(F.sum("score").alias("score"))


def neighbourhood(merged: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, distance) of all nodes within ``depth`` hops."""
    ways = merged.select(F.col("src").alias("from"), F.col("dst").alias("to")).union(merged.select("dst", "src")).distinct()
    ways = materialize(ways)
    out = frontier = materialize(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance")).distinct())
    for hop in range(1, depth + 1):
        new = frontier.join(ways, F.col("node") == F.col("from")).select("seed", F.col("to").alias("node")).distinct()
        frontier = materialize(new.join(out.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(hop)))
        out = out.unionByName(frontier)
    return out


def rebuild(edges: DataFrame, current: DataFrame) -> DataFrame:
    """Edges made anew from the facts that are ``current`` (memory_id): what a cleared scope holds after re-indexing."""
    return merge_evidence(edges.join(current.select("memory_id").distinct(), "memory_id", "left_semi"))


def junk_nodes(edges: DataFrame, longest: int = 80, most_words: int = 6) -> DataFrame:
    """Nodes whose name is no name: too short, too long, too many words, or letter-number codes."""
    # written, or the rules would run on both ends of every edge
    ends = materialize(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    name = F.substring_index("node", ":", -1)
    reason = F.when(F.length(name) <= 2, "short").when(F.length(name) >= longest, "long").when(F.size(F.split(name, " ")) >= most_words, "words").when(name.rlike("^[a-z][0-9]+$"), "code").when(name.rlike("#0*[0-9]*00$"), "round")
    return ends.withColumn("reason", reason).filter("reason is not null")
