"""Boolean search with a query language: terms, prefixes, phrases, AND, OR, NOT, parentheses, over a positional index.

* ``a b`` asks for both; ``AND``, ``OR`` and ``NOT`` (a without b) are written in capitals, other spellings are terms;
* ``"a b"`` is a phrase, and so is a word that has several terms, like ``a-b``; ``a*`` and ``"a b"*`` end in a prefix;
* words side by side bind closest, then NOT, then AND, then OR, each to the left; parentheses group;
* a query is malformed, and matches nothing, if it is null or empty, has an operator without both sides, an open quote
  or parenthesis, a part without a letter or digit, or more than ``DEPTH`` parentheses inside each other.

A query becomes leaves (lists of terms) and a program in postfix order.  All leaves of all queries meet the index by
equi-joins, and the program runs on the set of leaves that a message matched, inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import materialize
from .sessions import terms

AND, OR, NOT = -1, -2, -3
DEPTH = 50
_PART = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\*?)|([()])|([^\s()"]+))')
LEAVES = "array<struct<leaf:int,terms:array<string>,prefix:boolean>>"


class _Malformed(Exception):
    pass


def _parts(query: str) -> list[tuple[str, object]]:
    """(kind, value): an operator or parenthesis, or a leaf (terms, whether the last is a prefix)."""
    out, at, query = [], 0, query.rstrip()
    while at < len(query):
        m = _PART.match(query, at)
        if not m:
            raise _Malformed
        at = m.end()
        quoted, star, bracket, word = m.groups()
        if bracket or word in ("AND", "OR", "NOT"):
            out.append((bracket or word, None))
            continue
        # the index's own terms: letters and the ten digits
        raw = quoted if word is None else word
        found = tuple("".join(c if c.isalpha() or c in "0123456789" else " " for c in raw.lower()).split())
        if not found:
            raise _Malformed
        out.append(("leaf", (found, bool(star) if word is None else word.endswith("*"))))
    return out


def compile_query(query: str | None) -> tuple[list[tuple[tuple[str, ...], bool]], list[int]] | None:
    """(leaves, program) of a query, None if it is malformed.  A program has leaf numbers and operators in postfix order."""
    leaves: list[tuple[tuple[str, ...], bool]] = []
    program: list[int] = []
    levels = (("OR", OR), ("AND", AND), ("NOT", NOT))

    def binary(level: int, at: int, depth: int) -> int:
        if level == len(levels):
            return row(at, depth)
        word, code = levels[level]
        at = binary(level + 1, at, depth)
        while at < len(parts) and parts[at][0] == word:
            at = binary(level + 1, at + 1, depth)
            program.append(code)
        return at

    def row(at: int, depth: int) -> int:
        """Parts side by side."""
        many = 0
        while at < len(parts) and parts[at][0] in ("leaf", "("):
            if parts[at][0] == "leaf":
                if parts[at][1] not in leaves:
                    leaves.append(parts[at][1])
                program.append(leaves.index(parts[at][1]))
                at += 1
            else:
                if depth == DEPTH:
                    raise _Malformed
                at = binary(0, at + 1, depth + 1)
                if at == len(parts) or parts[at][0] != ")":
                    raise _Malformed
                at += 1
            many += 1
            if many > 1:
                program.append(AND)
        if not many:
            raise _Malformed
        return at

    try:
        parts = _parts(query or "")
        if binary(0, 0, 0) != len(parts):
            raise _Malformed
    except _Malformed:
        return None
    return leaves, program


def compiled(queries: DataFrame) -> DataFrame:
    """(query_id, ok, leaves, program) of queries (query_id, query)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [compile_query(q) for q in b["query"]]
            leaves = [[{"leaf": i, "terms": list(t), "prefix": p} for i, (t, p) in enumerate(f[0])] if f else [] for f in found]
            yield pd.DataFrame({"query_id": b["query_id"], "ok": [f is not None for f in found], "leaves": leaves, "program": [f[1] if f else [] for f in found]})

    return queries.select("query_id", "query").mapInPandas(run, f"query_id long, ok boolean, leaves {LEAVES}, program array<int>")


def positional_index(messages: DataFrame) -> DataFrame:
    """(term, message_id, places): where each term stands in each message, from 0."""
    words = messages.select("message_id", F.posexplode(terms(F.col("content"))).alias("place", "term"))
    return words.groupBy("term", "message_id").agg(F.array_sort(F.collect_list("place")).alias("places"))


def _holds(program: Column, leaves: Column) -> Column:
    """The program's value for a set of matched leaves."""
    empty = F.array().cast("array<boolean>")

    def step(stack: Column, code: Column) -> Column:
        left, right = F.get(stack, F.size(stack) - 2), F.get(stack, F.size(stack) - 1)
        value = F.when(code == AND, left & right).when(code == OR, left | right).otherwise(left & ~right)
        return F.when(code >= 0, F.concat(stack, F.array(F.array_contains(leaves, code)))).otherwise(F.concat(F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 2, F.lit(0))), F.array(value)))

    return F.get(F.aggregate(program, empty, step), F.lit(0))


def search(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, message_id): the messages that each well-formed query (query_id, query) matches in a ``positional_index``."""
    q = materialize(compiled(queries).filter("ok"))
    leaf = q.select("query_id", F.explode("leaves").alias("l")).select("query_id", "l.leaf", "l.prefix", F.size("l.terms").alias("n"), F.posexplode("l.terms").alias("i", "asked"))
    open_ = F.col("prefix") & (F.col("i") == F.col("n") - 1)
    exact = leaf.filter(~open_).select("query_id", "leaf", "n", "i", F.col("asked").alias("term"))
    # a prefix meets the vocabulary's beginnings of its own length
    begins = leaf.filter(open_)
    sizes = [r[0] for r in begins.select(F.length("asked")).distinct().collect()]
    if sizes:
        vocabulary = index.select("term").distinct().select("term", F.explode(F.array(*map(F.lit, sizes))).alias("size")).filter(F.length("term") >= F.col("size"))
        vocabulary = vocabulary.select("term", F.substr("term", F.lit(1), F.col("size")).alias("asked"))
        exact = exact.unionByName(begins.join(vocabulary, "asked").select("query_id", "leaf", "n", "i", "term"))
    hits = exact.join(index, "term")
    words = hits.filter("n = 1").select("query_id", "leaf", "message_id")
    starts = hits.filter("n > 1").select("query_id", "leaf", "n", "i", "message_id", F.explode("places").alias("place")).withColumn("start", F.col("place") - F.col("i"))
    phrases = starts.groupBy("query_id", "leaf", "n", "message_id", "start").agg(F.count_distinct("i").alias("met")).filter("met = n").select("query_id", "leaf", "message_id")
    met = words.unionByName(phrases).groupBy("query_id", "message_id").agg(F.collect_set("leaf").alias("met"))
    return met.join(q.select("query_id", "program"), "query_id").filter(_holds(F.col("program"), F.col("met"))).select("query_id", "message_id")
