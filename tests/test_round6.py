"""Findings of round 3, last part: what a run of probes makes once, and only where it is needed."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from memspark.functions import text as x
from memspark.functions import vectors
from memspark.operators import probing, ranking
from memspark.plans import probes

SF = "/root/testdata/sf0.001"


def test_run_makes_words_of_asked_and_near_facts_only(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def counted(text):
        seen.add(1)
        return sorted(set(text.split()))

    monkeypatch.setattr(probing, "word_set", counted)
    f = spark.createDataFrame([(f"m{i}", i, "one two three four" if i < 2 else f"text {i}") for i in range(60)], "memory_id string, chain_id long, content string")
    e = spark.createDataFrame([(1, "m0"), (2, "m0"), (3, "m5")], "query_id long, memory_id string")
    h = spark.createDataFrame([(1, "m1", 0.9, 1), (2, "m1", 0.9, 97), (2, "m9", 0.8, 98), (3, "m1", 0.5, 2)], "query_id long, memory_id string, score double, rank int")
    got = {r["query_id"]: (r["rank"], r["wide_rank"], r["top_ids"]) for r in probing.run(e, f, h).collect()}
    assert got == {1: (1, None, ["m1"]), 2: (None, None, []), 3: (None, None, ["m1"])}
    assert seen.value <= 4


def test_alike_at_the_edge(spark):
    """Three of four words in common are alike, whichever set is the larger; sets of no words are not."""
    texts = {"a": "a b c d", "b": "a b c", "c": "a b c d e", "d": "a b c d e f", "e": "", "f": "a b c x"}
    f = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(texts.items())], "memory_id string, chain_id long, content string")
    e = spark.createDataFrame([(1, "a"), (2, "e")], "query_id long, memory_id string")
    for hit, near in {"b": True, "c": True, "d": False, "e": False, "f": False}.items():
        h = spark.createDataFrame([(1, hit, 0.5, 3), (2, "a", 0.5, 1)], "query_id long, memory_id string, score double, rank int")
        got = {r["query_id"]: r["rank"] for r in probing.run(e, f, h).collect()}
        assert got == {1: 3 if near else None, 2: None}, hit


def test_verdict_makes_each_leg_once(spark, monkeypatch):
    made = []

    def counted(module, name):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: made.append(name) or real(*a, **k))

    counted(ranking, "keyword_scores")
    counted(ranking, "top_k")
    counted(vectors, "top_k")
    assert probes.regression_verdict(spark, SF).count() == len(probes.PAIRS)
    assert sorted(made) == ["keyword_scores", "top_k"]


def test_questions_are_made_once(spark):
    """Dealing templates in turn moves rows by number and order; what the questions cost is paid once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def asks(i):
        seen.add(1)
        return [f"q{i}", None, None, None, f"n{i}", None]

    rows = spark.range(500).select(F.format_string("m%03d", "id").alias("memory_id"), asks("id").alias("asks"))
    got = {r["memory_id"]: r["probe"] for r in probing.in_turn(rows, F.col("memory_id").desc(), block=64).collect()}
    assert got == {f"m{i:03}": f"{'qn'[(499 - i) % 2]}{i}" for i in range(500)}
    assert seen.value == 500


def test_the_beginning_of_a_text_gives_its_questions(spark, monkeypatch):
    """Where only the first words are looked at, all questions are those of the whole text."""
    rnd = random.Random(6)
    pool = ["the", "The,", "und", "(Los)", "u-n-d", "of", "a", "is", "I", "car's", "red", "boat", "x" * 50, "été", "--", "3.5", "ΟΔΟΣ", "und7-blue-green", "house", "tree", "KK", "İs"]
    texts = [rnd.choice(["", " ", "\n"]) + "".join(w + rnd.choice([" ", " ", "  ", "\n", "\t "]) for w in rnd.choices(pool[rnd.randrange(3) * 5 :], k=rnd.randrange(60))) for _ in range(300)]
    texts += ["word " * 40, "the " * 40, "a" * 300, " " * 200 + "the end", "one two three four " + "x" * 200 + " the"]
    rows = spark.createDataFrame([(i, t, "preference", ["a"], 1_700_000_000) for i, t in enumerate(texts)], "id long, content string, category string, tags array<string>, created_at long")

    def made(head):
        monkeypatch.setattr(probing, "HEAD", head)
        return {r["id"]: r["asks"] for r in probing.questions(rows, probes.SYNONYMS).collect()}

    whole = made(10**9)
    assert made(30) == whole and made(90) == whole
    assert {n for a in whole.values() for n, q in enumerate(a) if q} == {0, 2, 3, 4, 5}


def test_date_phrases_at_the_edges(spark):
    """Anchors at both ends of a text, several of them, and marks of the feast; 19,800 is a Monday."""
    want = {
        "yesterday": 19799, "ago": None, "2 days ago": 19798, "on march": None, "on march 3rd on": 19785, "the day before yesterday": 19798, "imago": None, "last": None, "last monday": 19793,
        "on time, last week": 19793, "the monday 2 weeks ago": 19786, "valentine's day": 19767, "past weekend": 19799, "on march 40 yesterday": None, "previous owner said so on monday": None,
        "3 days ago and yesterday": 19799, "last year, yesterday": 19799, "a " * 500 + "day ago": 19799,
    }
    rows = spark.createDataFrame([(k, 19800) for k in want], "s string, d int")
    assert {r["s"]: r["day"] for r in rows.select("s", x.resolved_day(F.col("s"), F.col("d")).alias("day")).collect()} == want
