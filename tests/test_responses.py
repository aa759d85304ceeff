"""Model answers: one row of each fault, and what remains."""

from __future__ import annotations

import json

from memspark.operators import responses

FENCE = "```"


def answers(spark, *raw):
    return spark.createDataFrame([(f"r{i}", "c1", r) for i, r in enumerate(raw)], "answer_id string, cluster string, raw string")


def shown(spark):
    return spark.createDataFrame([("c1", "m1"), ("c1", "m2"), ("c1", "m2"), ("c2", "m3")], "cluster string, memory_id string")


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_answers_that_cannot_be_read(spark):
    a = answers(spark, None, "  ", f"{FENCE}json\n{FENCE}", '{"facts": [', "12", '"facts"', '{"facts": []} and more', '{"facts": []}, {"facts": []}', '{"facts": []}], [{"facts": []}', '{"facts": []}} x', '{"facts": "none", "insights": null}', "null", "sorry, no JSON")
    got = responses.split(a, shown(spark))
    assert rows(got.faults, "answer_id", "part", "reason") == sorted(
        [(f"r{i}", "answer", "empty") for i in (0, 1, 2)] + [(f"r{i}", "answer", "not JSON") for i in (3, 6, 7, 8, 9, 12)]
        + [(f"r{i}", "answer", "no object or list") for i in (4, 5, 11)] + [("r10", "facts", "no list")]
    )
    assert got.facts.isEmpty() and got.relations.isEmpty() and got.decisions.isEmpty() and got.contradictions.isEmpty()


def test_facts(spark):
    facts = [
        {"content": " likes tea ", "category": "preference", "confidence": 3, "tags": ["A", " ", None, "b", "c", "d", "e", "f"]}, {"content": "tea?"}, {"content": "likes coffee", "category": "odd", "confidence": "high", "durability": "Temporary", "tags": "One"},
        "text", None, {"content": "knows both", "sources": ["m1", "m9", "m1", "m3"]}, {"content": "made up", "sources": ["m9"]}, {"content": "minus one", "confidence": -1, "sources": []}, {"content": {"a": 1}, "confidence": "nan"},
    ]
    got = responses.split(answers(spark, f"{FENCE}json\n{json.dumps(facts)}\n{FENCE}"), shown(spark))
    assert rows(got.facts, "pos", "category", "content", "confidence", "durability", "tags", "sources") == [
        (0, "preference", "likes tea", 1.0, "durable", ["a", "b", "c", "d", "e"], None), (2, "context_note", "likes coffee", 0.45, "temporary", ["one"], None), (5, "context_note", "knows both", 0.45, "durable", [], ["m1"]),
        (7, "context_note", "minus one", 0.0, "durable", [], None), (8, "context_note", '{"a":1}', 0.45, "durable", [], None),
    ]
    assert rows(got.faults, "pos", "reason") == [(1, "short"), (3, "no object"), (4, "no object"), (6, "invented ids")]


def test_relations_decisions_contradictions(spark):
    doc = {
        "relations": [{"target": "the Oslo Bank", "relation": "Works For"}, {"source": "User", "target": "oslo bank", "relation": "works-for"}, {"target": "it"}, {"source": "!", "target": "Bergen"}, {"source": "Anna", "target": "Bergen", "relation": "", "target_type": "town"}],
        "decisions": [{"id": "m1", "action": "Keep"}, {"id": "m1", "action": "drop"}, {"id": "m3", "action": "keep"}, {"id": "m2", "action": "burn"}, {"id": "m2", "action": "merge"}, {"action": "keep"}],
        "contradictions": [{"a_id": "m1", "b_id": "m2", "reason": "r" * 300}, {"a_id": "m1", "b_id": "m3", "reason": "other cluster"}, {"a_id": "m1", "b_id": "m2", "reason": " "}, {"a_id": "m1"}],
    }
    got = responses.split(answers(spark, json.dumps(doc)), shown(spark))
    assert rows(got.relations, "pos", "source", "relation", "target", "target_type") == [(0, "user", "works_for", "oslo bank", "organization"), (4, "anna", "related_to", "bergen", "town")]
    assert rows(got.decisions, "pos", "id", "action") == [(0, "m1", "keep"), (4, "m2", "merge")]
    assert rows(got.contradictions, "pos", "content") == [(0, "Possible contradiction between m1 and m2: " + "r" * 140)]
    assert rows(got.faults, "part", "pos", "reason") == [
        ("contradictions", 1, "invented ids"), ("contradictions", 2, "no reason"), ("contradictions", 3, "invented ids"), ("decisions", 1, "repeated"), ("decisions", 2, "invented ids"), ("decisions", 3, "unknown action"), ("decisions", 5, "invented ids"),
        ("relations", 1, "repeated"), ("relations", 2, "bad target"), ("relations", 3, "no source"),
    ]


def test_candidates_once(spark):
    doc = {"insights": [{"content": "sleeps late", "confidence": "Low"}, {"content": "sleeps late"}, {"content": "is pending"}, {"content": "x" * 300, "sources": ["m2"]}], "guardrails": [{"content": "sleeps late"}], "contradictions": [{"a_id": "m1", "b_id": "m2", "reason": "no"}], "facts": [{"content": "no candidate"}]}
    pending = spark.createDataFrame([("insight", " is pending ", None)], "category string, content string, user_scope string")
    a = answers(spark, json.dumps(doc))
    got = responses.emitted(responses.split(a, shown(spark)), shown(spark), pending)
    found = rows(got, "category", "content", "n_sources")
    assert found == [("context_note", "Possible contradiction between m1 and m2: no", 2), ("context_note", "sleeps late", 2), ("insight", "sleeps late", 2), ("insight", "x" * 200, 1)]
    assert rows(got, "candidate_id") == rows(responses.emitted(responses.split(a, shown(spark)), shown(spark), pending), "candidate_id")
    none = responses.split(a.limit(0), shown(spark))
    assert none.faults.isEmpty() and responses.emitted(none, shown(spark), pending).isEmpty()
