"""The search language: grammar, malformed queries, and random queries against reading every message."""

from __future__ import annotations

import random

import pytest

from memspark.operators import querying, sessions

AND, OR, NOT = querying.AND, querying.OR, querying.NOT


@pytest.mark.parametrize(
    ("query", "program"),
    [
        ("a b", [0, 1, AND]), ("a b OR c", [0, 1, AND, 2, OR]), ("a NOT b c", [0, 1, 2, AND, NOT]), ("a AND b NOT c OR d", [0, 1, 2, NOT, AND, 3, OR]), ("a NOT b NOT c", [0, 1, NOT, 2, NOT]),
        ("(a OR b) c", [0, 1, OR, 2, AND]), ("a a", [0, 0, AND]), ('"a  b"* c', [0, 1, AND]), ("  a\n", [0]),
    ],
)
def test_grammar(query, program):
    assert querying.compile_query(query)[1] == program


def test_leaves():
    assert querying.compile_query('Foo-bar* "x ""y""" not') == ([(("foo", "bar"), True), (("x", "y"), False), (("not",), False)], [0, 1, AND, 2, AND])


@pytest.mark.parametrize("query", [None, "", " ", "AND", "a AND", "OR a", "NOT a", "a NOT", "a AND OR b", "(a", "a)", "()", '"a', '""', "!!", "a (NOT b)", "(" * 60 + "a" + ")" * 60])
def test_malformed(query):
    assert querying.compile_query(query) is None


def by_hand(query, words):
    found = querying.compile_query(query)
    if not found:
        return False
    leaves, program = found

    def leaf(terms, prefix):
        last = lambda w, t: w.startswith(t) if prefix else w == t
        return any(words[i : i + len(terms) - 1] == list(terms[:-1]) and last(words[i + len(terms) - 1], terms[-1]) for i in range(len(words) - len(terms) + 1))

    stack = []
    for code in program:
        if code >= 0:
            stack.append(leaf(*leaves[code]))
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(a and b if code == AND else a or b if code == OR else a and not b)
    return stack[0]


def test_search_is_reading_every_message(spark):
    r = random.Random(8)
    vocabulary = ["ab", "abc", "b", "ba", "c", "été"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(9))) for _ in range(150)] + ["ab, ab ab!", "", None, "Été-ABC"]
    messages = spark.createDataFrame(list(enumerate(texts)), "message_id long, content string")
    part = lambda: r.choice([r.choice(vocabulary), r.choice(vocabulary)[0] + "*", f'"{r.choice(vocabulary)} {r.choice(vocabulary)}"', f'"{r.choice(vocabulary)} a"*', "ab ab ab", f"({r.choice(vocabulary)} OR {r.choice(vocabulary)})"])
    asked = [f" {r.choice(['AND', 'OR', 'NOT', ''])} ".join(part() for _ in range(r.randrange(1, 4))) for _ in range(60)] + [None, "(", "été abc", '"ab ab"', "NOT ab"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {tuple(x) for x in querying.search(queries, querying.positional_index(messages)).collect()}
    words = [[w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()] for t in texts]
    assert got == {(q, m) for q, text in enumerate(asked) for m, w in enumerate(words) if by_hand(text, w)}


def test_no_queries_or_messages(spark):
    none = spark.createDataFrame([], "query_id long, query string")
    index = querying.positional_index(spark.createDataFrame([], "message_id long, content string"))
    assert querying.search(none, index).collect() == []
    assert querying.search(spark.createDataFrame([(1, "a")], none.schema), index).collect() == []


def test_surroundings_and_rebinding(spark):
    messages = spark.createDataFrame([(s, t, s * 100 + t) for s in (1, 2) for t in range(9)] + [(3, 0, 300)], "session_id long, turn long, message_id long")
    hits = spark.createDataFrame([(7, 1, 104, 1), (7, 2, 200, 2), (8, 3, 300, 1)], "query_id long, root long, message_id long, pos int")
    got = {(r["query_id"], r["message_id"]): r for r in sessions.with_surroundings(hits, messages, 1, 2).collect()}
    assert (got[7, 104]["around"], got[7, 104]["opening"], got[7, 104]["closing"], got[7, 104]["before"], got[7, 104]["after"]) == ([103, 104, 105], [100, 101], [107, 108], 3, 3)
    assert (got[7, 200]["around"], got[7, 200]["opening"], got[7, 200]["closing"]) == ([200, 201], [], [207, 208])
    assert (got[8, 300]["around"], got[8, 300]["opening"], got[8, 300]["closing"], got[8, 300]["after"]) == ([300], [], [], 0)
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "session_id long, root long")
    anchors = spark.createDataFrame([(1, 104), (1, 200), (1, 300), (1, 999), (9, 104)], "session_id long, message_id long")
    assert {(r[0], r[1]): r[3] for r in sessions.rebind(anchors, messages, roots).collect()} == {(1, 104): "own", (1, 200): "rebound", (1, 300): "foreign", (1, 999): "missing", (9, 104): "missing"}
