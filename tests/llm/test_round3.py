"""Suffix arrays and repeated strings, the prefix trie, and cross-tokenizer alignment, each against brute force."""

from __future__ import annotations

import bisect
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from memspark.llm import alignment, prefix_trie, suffix_array, suffix_dedup

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("buckets", [512, 0])
def test_suffix_arrays_and_common_prefixes(buckets, monkeypatch):
    monkeypatch.setattr(suffix_array, "BUCKETS", buckets)
    r = random.Random(1)
    texts = [bytes(r.randrange(k) for _ in range(r.randrange(60))) for k in (1, 2, 3, 5, 256) for _ in range(40)] + [b"", b"a", b"mississippi", b"\xff" * 30, b"ab" * 40]
    for b in texts:
        t = np.frombuffer(b, np.uint8)
        sa = suffix_array.suffix_array(t)
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert sa.tolist() == want
        prefixes = suffix_array.permuted_prefixes(t, sa)
        for before, at in zip([None, *want], want):
            x, y, n = b[at:], b"" if before is None else b[before:], 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            assert prefixes[at] == n


def removed_by_hand(rows, length):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = collections.Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone, end = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                for j in range(max(i, end), i + length):
                    gone[j] = 1
                end = i + length
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out[d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def repeats():
    r = random.Random(4)
    words = [r.choice("abcdefgé") * r.randint(1, 3) + r.choice("xyz") for _ in range(40)]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [sentence(60) for _ in range(4)]
    rows = []
    for i in range(120):
        t = sentence(r.randint(0, 120))
        if r.random() < 0.6:
            t += " " + r.choice(shared)[: r.randint(150, 400)] + " " + sentence(r.randint(0, 30))
        if r.random() < 0.1 and rows:
            t = r.choice(rows)[1]
        rows.append((i, t))
    return rows + [(None, None), (None, shared[0] * 2), (7, "a" * 1500), (8, ""), (9, "ab" * 700), (9, "ab" * 700), (10, " " * 199), (11, " " * 200), (12, shared[1] + "!"), (12, "日本" * 300 + shared[2])]


@pytest.mark.parametrize(("length", "options"), [(200, {}), (200, {"shard_bytes": 3000, "hot": 3}), (24, {"hot": 5}), (3, {"shard_bytes": 20000})])
def test_repeated_strings(spark, repeats, length, options):
    docs = spark.createDataFrame(repeats, "doc_id long, text string").withColumns({"h": F.lit("own"), "anchor": F.lit(1), "spans": F.lit(None)})
    got = collections.Counter(tuple(x) for x in suffix_dedup.digests(docs, length, **options).collect())
    assert got == removed_by_hand(repeats, length)


def test_repeated_strings_by_joins_and_of_nothing(spark, repeats, monkeypatch):
    docs = spark.createDataFrame(repeats, "doc_id long, text string")
    assert suffix_dedup.digests(docs.limit(0)).collect() == []
    monkeypatch.setattr(suffix_dedup, "MAX_SENT_KEYS", 0)
    assert collections.Counter(tuple(x) for x in suffix_dedup.digests(docs).collect()) == removed_by_hand(repeats, 200)


def test_sections_of_a_long_text(monkeypatch):
    b = np.frombuffer(bytes(random.Random(2).choice(b"ab") for _ in range(3000)), np.uint8)
    anchor, fresh = suffix_dedup.runs(b, 200)
    assert len(anchor) == 2801 and fresh[0]
    # a context's windows all hold their anchor at one place
    h = suffix_dedup.gram_hashes(b, 64)
    starts = np.flatnonzero(fresh).tolist()
    for i, j in zip(starts, [*starts[1:], len(anchor)]):
        place = {int(np.argmin(h[w : w + 137])) + w for w in range(i, j)}
        assert len(place) == 1


def nodes_by_hand(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [(a, b) for _, a, b in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[c][h:]
    nodes = collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    kids, leaves, saved, out = collections.Counter(k[:-1] for k in nodes if k), collections.Counter(), collections.Counter(), collections.Counter()
    for k in nodes:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
    for k, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out[min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def test_prefix_trie_in_batches(spark, monkeypatch):
    r = random.Random(3)
    rows = []
    for c in [*range(-7, 40), *range(100, 130)]:
        for t in range(r.choice([1, 2, 3, 9, 14, 30])):
            rows.append((c, r.choice([t, t, t, None, t // 2]), r.choice(["u", "a", None]) if r.random() < 0.1 else "u", r.choice(["x", "y"]) if r.random() < 0.2 else "zé"))
    rows += [(None, 1, "u", "x"), (1000, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit(9), "s": F.lit("own")})
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    assert collections.Counter(tuple(x) for x in prefix_trie.prefix_nodes(df, (1, 3, 8)).collect()) == nodes_by_hand(rows)
    assert prefix_trie.prefix_nodes(df.limit(0)).collect() == []


def test_fattest_numbers(spark):
    rows = [(a, b) for a in range(20) for b in range(a + 1, 40)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", prefix_trie.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def aligned_by_hand(rows):
    al = alignment.Aligner(A, B, 64)
    count, per = collections.Counter(), []
    for d, t in rows:
        t = t or ""
        x, y = (al.a.encode(" " + t, add_special_tokens=False).ids, al.b.encode(t)) if t else ([], [])
        raw = (" " + t).encode()
        if not t or b"".join(al.bytes_a[i] for i in x) != raw or b"".join(al.bytes_b[i] for i in y) != raw:
            per.append((d, [], [], []))
            continue
        ends = [np.cumsum([len(side[i]) for i in ids]).tolist() for side, ids in ((al.bytes_a, x), (al.bytes_b, y))]
        groups, i, j = [], 0, 0
        for c in sorted(set(ends[0]) & set(ends[1])):
            k, m = bisect.bisect_right(ends[0], c), bisect.bisect_right(ends[1], c)
            groups.append((x[i:k], y[j:m]))
            i, j = k, m
        count.update({(a, b) for u, v in groups for a in u for b in v})
        per.append((d, x, y, groups))
    top: dict = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = collections.Counter()
    for d, x, y, groups in per:
        links = [(a, b) for u, v in groups for a in u for b in v]
        said = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        out[d, len(x), len(y), len(groups), len(links), sum(count[e] == top[e[0]] for e in links), sum(count[e] for e in links), hashlib.sha256(said.encode()).hexdigest() if x else ""] += 1
    return out, collections.Counter((a, b, n, n == top[a]) for (a, b), n in count.items())


def test_alignment(spark):
    own = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(120).collect()]
    odd = [None, "", "a ▁b", "  two  spaces \n x ", " <|endoftext|> <s> z", "日本語 ﬁ", "x", " ", "a 　b", "tab\t x  y", "x\n y   z\r\n  w", "a\x00b \x85 c", "no" * 3000, "ab " * 2000]
    rows = own + [(9_000_000 + i, t) for i, t in enumerate(odd)] + [(None, "x"), own[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_a": F.lit("own"), "block": F.lit(1)}).repartition(4)
    want, pairs = aligned_by_hand(rows)
    assert collections.Counter(tuple(x) for x in alignment.align(docs, A, B, block_records=5000, fan=2).collect()) == want
    assert collections.Counter(tuple(x) for x in alignment.pair_counts(docs, A, B, block_records=5000).collect()) == pairs
    assert alignment.align(docs.limit(0), A, B).collect() == []


def test_pieces_in_sections_are_those_of_the_whole():
    text = " ".join(random.Random(6).choice(["a", "bc", "", "d\n", "é"]) for _ in range(5000))
    parts = list(alignment.sections(text, 100))
    assert len(parts) > 20 and " ".join(" ".join(p) for p in parts) == text
    assert [x for p in parts for x in p] == alignment.pieces(text)
