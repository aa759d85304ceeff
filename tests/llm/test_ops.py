"""The ten operators on small tables: brute force, nulls, empty and long texts, ties, repeats, extra columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from memspark.llm import byte_bpe, exact_dedup, jaccard_join, language_id, lm_score, mixing, pii, quality_rules, token_blocks, toxicity
from memspark.llm.pretoken import cut

random.seed(5)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "Über", "naïve"]
LONG = " ".join(random.choice(WORDS) + str(i % 97) for i in range(30_000))


def sentence(n: int) -> str:
    return " ".join(random.choice(WORDS) + random.choice(["", str(random.randint(0, 99))]) for _ in range(n))


BASE = [sentence(60) for _ in range(12)]
TEXTS = [
    *BASE, BASE[0], BASE[0].upper(), BASE[1] + " tail", BASE[1].replace(" ", "  "), BASE[2] + " a b c", BASE[2] + " a b d", None, "", " ", "\n\t", "one", "two words", "ONE", LONG, LONG + " end",
    "mail a.b+c@x.example.com or +1 (212) 555-0199, 10.0.0.256 10.0.0.255 4111 1111 1111 1111", "x\n \ny  z \n", "日本語 text \U0001f600 ok", "hello <|endoftext|> bye", "a <|endoftext|><|endoftext|>  b ",
]
IDS = list(range(100, 100 + len(TEXTS)))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s1", None][i % 3], "x", 1.5) for i, t in zip(IDS, TEXTS, strict=True)]
    rows += [(IDS[3], TEXTS[3], "en", "s0", "x", 1.5), (None, "no id", "en", "s0", None, None), (None, BASE[0], None, None, None, None)]
    # extra columns whose names the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n string, score double")


def test_a_filter_in_passes_keeps_unique_rows_where_they_are(spark, monkeypatch):
    rows = [(i, f"text number {i if i % 10 else i % 500}") for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    size = collections.Counter(t for _, t in rows)
    # three segments of 8 KB: one a pass, all at once, and more passes than there may be
    for passes, limit in ((8, 8192), (8, 1 << 20), (2, 8192)):
        monkeypatch.setattr(exact_dedup, "MAX_PASSES", passes)
        flags = {r["doc_id"]: r["maybe"] for r in exact_dedup.flag_repeats(docs, max_broadcast_bytes=limit).collect()}
        assert len(flags) == len(rows) and all(flags[i] for i, t in rows if size[t] > 1)
        # only possible repeats shuffle: of 10,800 unique rows few are among them, but where there are too many passes
        assert (sum(flags[i] for i, t in rows if size[t] == 1) <= 150) == (passes == 8)
        kept = exact_dedup.drop_duplicates(docs, max_broadcast_bytes=limit).collect()
        assert sorted(r["doc_id"] for r in kept) == sorted({t: i for i, t in reversed(rows)}.values())


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_exact_dedup(docs, empty, limit, monkeypatch):
    got = exact_dedup.duplicate_groups(docs, max_broadcast_bytes=limit).collect()
    rows = [(r["doc_id"], normal(r["text"])) for r in docs.collect()]
    size = collections.Counter(t for _, t in rows)
    first = {t: min((i for i, u in rows if u == t and i is not None), default=None) for t in size}
    want = collections.Counter((i, first[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(size)
    kept = exact_dedup.drop_duplicates(docs, max_broadcast_bytes=limit)
    assert kept.columns == docs.columns
    assert sorted(normal(r["text"]) for r in kept.collect()) == sorted(size)
    # columns with the names used inside come through as they were
    named = docs.withColumns({c: F.lit(f"own {c}") for c in ("_sha", "_maybe", "_of", "_whose", "a.b")})
    out = exact_dedup.drop_duplicates(named, max_broadcast_bytes=limit)
    assert out.columns == named.columns and {tuple(r)[-5:] for r in out.collect()} == {tuple(f"own {c}" for c in ("_sha", "_maybe", "_of", "_whose", "a.b"))}
    # groups larger than a part
    monkeypatch.setattr(exact_dedup, "GROUP_PART", 2)
    many = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    rows = [(r["doc_id"], normal(r["text"])) for r in many.collect()]
    size = collections.Counter(t for _, t in rows)
    found = exact_dedup.duplicate_groups(many, max_broadcast_bytes=limit).collect()
    assert collections.Counter((r["doc_id"], r["group_size"], r["text_sha256"]) for r in found) == collections.Counter((i, size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sum(r["kept"] for r in found) == len(size)
    assert exact_dedup.duplicate_groups(empty, max_broadcast_bytes=limit).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0


def test_near_duplicates(spark, docs, empty, monkeypatch):
    family = [BASE[5].split() for _ in range(60)]
    for i, w in enumerate(family):
        for _ in range(i % 5):
            w[random.randrange(len(w))] = f"edit{random.randint(0, 30)}"
    more = spark.createDataFrame([(1000 + i, " ".join(w), "en", "s0", "x", 0.0) for i, w in enumerate(family)], docs.schema)
    every = docs.unionByName(more)
    for width, percent in ((4, 85), (5, 80)):
        sets = collections.defaultdict(list)
        for r in every.filter("doc_id is not null").collect():
            w = words(r["text"])
            sets[r["doc_id"]].append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
        flat = [(i, s) for i, ss in sets.items() for s in ss]
        root = {i: i for i in sets}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, (i, s) in enumerate(flat):
            for j, u in flat[:a]:
                both = len(s & u)
                if both and 100 * both >= percent * (len(s) + len(u) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
        got = jaccard_join.near_duplicates(every, width, percent).collect()
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {i: find(i) for i in sets}
        # lists cut into parts of few rows, leaders into few partners
        monkeypatch.setattr(jaccard_join, "STAR_PART", 4)
        cut_up = jaccard_join.near_duplicates(every, width, percent, list_part=5).collect()
        assert collections.Counter(map(tuple, cut_up)) == collections.Counter(map(tuple, got))
        assert all(r["component_id"] is None for r in got if r["doc_id"] is None) and len(got) == every.count()
        assert all(r["n_shingles"] in [len(s) for s in sets[r["doc_id"]]] for r in got if r["doc_id"] is not None)
    assert jaccard_join.near_duplicates(empty).count() == 0
    named = every.withColumn("_gone", F.lit("own"))
    assert jaccard_join.drop_near_duplicates(named).columns == named.columns


def test_quality_rules(docs, empty):
    got = {r["doc_id"]: r for r in quality_rules.quality_filter(docs).collect()}
    for i, t in zip(IDS, TEXTS, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        count = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and (not r["kept"] or not r["base_failed"])
    assert quality_rules.quality_filter(empty).count() == 0


def exact_fences(rows: pd.DataFrame) -> dict[str, float | None]:
    """The fences of one group by exact quantiles: the smallest value with at least that share at or below it."""
    at = lambda v, q: np.sort(v)[max(0, math.ceil(q * len(v)) - 1)]
    rows = rows[~rows["base_failed"]]
    out: dict[str, float | None] = {}
    for r, step in quality_rules.RATIOS.items():
        v = rows[r][rows[r] > 0].to_numpy()
        if len(rows) < quality_rules.MIN_GROUP or len(v) < quality_rules.MIN_VALUES:
            out[r] = None
        elif len(v) <= quality_rules.RARE * len(rows) and at(v, 0.1) * at(rows["n_words"].to_numpy(), 0.5) >= quality_rules.APART * step:
            out[r] = at(v, 0.1) / 2
        else:
            out[r] = at(v, 0.75) + quality_rules.FENCE * (at(v, 0.75) - at(v, 0.25))
    return out


@pytest.mark.parametrize("most", [50_000, 0])
def test_quality_fences_follow_their_group(spark, most):
    # symbols are foreign to source a, usual in source b; c is too small for fences of its own, d's language too
    rows, r = [], random.Random(9)
    for i in range(1500):
        source, lang = ("a", "en") if i < 600 else ("b", "en") if i < 1200 else ("c", "en") if i < 1300 else ("d", "xx")
        words_ = [f"{r.choice(WORDS)}{r.randrange(10**6)}" for _ in range(r.randint(60, 120))]
        if source == "b" or i % 20 == 0:
            words_ = [w + r.choice(["", "", " |", " $$"]) for w in words_]
        rows.append((i, " ".join(words_), lang, source))
    got = quality_rules.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), max_sent_groups=most).toPandas()
    group, by_lang, whole = got.groupby(["lang", "source"]), got.groupby("lang"), exact_fences(got)
    for (lang, source), own in group:
        fine, coarse = exact_fences(own), exact_fences(by_lang.get_group(lang))
        for _, x in own.iterrows():
            fence = {k: next((f for f in (fine[k], coarse[k], whole[k]) if f is not None), math.inf) for k in quality_rules.RATIOS}
            assert sorted(x["failed"]) == sorted(k for k in fence if x[k] > fence[k]), (source, x["doc_id"])
            assert x["kept"] == (not x["base_failed"] and not len(x["failed"]))
    gone = got[got["failed"].map(lambda f: "symbol_ratio" in f)]
    # the same symbols go where they are foreign and stay where they are usual
    assert set(gone["doc_id"]) >= {i for i in range(0, 600, 20)} and not (set(gone["doc_id"]) & set(range(600, 1200)))


def test_pii_matches_the_plain_patterns(docs, empty):
    anchors = pii.automaton()
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for alphabet in ("a1.@-", "1. -", "+1 (.)-a", "12 -", "a@b.c@+%1"):
        for _ in range(2000):
            t = "".join(random.choice(alphabet) for _ in range(random.choice((3, 12, 40))))
            f = pii.find(t, anchors)
            digits = lambda m: re.sub("[^0-9]", "", m[0])
            assert f["email"] == [m.span() for m in email.finditer(t)]
            assert f["ip"] == [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
            assert f["card"] == [m.span() for m in pii.CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
            assert f["phone"] == [m.span() for m in pii.PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]
    f = pii.find("iban: GB82 WEST 1234 5698 7654 32, http://u:p4@h.com/ password=\"abc12345678\"", anchors)
    assert f["iban"] and f["login"] and f["secret"]
    assert pii.redact("call a@b.cc now", pii.find("call a@b.cc now", anchors)) == "call <email> now"
    # runs of any length are read once: a megabyte takes seconds
    for t in ("1" * 10**6, "1." * 10**6, "1.2.3." * 10**5, "+1(" * 10**5, "1 " * 10**5):
        began = time.process_time()
        pii.find(t, anchors)
        assert time.process_time() - began < 30
    # the digests are those of the plain patterns, and all added kinds are among the spans
    rows = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    for i, t in zip(IDS, TEXTS, strict=True):
        t, r = t or "", rows[i]  # noqa: PLW2901
        plain = {k: [] for k in pii.BASE_KINDS}
        plain["email"] = [m.span() for m in email.finditer(t)]
        plain["ip"] = [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        plain["card"] = [m.span() for m in pii.CARD.finditer(t) if 16 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
        plain["phone"] = [m.span() for m in pii.PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        base = ",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in plain[k])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base)
        assert r["n_found"] == len([x for x in r["spans"].split(",") if x]) and r["n_added"] == r["n_found"] - sum(len(plain[k]) for k in plain)
    made = [f"note {i}: {v} end" for i, v in enumerate(["http://bob:pw1@h.example/x", "IBAN DE89 3704 0044 0532 0130 00", "token = abcdefgh12345678", 'password: "s3cretpass"'] * 25)]
    kinds = ["login", "iban", "secret", "secret"] * 25
    assert all(pii.find(t, anchors)[k] for t, k in zip(made, kinds, strict=True))
    assert pii.find_personal_data(docs).count() == docs.count() and pii.find_personal_data(empty).count() == 0


def test_accounts_end_where_their_country_says():
    anchors = pii.automaton()
    for text, value in [
        ("IBAN ES91 2100 0418 4502 0005 1332 FROM us", "ES91 2100 0418 4502 0005 1332"), ("IBAN ES9121000418450200051332 2024", "ES9121000418450200051332"), ("IBAN is NO93 8601 1117 947, ok", "NO93 8601 1117 947"),
        ("my IBAN (GB82 WEST 1234 5698 7654 32)", "GB82 WEST 1234 5698 7654 32"), ("iban no. DE89370400440532013000.", "DE89370400440532013000"), ("iban: MT84MALT011000012345MTLCAST001S A", "MT84MALT011000012345MTLCAST001S"),
    ]:
        assert [text[a:b] for a, b in pii.find(text, anchors)["iban"]] == [value]
    for text in ("IBAN ES91 2100 0418 4502 0005 1333", "IBAN ES91210004184502000513321", "IBAN ZZ91 2100 0418 4502 0005 1332", "IBAN ES91 2100", "IBAN", "iban ES91  2100 0418 4502 0005 1332"):
        assert not pii.find(text, anchors)["iban"]
    for text, value in [("api-key = abcdefgh12345678", "abcdefgh12345678"), ("password: hunter2abc!", "hunter2abc")]:
        assert [text[a:b] for a, b in pii.find(text, anchors)["secret"]] == [value]
    assert not pii.find("password: password", anchors)["secret"] and not pii.find("password: abc1", anchors)["secret"] and not pii.find("token: hunter2abc", anchors)["secret"]


def test_secrets_of_any_length_go_whole():
    anchors = pii.automaton()
    for n in (16, 256, 257, 5000):
        value = ("eyJhbGciOi9.-_" * (n // 14 + 1))[: n - 1] + "7"
        for left, right in (("=", ""), (" : '", "'"), ('="', '"')):
            t = f"my token{left}{value}{right}; end"
            at = t.index(value)
            assert pii.find(t, anchors)["secret"] == [(at, at + n)]
            assert pii.redact(t, pii.find(t, anchors)) == f"my token{left}<secret>{right}; end"
    # a digit may come late, cues inside a value belong to it, and quotes may be open to the end
    assert pii.find("token=" + "x" * 400 + "9", anchors)["secret"] == [(6, 407)]
    assert pii.find('token="' + "token='abc12345678'" * 20 + '"', anchors)["secret"] == [(7, 387)]
    took = []
    for k in (2_000, 32_000):
        texts = ['token="' + "token='a" * k, "token=" * k, 'token="' * k, 'token="x1' * k, "token=" + "token" * k, "token:" + "token1" * k, 'token="' + "token=abcdefghijklmnop'" * k]
        began = time.process_time()
        for t in texts:
            pii.find(t, anchors)
        took.append(time.process_time() - began)
    assert took[1] < 16 * 4 * took[0] + 1


def test_byte_bpe_round_trip_and_library(docs, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    e = byte_bpe.Encoder(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    odd = ["".join(random.choice("ab \n\té\U0001f600'1s") for _ in range(n)) for n in (1, 2, 7, 40, 400) for _ in range(20)]
    # every piece at once in one queue, and again from memory
    for _ in range(2):
        assert [ids.tolist() for ids in e.encode(odd)] == [library.encode_ordinary(t) for t in odd]
    for t in [*TEXTS, *odd, "ab" * 3000, "aaab" * 120, "a" * 511, "x " * 50]:
        ids = e.encode([t or ""])[0].tolist()
        assert ids == library.encode_ordinary(t or "") and e.decode(ids) == (t or "").encode()
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect()}
    assert all(got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, library.encode_ordinary(t or ""))).encode()).hexdigest() for i, t in zip(IDS, TEXTS, strict=True))
    assert all(got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in zip(IDS, TEXTS, strict=True))
    ids = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in byte_bpe.decode_documents(ids, path, public_tokenizers.PATTERN).filter("doc_id is not null").collect()} == {i: t or "" for i, t in zip(IDS, TEXTS, strict=True)}
    assert byte_bpe.round_trip(empty, path, public_tokenizers.PATTERN).count() == 0


def test_token_blocks(docs, empty):
    r = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 3000):
        for top in (1, 2, 300, 2**32 - 1):
            v = r.integers(0, top, n, dtype=np.uint32)
            v[r.random(n) < 0.02] = r.integers(0, 2**32 - 1)
            assert (token_blocks.unpack(token_blocks.pack(v), n) == v).all()
    v = r.integers(0, 9, 1000, dtype=np.uint32)
    assert (token_blocks.unpack(token_blocks.pack(v), 1000, only=slice(1, 2)) == v[256:512]).all()
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    one = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {x["doc_id"]: x for x in token_blocks.token_files(one, path).collect()}
    start = 0
    for i, t in sorted(zip(IDS, TEXTS, strict=True)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        x = got[i]
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    # the least id is no null
    edge = docs.withColumn("doc_id", F.when(F.col("doc_id") == IDS[0], F.lit(-(2**63))).otherwise(F.col("doc_id")))
    found = collections.Counter(x["doc_id"] for x in token_blocks.token_files(edge, path).collect())
    assert found == collections.Counter(x["doc_id"] for x in edge.collect()) and found[-(2**63)] == 1 and found[None] == 2
    assert token_blocks.token_files(docs, path).count() == docs.count() and token_blocks.token_files(empty, path).count() == 0
    for t in ("a\n b", " a", " ", "x \n y\n\n z", "a  b", "b  c", "a  b"):
        p = cut(t)
        assert sum((library.encode(c, add_special_tokens=False).ids for c in [p[0], *(" " + y for y in p[1:])]), []) == library.encode(t, add_special_tokens=False).ids


def test_lm_score(spark, docs, empty, monkeypatch):
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs).collect() if r["doc_id"] is not None}
    train = [words(r["text"]) for r in docs.collect() if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1]
    count, pairs, bins = collections.Counter(), collections.Counter(), collections.Counter()
    for w in train:
        count.update([*w, None])
        pairs.update(zip([None, *w], [*w, None], strict=True))
    n, v = sum(count.values()), len(count)
    # the model by hand: weights from counts with the token itself deleted
    for w in train:
        for x, y in zip([None, *w], [*w, None], strict=True):
            context = count[x] - 1
            both, own = (lm_score._log_bins(np.array([p]))[0] for p in ((pairs[x, y] - 1) / max(context, 1), (count[y] - 1) / (n - 1)))
            bins[int(lm_score._bucket(np.array([context]))[0] * lm_score._BINS**2 + both * lm_score._BINS + own)] += 1
    weight = lm_score.weights(bins, v)

    def chance(x, y):
        w = weight[lm_score._bucket(np.array([count[x]]))[0]] * [count[x] > 0, 1, 1]
        return w @ [pairs[x, y] / max(count[x], 1), count[y] / n, 1 / (v + 1)] / w.sum()

    # contexts seen and not: what training knows and one unknown word have probability one together
    for x in (None, "alpha", "never"):
        assert sum(chance(x, y) for y in [*count, "unseen"]) == pytest.approx(1)
    for i, t in zip(IDS, TEXTS, strict=True):
        w = words(t)
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None])
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(count[x] > 0 for x in [*w, None]), n)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] == pytest.approx(sum(math.log10(chance(x, y)) for x, y in zip([None, *w], [*w, None], strict=True)))
    monkeypatch.setattr(lm_score, "RANGE_KEYS", 500)
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 700)
    again = {r["doc_id"]: r for r in lm_score.score_documents(docs).collect() if r["doc_id"] is not None}
    assert all(again[i]["score"] == pytest.approx(got[i]["score"]) and again[i]["n_known"] == got[i]["n_known"] for i in got)
    assert lm_score.score_documents(empty).count() == 0
    w = lm_score.weights({0: 10, lm_score._BINS * lm_score._BINS: 5}, 100)
    assert np.allclose(w.sum(1), 1)


def test_language_models_are_distributions(spark, docs, empty):
    m = language_id.Models({k: language_id.count_grams(v) for k, v in {"x": {"aba": 3, "abba": 2, "c": 1}, "y": {"zz": 2, "zé": 1}}.items()})
    score = language_id.Scorer(m)
    e, chars = score(["aba abba", "zz zz", "", "123"])
    assert e[0].argmin() == 0 and e[1].argmin() == 1 and list(chars[2:]) == [0, 0]
    # after any context, known or not, all characters and the end mark together have probability one
    for context in ("", "a", "ab", "abb", "abab", "q", "zzzzzz"):
        known = [np.exp2(m.characters([context + c])[0][len(context)]) for c in "abczé"]
        end, other = np.exp2(m.characters([context])[0][-1]), np.exp2(m.characters([context + "Ω"])[0][len(context)])
        assert np.allclose(sum(known) + end + other * (language_id.ALPHABET - 6), 1, atol=1e-5)
    assert language_id.LETTERS.findall("½²Ⅷ③ 12_ ab é漢字 x_y") == ["ab", "é漢字", "x", "y"]
    signs = spark.createDataFrame([(1, "½ ² Ⅷ ③ 45 _ -")], "doc_id long, text string")
    train = spark.createDataFrame([(i, " ".join(random.choice(["der", "und", "ist", "nicht"]) for _ in range(30)), "de") for i in range(60)] + [(100 + i, " ".join(random.choice(["the", "and", "is", "not"]) for _ in range(30)), "en") for i in range(60)], "doc_id long, text string, lang string")
    models = language_id.learn(train)
    got = language_id.identify(train, models).join(train.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify(signs, models).collect()] == [("und", 0.0)]
    none = {r["doc_id"]: r for r in language_id.identify(docs, models).collect()}
    assert none[IDS[TEXTS.index("")]]["lang_pred"] == "und" and none[IDS[TEXTS.index(None)]]["lang_pred"] == "und"
    assert language_id.keep_identified(docs, models).columns == docs.columns
    assert language_id.identify(empty, models).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.learn(empty)).collect()} == {"und"}


def test_languages_without_calibration_reject_nothing(spark):
    common = [(i, " ".join(random.choice(["the", "and", "is", "not"]) for _ in range(30)), "en") for i in range(60)]
    rare = [(1000 + i, " ".join(random.choice(["vuosi", "talo", "joki", "lumi"]) for _ in range(4)), "fi") for i in range(60)]
    schema = "doc_id long, text string, lang string"
    models = language_id.learn(spark.createDataFrame(common + rare, schema))
    at = {lang: i for i, lang in enumerate(models.langs)}
    assert np.isfinite(models.mean[at["en"]]) and np.isinf(models.mean[at["fi"]])
    # long clean text of the rare language, with words that its few rows don't have
    texts = ["vuosi talo joki lumi metsä järvi " * 60, "qxzvk wqjzx kkqxw " * 60, "qxzvk wqjzx", "qxzvk " * 6, "12 34", "the and is not " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(docs, models).collect()}
    assert got[0]["lang_pred"] == "fi" and not got[0]["rejected"] and not got[5]["rejected"]
    # junk that lies nearest to a calibrated language is still rejected from 40 characters on, and never below
    only = language_id.learn(spark.createDataFrame(common, schema))
    got = {r["doc_id"]: r["rejected"] for r in language_id.identify(docs, only).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False}
    assert {r["doc_id"] for r in language_id.keep_identified(docs, models).collect()} >= {0, 2, 3, 5}


def test_toxic_segments_and_model(spark, docs, empty):
    def brute(s):
        best = None
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                t = sum(s[i:j])
                if t > 1e-9 and (best is None or t > best[2] + 1e-9):
                    best = (i, j, t)
        if best is None:
            return []
        i, j, _ = best
        return [*brute(s[:i]), (i, j), *((a + j, b + j) for a, b in brute(s[j:]))]

    for _ in range(200):
        s = [random.choice([-5, -3, -2, -1, 1.25, 2, 3.75]) + random.random() * 0.1 for _ in range(random.randint(0, 18))]
        assert [(b, e) for b, e, _ in toxicity.segments(np.array(s))] == brute(s)
    rows = [(i, sentence(40) + (" idiot moron scum" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(train.drop("toxic"), train.drop("text"))
    got = toxicity.score(train.drop("toxic"), model).join(train, "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.95
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(empty, model).count() == 0
    one_class = toxicity.learn(train.drop("toxic"), train.filter("toxic = 0").drop("text"))
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score(docs, one_class).collect())


def test_mixing_meets_its_targets(spark, docs, empty):
    rows = []
    for i in range(900):
        kind = i % 3
        rows.append((i, sentence(50) + [" fine", " *** $$$ &&& junkword", " idiot moron scum"][kind] * 3, int(kind != 1), int(kind == 2)))
    t = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    text, labels = t.select("doc_id", "text"), t.select("doc_id", "quality", "toxic")
    got = pd.DataFrame([r.asDict() for r in mixing.mixing_rates(text, labels).collect()])
    totals = np.array([(got[c] * got["n_tokens"] * got["rate"]).sum() for c in mixing.columns_of(mixing.TARGETS)])
    assert np.allclose(totals / totals.sum(), list(mixing.TARGETS.values()), atol=1e-4) and (got["rate"] >= 0).all()
    first = (got["p_clean"] * got["n_tokens"]).sum()
    assert totals[0] == pytest.approx(first, rel=1e-3)
    kept = {r["doc_id"] for r in mixing.mix_documents(text, labels).collect()}
    assert np.mean([i in kept for i in range(0, 900, 3)]) > 0.97 and np.mean([i in kept for i in range(2, 900, 3)]) < 0.2
    # other domains, other targets
    other = pd.DataFrame([r.asDict() for r in mixing.mixing_rates(text, labels, {"fine": 0.5, "foul": 0.5}, F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0).otherwise(1)).collect()])
    assert np.allclose([(other[c] * other["n_tokens"] * other["rate"]).sum() for c in ("p_fine", "p_foul")], (other["p_fine"] * other["n_tokens"]).sum(), rtol=1e-3)
    assert mixing.mixing_rates(docs, labels).count() == docs.count() and mixing.mix_documents(docs, labels).columns == docs.columns
    assert mixing.mixing_rates(empty, labels.limit(0)).count() == 0


def soft_members(spark, softness, share):
    rng = np.random.default_rng(3)
    kind = rng.choice(3, 3000, p=share)
    z = np.eye(3)[kind] * 4 / softness + rng.normal(0, 1, (3000, 3))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    n = rng.integers(20, 2000, 3000)
    return p, n, spark.createDataFrame(pd.DataFrame({"n_tokens": n, **{c: p[:, k] for k, c in enumerate(mixing.columns_of(mixing.TARGETS))}})).repartition(2)


@pytest.mark.parametrize("softness", [0.6, 2.0])
def test_mixing_is_the_least_squares_fit(spark, softness):
    p, n, members = soft_members(spark, softness, [0.76, 0.14, 0.10])
    fit, got, goal = mixing.fit_rates(members)
    rates = fit.rates(p)
    assert np.allclose(p.T @ (n * rates), got) and rates.min() >= 0
    assert np.abs(got - goal).max() <= 1e-3 * goal.min()
    # no other rates that meet the targets lie nearer to 1: plain projected gradient steps on both terms, many of them
    weight = n / n.sum()
    dual = np.zeros(3)
    for _ in range(200_000):
        dual += 1.9 * (p.T @ (weight * np.maximum(0, 1 - p @ dual)) - goal / n.sum())
    slow = np.maximum(0, 1 - p @ dual)
    assert np.allclose(rates, slow, atol=2e-2)


@pytest.mark.parametrize(("softness", "share"), [(0.4, [0.76, 0.14, 0.10]), (1.0, [0.76, 0.14, 0.10]), (0.4, [0.99, 0.005, 0.005])])
def test_thinning_keeps_what_is_within_the_shares(spark, softness, share):
    p, n, members = soft_members(spark, softness, share)
    fit, shares = mixing.fit_thinning(members)
    want, rates = np.array(list(mixing.TARGETS.values())), fit.rates(p)
    assert rates.min() >= 0 and rates.max() <= 1 and (shares[1:] <= want[1:] + 1e-4).all()
    over = (p.T @ n / n.sum() > want)[1:]
    # a domain that was above its share ends at it, unless thinning another took it below; clean documents stay
    assert np.abs(shares[1:] - want[1:])[over & (fit.y[1:] > 0)].max(initial=0) < 1e-4
    assert (rates[(p <= want)[:, 1:].all(1)] == 1).all()
    if not over.any():
        assert (rates == 1).all()
    alike = members.select("n_tokens", F.lit(0.7).alias("p_clean"), F.lit(0.2).alias("p_junk"), F.lit(0.1).alias("p_toxic"))
    assert (mixing.fit_thinning(alike)[0].rates(np.array([[0.7, 0.2, 0.1]])) == 1).all()


def test_pipeline_runs_every_stage(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {n for n, _ in corpus_pipeline.STAGES} == {"language_id", "exact_dedup", "jaccard_join", "mixing", "byte_bpe"}
    assert len({r["doc_id"] for r in rows}) == len(rows)


def test_every_stage_takes_any_table(spark, docs, empty):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing names, no rows at all."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    strange = docs.withColumns({c: F.lit(f"own {c}") for c in ("_gone", "_sha", "_maybe", "c", "rate", "n_tokens", "p_clean", "part", "class_id")})
    before = {(r["doc_id"], r["text"]) for r in strange.collect()}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, strange, sf)
        rows = kept.collect()
        if name == corpus_pipeline.STAGES[-1][0]:
            assert len(rows) == strange.count()
        else:
            assert kept.columns == strange.columns and all(r["_gone"] == "own _gone" and r["rate"] == "own rate" for r in rows)
            assert {(r["doc_id"], r["text"]) for r in rows} <= before
        assert stage(spark, empty, sf).count() == 0
    texts = lambda stage: [r["text"] for r in dict(corpus_pipeline.STAGES)[stage](spark, strange, sf).collect()]
    assert sorted(map(normal, texts("exact_dedup"))) == sorted({normal(t) for _, t in before})
    left = texts("jaccard_join")
    assert BASE[1] in left and BASE[1] + " tail" not in left and None in left and "" in left


def test_pipeline_agrees_with_its_parts_by_hand(spark, tmp_path):
    """The stages' decisions on a table where each is known."""
    import corpus_pipeline

    r = random.Random(11)
    fresh = lambda n: " ".join(f"{r.choice(['the', 'and', 'of', 'to', 'house', 'river', 'market', 'winter'])}" for _ in range(n))
    texts = {i: fresh(60) for i in range(300)}
    texts[300], texts[301] = texts[0], texts[1].replace(" ", "\n")
    texts[302] = texts[2] + " end"
    texts[303], texts[304] = "", None
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 3)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    # texts without a letter go first, then copies, then near copies; all labels are clean, so mixing takes nothing
    assert set(got) == set(range(300))
    assert all(got[i]["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest() for i in got)
