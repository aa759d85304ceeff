"""Toxic passages as maximum-scoring segments.

Learning: words of a bounded sample of labelled rows are counted by class in Spark; a word's score is the
log-odds of its toxic against its clean rate, both with an informative Dirichlet prior (the corpus rate of
the word times ``PRIOR`` words), less a constant so that clean text drifts downward.

Scoring: one linear scan finds every maximal scoring segment of a text (Ruzzo and Tompa); words below zero
are bridged by running sums, so only runs of positive words are visited.  Each segment's score becomes a
p-value by extreme-value statistics (Karlin and Altschul): lambda solves sum p(s) exp(lambda s) = 1 over the
clean words' scores, K comes from the clean sample's maxima.  A text's evidence is the sum over its
significant segments of their log p-values corrected for its length; a logistic fit on the other half of
the sample turns evidence into a probability.

Defined results: null or empty text has no word and gets the score of no evidence; rows with null label or
null doc_id are not learned from; a table with one class only gives every text that class's share; repeated
rows count each time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .pretoken import portions

#: Labelled rows that learning reads at most, give or take the hash's chance.
SAMPLE_ROWS = 12_000
#: Words kept by the model: seen in so many sampled texts at least.
MIN_TEXTS = 4
PRIOR = 500.0
DRIFT = 0.5
#: A segment counts when its expected number in clean text of that length is below this.
E_VALUE = 0.5
WORDS = re.compile(r"[^\W_]+")


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end exclusive, score) of a sequence, in linear time."""
    positive = scores > 0
    if not positive.any():
        return []
    edge = np.diff(positive.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate(([0.0], np.cumsum(scores)))
    # candidates on a stack: (begin, end, sum before, sum after, nearest earlier candidate with a smaller sum before)
    stack: list[list] = []
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        left, right = float(total[b]), float(total[e])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([b, e, left, right, j])
                break
            b, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b, e, r - l) for b, e, l, r, _ in stack]


def karlin_lambda(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share * exp(x * values) = 1, for scores with a negative mean."""
    low, high = 0.0, 1.0
    f = lambda x: float((share * np.exp(np.minimum(x * values, 700))).sum()) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


class Model:
    """Word scores, extreme-value constants and the logistic calibration."""

    def __init__(self, scores: dict[str, float], other: float, lam: float, k: float):
        self.scores, self.other, self.lam, self.k = scores, other, lam, k
        self.base, self.slope, self.bonus = 0.0, 1.0, 0.0

    def passages(self, text: str) -> list[tuple[int, int, float, float]]:
        """Significant segments: (first word, end word, score, expected number in clean text)."""
        get, other = self.scores.get, self.other
        s = np.array([get(w, other) for w in WORDS.findall(text.lower())])
        out = []
        for b, e, x in segments(s):
            expect = self.k * len(s) * math.exp(-self.lam * x)
            if expect < E_VALUE:
                out.append((b, e, x, expect))
        return out

    def evidence(self, text: str) -> tuple[float, int]:
        found = self.passages(text)
        return sum(-math.log(max(expect, 1e-300)) for *_, expect in found), len(found)

    def probability(self, evidence: float, n: int) -> float:
        z = self.base + self.slope * math.log1p(evidence) + self.bonus * math.log1p(n)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def sampled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of about ``rows`` labelled rows; the broadcast side has that bound."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int"))
    share = min(1.0, rows / max(1, known.count()))
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / 1_000_000
    return docs.select("doc_id", "text").join(F.broadcast(known.filter(part < share)), "doc_id")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        count: tuple[Counter, Counter] = (Counter(), Counter())
        texts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            w = WORDS.findall((text or "").lower())
            count[bool(toxic)].update(w)
            texts[bool(toxic)].update(set(w))
        words = list(count[0].keys() | count[1].keys())
        cols = [words, *([c[w] for w in words] for c in (*count, *texts))]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["word", "n0", "n1", "t0", "t1"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample: half of it for word scores, half for calibration."""
    some = materialize(sampled(docs, labels, rows), "labelled")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2))
    words = some.filter(fold == 0).mapInArrow(_word_counts, "word string, n0 long, n1 long, t0 long, t1 long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "t0", "t1")))
    words = materialize(words, "words")
    totals = words.agg(F.sum("n0"), F.sum("n1")).first()
    total = [float(x or 0) for x in totals]
    kept = words.filter(F.col("t0") + F.col("t1") >= MIN_TEXTS).toLocalIterator()
    scores, clean_scores, clean_share = {}, [], []
    every = max(1.0, sum(total))
    for r in kept:
        # prior: the word's own corpus rate, worth PRIOR words
        a = PRIOR * (r["n0"] + r["n1"]) / every
        s = math.log((r["n1"] + a) / (total[1] + PRIOR)) - math.log((r["n0"] + a) / (total[0] + PRIOR)) - DRIFT
        scores[r["word"]] = s
        clean_scores.append(s)
        clean_share.append(r["n0"])
    model = Model(scores, -DRIFT, 1.0, 1.0)
    if not min(total) or not scores:
        share = some.agg(F.avg("toxic")).first()[0]
        model.base, model.slope = math.log((share or 0) * 0.98 + 0.01) - math.log(1 - (share or 0) * 0.98 - 0.01), 0.0
        return model
    v, p = np.array([*clean_scores, -DRIFT]), np.array([*clean_share, max(0.0, total[0] - sum(clean_share))], float)
    model.lam = karlin_lambda(v, p / p.sum())
    # K from the clean maxima: the mean of lambda * max - ln n is ln K plus Euler's constant
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bound.value
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                s = np.array([m.scores.get(w, m.other) for w in WORDS.findall((text or "").lower())])
                if len(s) >= 20:
                    out.append(m.lam * max((x for *_, x in segments(s)), default=0.0) - math.log(len(s)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["x"])

    mean = some.filter((fold == 1) & (F.col("toxic") == 0)).select("text").mapInArrow(maxima, "x double").agg(F.percentile_approx("x", 0.5)).first()[0]
    if mean is not None:
        model.k = min(10.0, max(1e-6, math.exp(mean - 0.3665)))
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def evidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = [bound.value.evidence(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in e], pa.float64()), pa.array([n for _, n in e], pa.int32()), b.column("toxic")], ["e", "n", "y"])

    fit = some.filter(fold == 1).select("text", "toxic").mapInArrow(evidences, "e double, n int, y int").collect()
    _calibrate(model, [(r["e"], r["n"], r["y"]) for r in fit])
    return model


def _calibrate(model: Model, rows: list[tuple[float, int, int]]) -> None:
    """Newton steps of a lightly penalised logistic regression on log1p(evidence) and log1p(segments)."""
    if not rows:
        return
    x = np.array([[1.0, math.log1p(e), math.log1p(n)] for e, n, _ in rows])
    y = np.array([v for *_, v in rows], float)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + np.array([0, 0.1, 0.1]) * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.1, 0.1])
        w -= np.linalg.solve(h, g)
    model.base, model.slope, model.bonus = map(float, w)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, passages (first word:end word, comma-joined) of every text."""
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bound.value
        for keys, texts in portions(batches):
            p, spans = [], []
            for t in texts:
                found = m.passages(t)
                p.append(m.probability(sum(-math.log(max(f[3], 1e-300)) for f in found), len(found)))
                spans.append(",".join(f"{b}:{e}" for b, e, *_ in found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(spans)], ["doc_id", "score", "predicted", "passages"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int, passages string")
