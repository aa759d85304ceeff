"""Mixing to target weights with soft membership.

A classifier over hashed words (log rates by domain, softened by a softmax regression), fitted on a bounded
sample of the labels table, gives every document posteriors p over the domains.  Distributed projected-gradient
least squares then finds rates r, for t the tokens of a document, that minimise

    |sum q t r - goal|^2 / (2 ridge) + sum t (r - 1)^2 / 2      with r >= 0 (and r <= 1 where rows may not repeat)

The gradient steps add up to a vector y, one number a domain, and are projected in one place (the lazy form):
rate = clip(1 - q . y).  So a round is a narrow scan with one fixed expression and an aggregate of a few numbers,
whatever came before it.  A step is the gradient scaled by G = sum q q' t over the documents whose rates are free
to move, halved until the objective gains by it; the objective is concave in y, so the fit goes on until its
gradient is below ``TOLERANCE`` of all tokens, for any data, and the targets are met up to ridge . y.

* ``mixing_rates``: q = p, goal = the targets' shares of a budget that keeps the first domain's expected total.
* ``mix_documents`` thins: q = p - share for all domains but the first, goal = 0, y >= 0.  A domain above its share
  is thinned to it, and documents with no more of any such domain than its share keep rate 1; a domain below its
  share stays so, since rows are not repeated.  A domain of which every document has more than its share can't be
  thinned to it; it is left out, and a warning says so.

Defined results: null or empty text has no tokens, gets the prior as posteriors and a rate like any other;
without labels all documents are of the first domain and rates are 1; rows with null labels are not learned
from; repeated rows get the same rate.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import held
from .common import materialize
from .wordhash import mix, shingles, word_chunks

LOG = logging.getLogger(__name__)
#: Share of tokens each domain shall have; the domains, in the order of their numbers.
TARGETS = {"clean": 0.93, "junk": 0.05, "toxic": 0.02}
#: Labelled rows that the classifier is fitted on at most, give or take the hash's chance.
SAMPLE_ROWS = 12_000
HASH_BITS = 18
#: Standard deviations from its usual count that make a word tell of a domain.
TELLING = 4.0
#: Largest component of the gradient at the end, and weight of the distance from rate 1, as shares of all tokens.
TOLERANCE = 1e-7
RIDGE = 1e-8


def columns_of(targets: dict[str, float]) -> list[str]:
    """Columns of the posteriors."""
    return [f"p_{d}" for d in targets]


def domain_of(quality: Column, toxic: Column) -> Column:
    """Number of the domain of a labelled document: toxic, else junk, else clean."""
    return F.when(toxic == 1, F.lit(2)).when(quality == 0, F.lit(1)).when((quality == 1) & (toxic == 0), F.lit(0)).cast("int")


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)


class Classifier:
    """Log rates of hashed words by domain, and a softmax regression on a text's summed evidence."""

    def __init__(self, table: np.ndarray, prior: np.ndarray):
        self.table, self.prior = table, prior
        k = len(prior)
        self.mean, self.spread = np.zeros(2 * k), np.ones(2 * k)
        self.weights = np.concatenate([prior[None, :], np.zeros((2 * k, k))])

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log rates summed over the distinct words, words) of each text."""
        sums, words = [], []
        for _, counts, hashes in word_chunks(texts):
            own, h = shingles(counts, hashes, 1)
            total = np.concatenate((np.zeros((1, len(self.prior))), np.cumsum(self.table[_bucket(h)], 0, dtype=np.float64)))
            ends = np.cumsum(own)
            sums.append(total[ends] - total[ends - own])
            words.append(counts)
        if not sums:
            return np.zeros((0, len(self.prior))), np.zeros(0, np.int64)
        return np.concatenate(sums), np.concatenate(words)

    def features(self, sums: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = np.concatenate([sums / np.sqrt(np.maximum(words, 1))[:, None], np.sign(sums) * np.log1p(np.abs(sums))], 1)
        return np.concatenate([np.ones((len(x), 1)), (x - self.mean) / self.spread], 1)

    def soften(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def regress(self, sums: np.ndarray, words: np.ndarray, y: np.ndarray, rounds: int = 2000) -> None:
        """Softmax regression by accelerated gradient steps, lightly penalised."""
        x = self.features(sums, words)[:, 1:]
        self.mean, self.spread = x.mean(0), np.maximum(x.std(0), 1e-9)
        x = self.features(sums, words)
        hot = np.eye(len(self.prior))[y]
        step = 1.0 / (0.5 * np.linalg.norm(x, 2) ** 2 / len(x) + 1e-4)
        w = ahead = self.weights
        for i in range(rounds):
            self.weights = ahead
            new = ahead - step * (x.T @ (self.soften(x) - hot) / len(x) + 1e-4 * ahead)
            ahead = new + i / (i + 3) * (new - w)
            w = new
        self.weights = w

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sums, words = self.evidence(texts)
        return self.soften(self.features(sums, words)), words


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: Column | None = None, rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on a bounded sample; half of it counts words, half fits the regression.

    ``domain`` gives the number of a labelled row's domain, in the order of ``targets``.
    """
    names, k = [f"_{d}" for d in range(len(targets))], len(targets)
    known = labels.select("doc_id", (domain_of(F.col("quality"), F.col("toxic")) if domain is None else domain).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    share = min(1.0, rows / max(1, known.count()))
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) / 1_000_000
    # the side that is sent has about `rows` rows
    some = docs.select("doc_id", "text").join(F.broadcast(known.filter(part < share)), "doc_id")
    some = materialize(some.select("doc_id", "text", "y"), "labelled")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.clear()
        table = np.zeros((1 << HASH_BITS, k), np.int64)
        texts = np.zeros(k, np.int64)
        for b in batches:
            y = b.column(1).to_numpy()
            texts += np.bincount(y, minlength=k)
            for first, counts, hashes in word_chunks(b.column(0)):
                own, h = shingles(counts, hashes, 1)
                np.add.at(table, (_bucket(h), np.repeat(y[first : first + len(counts)], own)), 1)
        at = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int64()), *(pa.array([*table[at, i], texts[i]], pa.int64()) for i in range(k))], ["bucket", *names])

    schema = "bucket long, " + ", ".join(f"{d} long" for d in names)
    counted = some.filter(fold == 0).select("text", "y").mapInArrow(count, schema).groupBy("bucket").agg(*(F.sum(d).alias(d) for d in names))
    table, texts = np.zeros((1 << HASH_BITS, k)), np.zeros(k)
    for r in counted.toLocalIterator():  # at most 2 ** HASH_BITS rows
        if r[0] < 0:
            texts += np.array(r[1:], float)
        else:
            table[r[0]] = r[1:]
    if not texts.sum():
        return Classifier(np.zeros((1 << HASH_BITS, k), np.float32), np.log(np.array([1.0, *[1e-12] * (k - 1)])))
    # each domain's rates have the corpus rate, worth 2,000 words, as prior
    corpus = (table.sum(1) + 0.5) / (table.sum() + 0.5 * len(table))
    rates = (table + 2000 * corpus[:, None]) / (table.sum(0) + 2000)
    # words whose count in a domain is what chance gives say nothing, else their noise adds up in long texts
    usual = corpus[:, None] * table.sum(0)
    telling = np.abs(table - usual) > TELLING * np.sqrt(usual + 0.5)
    model = Classifier(np.where(telling, np.log(rates) - np.log(corpus)[:, None], 0.0).astype(np.float32), np.log((texts + 0.5) / (texts.sum() + 0.5 * k)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums, words = model.evidence(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array(words, pa.int64()), b.column(1)], ["sums", "words", "y"])

    test = some.filter(fold == 1).select("text", "y").mapInArrow(weigh, "sums array<double>, words long, y int").collect()
    if test:
        model.regress(np.array([r["sums"] for r in test]), np.array([r["words"] for r in test]), np.array([r["y"] for r in test]))
    return model


def memberships(docs: DataFrame, model: Classifier, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens and one posterior a domain."""
    names = columns_of(targets)
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, words = bound.value.posteriors(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), *(pa.array(p[:, k]) for k in range(p.shape[1]))], ["doc_id", "n_tokens", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, " + ", ".join(f"{c} double" for c in names))


class Fit:
    """Rates as a function of posteriors: clip(1 - (p - shift) . y), at most ``most``."""

    def __init__(self, y: np.ndarray, shift: np.ndarray, most: float):
        self.y, self.shift, self.most = y, shift, most

    def rates(self, p: np.ndarray) -> np.ndarray:
        return np.clip(1.0 - (p - self.shift) @ self.y, 0.0, self.most)


def ascend(members: DataFrame, names: list[str], shift: np.ndarray, goal: np.ndarray, tokens: float, most: float, free: np.ndarray, nonnegative: bool) -> tuple[Fit, np.ndarray, int]:
    """(fit, sum q t r at its rates, scans).  Only the components of y in ``free`` move."""
    k, ridge = len(names), RIDGE * tokens
    q = [F.col(c) - float(s) for c, s in zip(names, shift, strict=True)]

    def look(y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The objective in y, its gradient, and G of the documents between the bounds."""
        rate = F.lit(1.0) - sum((c * float(v) for c, v in zip(q, y, strict=True)), F.lit(0.0))
        at = members.select("n_tokens", *(c.alias(f"_q{i}") for i, c in enumerate(q)), rate.alias("_raw"))
        at = at.withColumn("_rate", F.least(F.lit(float(most)), F.greatest(F.lit(0.0), "_raw")))
        moves = F.when(F.col("_raw") == F.col("_rate"), F.col("n_tokens")).otherwise(0)
        row = at.agg(
            F.sum(F.col("n_tokens") * (F.pow(F.col("_rate") - 1, F.lit(2)) / 2 + F.col("_rate") * (F.lit(1.0) - F.col("_raw")))),
            *(F.sum(F.col(f"_q{i}") * F.col("n_tokens") * F.col("_rate")) for i in range(k)),
            *(F.sum(F.col(f"_q{i}") * F.col(f"_q{j}") * moves) for i in range(k) for j in range(k)),
        ).first()
        row = [v or 0.0 for v in row]
        got = np.array(row[1 : k + 1])
        return row[0] - goal @ y - ridge / 2 * y @ y, got, np.array(row[k + 1 :]).reshape(k, k)

    y, scans = np.zeros(k), 1
    value, got, gram = look(y)
    while True:
        slope = got - goal - ridge * y
        moves = free & ((y > 0) | (slope > 0)) if nonnegative else free
        if not moves.any() or np.abs(slope[moves]).max() <= TOLERANCE * tokens:
            break
        step = np.zeros(k)
        step[moves] = np.linalg.solve(gram[np.ix_(moves, moves)] + ridge * np.eye(moves.sum()), slope[moves])
        scale = 1.0
        while True:
            new = np.maximum(y + scale * step, 0.0) if nonnegative else y + scale * step
            after = look(new)
            scans += 1
            if after[0] >= value + 1e-4 * slope @ (new - y):
                break
            scale /= 2
            if scale * np.abs(step).max() <= 1e-12 * max(1.0, np.abs(y).max()):  # below what floats can tell
                return Fit(y, shift, most), got, scans
        y, (value, got, gram) = new, after
    return Fit(y, shift, most), got, scans


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS) -> tuple[Fit, np.ndarray, np.ndarray]:
    """(fit, expected totals, target totals) for posteriors and tokens in ``members``; rates are >= 0.

    The token budget keeps the expected total of the first domain.
    """
    names = columns_of(targets)
    want = np.array(list(targets.values()), float) / sum(targets.values())
    have = np.array([v or 0.0 for v in members.agg(*(F.sum(F.col(c) * F.col("n_tokens")) for c in names)).first()])
    goal = want * have[0] / max(want[0], 1e-9)
    rates, got, scans = ascend(members, names, np.zeros(len(want)), goal, have.sum(), float("inf"), np.full(len(want), bool(have.sum())), False)
    LOG.info("mixing: %d scans, shares %s, largest residual %.2e of the tokens", scans, (got / max(got.sum(), 1.0)).round(6).tolist(), np.abs(got - goal).max() / max(have.sum(), 1.0))
    return rates, got, goal


def fit_thinning(members: DataFrame, targets: dict[str, float] = TARGETS) -> tuple[Fit, np.ndarray]:
    """(fit, token shares left) with rates between 0 and 1, as near to 1 as the targets' upper shares allow."""
    names = columns_of(targets)
    want = np.array(list(targets.values()), float) / sum(targets.values())
    row = members.filter("n_tokens > 0").agg(F.sum("n_tokens"), *(F.min(c) for c in names)).first()
    tokens, least = float(row[0] or 0), np.array([1.0 if v is None else v for v in row[1:]])
    free = (least <= want) & (np.arange(len(want)) > 0) & (tokens > 0)
    if tokens and not free[1:].all():
        LOG.warning("mixing: every document has more than its share of %s", [d for d, f in zip(targets, free, strict=True) if not f][1:])
    rates, got, scans = ascend(members, names, want, np.zeros(len(want)), tokens, 1.0, free, True)
    left = members.select("n_tokens", *names, _rate_column(rates, names).alias("_rate")).agg(*(F.sum(F.col(c) * F.col("n_tokens") * F.col("_rate")) for c in names)).first()
    shares = np.array([v or 0.0 for v in left])
    shares /= max(shares.sum(), 1e-300)
    LOG.info("mixing: %d scans, shares %s", scans, shares.round(6).tolist())
    return rates, shares


def _rate_column(fit: Fit, names: list[str]) -> Column:
    away = sum(((F.col(c) - float(s)) * float(v) for c, s, v in zip(names, fit.shift, fit.y, strict=True)), F.lit(0.0))
    return F.least(F.lit(float(fit.most)), F.greatest(F.lit(0.0), F.lit(1.0) - away))


def copies(rate: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whole copies of each document: its rate's whole part, and one more by a coin from its id."""
    coin = (mix(ids.astype(np.int64).view(np.uint64) ^ np.uint64(0x5DEECE66D)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return (np.floor(rate) + (coin < rate - np.floor(rate))).astype(np.int64)


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, a posterior a domain, rate and copies of each row of ``docs``."""
    names = columns_of(targets)
    members = materialize(memberships(docs, fit(docs, labels, targets, domain), targets), "members")
    found, _, _ = fit_rates(members, targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rate = found.rates(np.stack([b.column(c).to_numpy() for c in names], 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rate), pa.array(copies(rate, b.column(0).fill_null(0).to_numpy()), pa.int64())], [*b.schema.names, "rate", "copies"])

    return members.mapInArrow(run, "doc_id long, n_tokens long, " + ", ".join(f"{c} double" for c in names) + ", rate double, copies long")


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: Column | None = None) -> DataFrame:
    """``docs`` thinned to the targets: rates lie between 0 and 1, so no row is repeated; all columns stay."""
    model = fit(docs, labels, targets, domain)
    members = materialize(memberships(docs, model, targets), "members")
    found, _ = fit_thinning(members, targets)
    text, key = docs.columns.index("text"), docs.columns.index("doc_id")
    bound = docs.sparkSession.sparkContext.broadcast((model, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.clear()
        m, rates = bound.value
        for b in batches:
            rate = rates.rates(m.posteriors(b.column(text))[0])
            yield b.filter(pa.array(copies(rate, b.column(key).cast(pa.int64()).fill_null(0).to_numpy()) > 0))

    return docs.mapInArrow(run, docs.schema)
