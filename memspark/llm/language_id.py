"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of orders 1 to ``ORDER`` over lower-cased letters, read word by word with a
boundary mark on either side.  The models of all languages share one sorted array of n-gram hashes; each
n-gram has, for every language, its interpolated probability or the factor by which a longer context backs
off to it.  A text's language is the one with the lowest cross-entropy per character.

Learning counts the n-grams of a bounded sample of labelled rows (``SAMPLE_PER_LANG`` rows a language, chosen by
a hash of doc_id; whole texts, every word), by one Spark aggregation over all languages.  What reaches the driver
are distinct n-grams, which are few beside the words.  Order 1 is mixed with an even chance for each of ``ALPHABET``
characters, so a model is a distribution over every text, letters it has not seen included.  A word's score is its
models' log-probabilities; a worker remembers words it has scored, so frequent ones cost a look-up.

Calibration: the held-back fifth of the sample gives, per language, the mean and spread of cross-entropies
of its own texts; a text is rejected when its best language's cross-entropy lies more than ``REJECT_SPREAD``
spreads (but at least ``REJECT_BITS`` bits, and
``REJECT_SHORT`` over the root of its length) above that mean.  A language whose held-back texts all have
fewer than ``LEAST_CHARS`` characters, or that has none, is not calibrated and never rejects: the means of
better learned languages would reject its own clean texts.

Defined results: text that is null or has no letter is ``und`` with score 0 and is rejected; other text of
fewer than ``LEAST_CHARS`` characters (letters, and one end mark a word) is never rejected; ties go to the
language first in alphabetical order; rows with null lang are not learned from; without any labelled row
every text is ``und``.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import held
from .common import materialize
from .pretoken import portions

ORDER = 5
#: Rows a language that learning reads at most, give or take the hash's chance.
SAMPLE_PER_LANG = 2000
#: Characters that a text may have: about the number of letters in Unicode.
ALPHABET = 1 << 17
REJECT_SPREAD = 8.0
REJECT_BITS = 1.5
#: Short texts may lie further out: so many bits over the square root of their characters.
REJECT_SHORT = 16.0
#: Texts with fewer characters say too little of their language: they neither calibrate nor are rejected.
LEAST_CHARS = 40
#: Words that a worker remembers.
CACHE = 250_000
#: Runs of letters (category L); number signs such as a half or roman twelve are none.
LETTERS = regex.compile(r"\p{L}+")
_EDGE = "\x02"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _hash(columns: list[np.ndarray], rows: int) -> np.ndarray:
    """Hashes of n-grams given as n columns of character codes."""
    h = np.full(rows, len(columns) * 0xD1B54A32D192ED03 % (1 << 64), np.uint64)
    for c in columns:
        h = (h ^ c) * _MULT
        h ^= h >> np.uint64(29)
    return h


def count_grams(words: dict[str, int]) -> Counter:
    """Counts of n-grams that end at each character of the words: ``ORDER`` long, shorter only where a word begins."""
    out: Counter = Counter()
    for w, c in words.items():
        t = _EDGE + w + _EDGE
        for i in range(1, len(t)):
            out[t[max(0, i - ORDER + 1) : i + 1]] += c
    return out


class Models:
    """Kneser-Ney models of several languages, from their counts of n-grams, in one sorted hash array."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        value: dict[int, np.ndarray] = defaultdict(lambda: np.full(2 * len(self.langs), np.nan, np.float32))
        for at, lang in enumerate(self.langs):
            self._learn(at, counts[lang], value)
        self.keys = np.array(sorted(value), np.uint64)
        table = np.array([value[k] for k in self.keys.tolist()]) if len(self.keys) else np.zeros((0, 2 * len(self.langs)), np.float32)
        #: log2 probability of an n-gram's last character; log2 weight with which its context passes on
        self.prob, self.pass_on = table[:, : len(self.langs)].copy(), np.nan_to_num(table[:, len(self.langs) :])
        #: an infinite mean, until calibration sets it, rejects nothing
        self.mean, self.spread = np.full(len(self.langs), np.inf), np.zeros(len(self.langs))

    def _learn(self, at: int, top: dict[str, int], value: dict) -> None:
        # counts of the highest order, continuation counts below; grams that open a word keep their counts
        orders: list[Counter] = [Counter() for _ in range(ORDER + 1)]
        for g, c in top.items():
            orders[len(g)][g] += c
        for n in range(ORDER, 1, -1):
            for g in orders[n]:
                orders[n - 1][g[1:]] += 1
        lower: dict[str, float] = {}
        for n in range(1, ORDER + 1):
            ones = sum(c == 1 for c in orders[n].values())
            twos = sum(c == 2 for c in orders[n].values())
            d = ones / (ones + 2 * twos) if ones else 0.5
            d = min(max(d, 0.1), 0.9)
            total, kinds = Counter(), Counter()
            for g, c in orders[n].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            now = {}
            for g, c in orders[n].items():
                ctx = g[:-1]
                base = lower[g[1:]] if n > 1 else 1 / ALPHABET
                now[g] = (c - d) / total[ctx] + d * kinds[ctx] / total[ctx] * base
            for k, p in zip(self._keys(list(now), n), now.values(), strict=True):
                value[k][at] = math.log2(p)
            for k, ctx in zip(self._keys(list(kinds), n - 1), kinds, strict=True):
                value[k][len(self.langs) + at] = math.log2(d * kinds[ctx] / total[ctx])
            lower = now

    @staticmethod
    def _keys(grams: list[str], n: int) -> list[int]:
        """Hashes of grams that all have ``n`` characters."""
        codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(grams), n)
        return _hash([codes[:, k] for k in range(n)], len(grams)).tolist()

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == h, at, -1) if len(self.keys) else np.full(len(h), -1)

    def words(self, words: list[str]) -> np.ndarray:
        """log2 probabilities (words x languages); the end mark of each word counts as a character."""
        each, length = self.characters(words)
        return np.add.reduceat(each, np.cumsum(length) - length)

    def characters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log2 probabilities of each word's characters and its end mark, characters of each word)."""
        length = np.array([len(w) + 2 for w in words])
        flat = np.frombuffer("".join(_EDGE + w + _EDGE for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        # from the longest context down: where a gram is unknown to a language, its context's weight is paid
        at = np.flatnonzero(place > 0)
        out = np.zeros((len(at), len(self.langs)))
        open_ = np.ones(out.shape, bool)
        for n in range(ORDER, 0, -1):
            fits = np.flatnonzero((place[at] >= n - 1) & open_.any(1))
            if not len(fits):
                continue
            begin = at[fits] - n + 1
            chars = [flat[begin + k] for k in range(n)]
            found = self._find(_hash(chars, len(fits)))
            p = np.where((found >= 0)[:, None], self.prob[found], np.nan)
            hit = open_[fits] & ~np.isnan(p)
            out[fits] += np.where(hit, np.nan_to_num(p), 0)
            open_[fits] &= ~hit
            found = self._find(_hash(chars[:-1], len(fits)))
            out[fits] += np.where(open_[fits] & (found >= 0)[:, None], self.pass_on[found], 0)
        out -= np.where(open_, math.log2(ALPHABET), 0)
        return out, length - 1


class Scorer:
    """Cross-entropies of texts; words scored before are remembered, up to about ``CACHE``."""

    def __init__(self, models: Models):
        self.models = models
        self.at: dict[str, int] = {}
        #: Of each word remembered: log2 probability by language, and its characters with the end mark.
        self.table = np.zeros((0, len(models.langs) + 1), np.float32)

    def _learn(self, wanted: set[str]) -> None:
        if len(self.at) > CACHE:
            # words in use stay
            stay = list(wanted.intersection(self.at))
            self.table = self.table[[self.at[w] for w in stay]]
            self.at = {w: i for i, w in enumerate(stay)}
        new = list(wanted.difference(self.at))
        parts = [self.table]
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            parts.append(np.column_stack([self.models.words(some), [len(w) + 1 for w in some]]).astype(np.float32))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.table = np.concatenate(parts)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits per character: texts x languages, characters)."""
        k = len(self.models.langs)
        if not k:
            return np.zeros((len(texts), 0)), np.zeros(len(texts))
        found = [LETTERS.findall(t.lower()) for t in texts]
        self._learn(set(chain.from_iterable(found)))
        n = np.array([len(f) for f in found])
        sums, some = np.zeros((len(texts), k + 1)), np.flatnonzero(n)
        if len(some):
            rows = self.table[np.fromiter(map(self.at.__getitem__, chain.from_iterable(found)), np.int64, n.sum())]
            sums[some] = np.add.reduceat(rows, (np.cumsum(n) - n)[some], dtype=np.float64)
        return -sums[:, :k] / np.maximum(sums[:, k:], 1), sums[:, k]


def sample_grams(rows: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> tuple[dict[str, dict[str, int]], dict[str, float]]:
    """(n-gram counts by language, share of rows sampled) over labelled ``rows`` (doc_id, text, lang).

    Bounded: the n-grams of about ``per_lang`` rows a language reach the driver, and each language's share.
    """
    share = {r["lang"]: min(1.0, per_lang / r["n"]) for r in rows.filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    if not share:
        return {}, {}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.clear()
        for b in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words[lang].update(LETTERS.findall((text or "").lower()))
            for lang, own in words.items():
                grams = count_grams(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "n"])

    some = _sampled(rows, share).select("lang", "text")
    grams = some.mapInArrow(split, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in materialize(grams, "grams").toLocalIterator():
        counts[r["lang"]][r["gram"]] = r["n"]
    return dict(counts), share


def _sampled(rows: DataFrame, share: dict[str, float]) -> DataFrame:
    """The rows of each language that a hash of doc_id picks."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1_000_000
    chosen = F.create_map(*(F.lit(x) for kv in share.items() for x in kv))
    return rows.filter(part < F.try_element_at(chosen, F.col("lang")))


def learn(rows: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Models:
    """Models of ``rows`` (doc_id, text, lang): four fifths of the sample teach, one fifth calibrates."""
    rows = rows.select("doc_id", "text", "lang")
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0
    counts, share = sample_grams(rows.filter(~calibrates), per_lang)
    models = Models(counts)
    if not counts:
        return models
    test = _sampled(rows.filter(calibrates), {lang: share[lang] for lang in counts})
    langs, bound = models.langs, rows.sparkSession.sparkContext.broadcast(models)

    def entropy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.clear()
        score = Scorer(bound.value)
        for b in batches:
            e, chars = score([t or "" for t in b.column(1).to_pylist()])
            own = [langs.index(x) for x in b.column(0).to_pylist()]
            keep = chars >= LEAST_CHARS
            yield pa.RecordBatch.from_arrays([pa.array(np.array(own, np.int32)[keep]), pa.array(e[np.arange(len(own)), own][keep])], ["at", "bits"])

    for r in test.select("lang", "text").mapInArrow(entropy, "at int, bits double").groupBy("at").agg(F.percentile_approx("bits", F.array(F.lit(0.5), F.lit(0.9)), 1000).alias("q")).collect():
        models.mean[r["at"]], models.spread[r["at"]] = r["q"][0], r["q"][1] - r["q"][0]
    return models


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, bits, rejected for every row of ``docs`` (doc_id, text)."""
    bound = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.clear()
        score = Scorer(bound.value)
        langs = np.array([*bound.value.langs, "und"], object)
        limit = bound.value.mean + np.maximum(REJECT_SPREAD * bound.value.spread, REJECT_BITS)
        for keys, texts in portions(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *predictions(score, langs, limit, texts)], ["doc_id", "lang_pred", "score", "bits", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, bits double, rejected boolean")


def predictions(score: Scorer, langs: np.ndarray, limit: np.ndarray, texts: list[str]) -> list[pa.Array]:
    """Language, score, bits per character and rejection of each text."""
    e, chars = score(texts)
    if not e.shape[1]:
        return [pa.array(["und"] * len(texts)), pa.array(np.zeros(len(texts))), pa.array(np.zeros(len(texts))), pa.array(np.ones(len(texts), bool))]
    best = e.argmin(1)
    low = e[np.arange(len(e)), best]
    # posterior of the best language from the bits that separate it, for at most 60 characters of evidence
    weight = np.minimum(chars, 60.0)[:, None]
    p = 1 / np.exp2(-(e - low[:, None]) * weight).sum(1)
    none = chars == 0
    best = np.where(none, len(langs) - 1, best)
    cut = np.append(limit, 0.0)[best] + REJECT_SHORT / np.sqrt(np.maximum(chars, 1))
    rejected = none | ((chars >= LEAST_CHARS) & (low > cut))
    return [pa.array(langs[best], pa.string()), pa.array(np.where(none, 0.0, p)), pa.array(np.where(none, 0.0, low)), pa.array(rejected)]


def keep_identified(docs: DataFrame, models: Models) -> DataFrame:
    """``docs`` without the rows that identification rejects; all columns stay."""
    bound = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.clear()
        score = Scorer(bound.value)
        langs = np.array([*bound.value.langs, "und"], object)
        limit = bound.value.mean + np.maximum(REJECT_SPREAD * bound.value.spread, REJECT_BITS)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                rejected = predictions(score, langs, limit, [t or "" for t in b.column(at).to_pylist()])[3]
                yield b.filter(pc.invert(rejected))

    return docs.mapInArrow(run, docs.schema)
