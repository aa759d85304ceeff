"""Quality rules whose cut-offs follow the data: quantile sketches per language and source.

Every text is measured with DataFrame functions alone.  For each ratio mergeable quantile sketches are kept
per (lang, source), per lang and for the whole table (``percentile_approx``: map-side partial sketches, merged
by the reducers, so a source with a third of all rows moves one sketch a task).

Most ratios are zero in most texts, so a sketch is over the values above zero, beside their share.  The fence of a
group is, of these values' quantiles,

* half of q10, if values above zero are rare in the group (``RARE``) and begin far from zero, at ``APART`` or more of
  the smallest steps that a text of the group's median length can show: they are a population of their own;
* otherwise the far-out fence q75 + FENCE * (q75 - q25) of the values themselves.

Quantiles are over the texts that pass the base rule.  So a group in which a ratio is usual has a fence above its usual values, and one in which it is not has a low one.
A group with fewer than ``MIN_GROUP`` texts or ``MIN_VALUES`` values above zero uses its language's fence, a language
with fewer the whole table's, and a table with fewer rejects nothing by that ratio.

The fences (a row a group, no text) are joined back to the measured rows: sent where they are at most
``MAX_SENT_GROUPS``, else by a join in which each group's rows are dealt over ``SALTS`` tasks.

Defined results: null text has no words, fails the base rule and is not kept; null lang or source are
groups of their own; an empty table gives an empty result; repeated rows are measured one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, materialize

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Ratios, and how many words the smallest step of each stands for: a symbol or letter a word, a line of ten words, a window found twice.
RATIOS = {"symbol_ratio": 1.0, "dup_line_ratio": 10.0, "repeat_ratio": 2.0 * WINDOW, "mean_word": 1.0}
FENCE = 5.0
RARE = 0.2
APART = 8.0
MIN_GROUP = 200
MIN_VALUES = 30
ACCURACY = 1000
MAX_SENT_GROUPS = 50_000
SALTS = 32


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def measure(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` columns and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    # a word is hashed once; windows, repeats and lines are then compared as numbers
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        *keep,
        F.transform(_words(t), lambda w: F.xxhash64(w)).alias("_w"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0), lambda x: F.xxhash64(x)).alias("_l"),
    )
    n = F.size("_w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        *keep, "word_chars", "n_symbols",
        n.cast("long").alias("n_words"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        windows.alias("_h"),
    )
    rows = rows.withColumn("_any", F.size("_h") > F.size(F.array_distinct("_h")))
    # only texts with a repeated window sort (hash, place); equal neighbours are the repeated windows
    pairs = F.when(F.col("_any"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("_s", pairs).drop("_h", "_any")
    same = lambda a, b: F.try_element_at("_s", a)["h"] == F.try_element_at("_s", b)["h"]
    hit = F.filter("_s", lambda x, k: F.coalesce(F.when(k > 0, same(k, k + 1)), F.lit(False)) | F.coalesce(same(k + 2, k + 1), F.lit(False)))
    rows = rows.withColumn("_p", F.sort_array(F.transform(hit, lambda x: x["i"]))).drop("_s")
    # a window covers up to WINDOW words, fewer where the next repeated one begins earlier
    step = F.aggregate(
        "_p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("int").alias("at")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).cast("long").alias("n"), p.alias("at")),
        lambda acc: acc["n"],
    )
    return rows.withColumn("n_repeat_words", F.coalesce(step, F.lit(0).cast("long"))).drop("_p")


def with_ratios(rows: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return rows.withColumns({
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") * 10 / words,
        "repeat_ratio": F.col("n_repeat_words") / words,
        "mean_word": F.col("word_chars") / words,
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })


def fences(rows: DataFrame, *by: str) -> DataFrame:
    """``by`` and the upper fence of every ratio in each group, null where the group has too few values."""
    sketch = [
        F.count("*").alias("_n"), F.percentile_approx("n_words", 0.5, ACCURACY).alias("_words"),
        *(f(F.when(F.col(r) > 0, F.col(r))).alias(f"{p}{r}") for r in RATIOS for p, f in (("_k_", F.count), ("_q_", lambda x: F.percentile_approx(x, F.array(F.lit(0.1), F.lit(0.25), F.lit(0.75)), ACCURACY)))),
    ]
    out = rows.filter("not base_failed").groupBy(*by).agg(*sketch)

    def fence(r: str, step: float) -> Column:
        low, q25, q75 = (F.get(f"_q_{r}", F.lit(i)) for i in range(3))
        apart = (F.col(f"_k_{r}") <= RARE * F.col("_n")) & (low * F.col("_words") >= APART * step)
        enough = (F.col("_n") >= MIN_GROUP) & (F.col(f"_k_{r}") >= MIN_VALUES)
        return F.when(enough, F.when(apart, low / 2).otherwise(q75 + FENCE * (q75 - q25)))

    return out.select(*by, *(fence(r, step).alias(r) for r, step in RATIOS.items()))


def _attach(rows: DataFrame, found: DataFrame, by: list[str], prefix: str, most: int) -> DataFrame:
    """``rows`` with the fences of their group as ``prefix`` columns."""
    found = materialize(found, "fences").select(*(F.col(c).alias(f"{prefix}{c}") for c in [*by, *RATIOS]))
    same = [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by]
    if found.count() <= most:
        return rows.join(F.broadcast(found), same, "left").drop(*(f"{prefix}{c}" for c in by))
    # the rows of a group meet copies of its fences in many tasks
    salt, of = f"{prefix}salt", f"{prefix}of"
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*(c for c in rows.columns if c not in by)), F.lit(SALTS)).cast("int"))
    found = found.withColumn(of, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(found, [*same, F.col(salt) == F.col(of)], "left").drop(salt, of, *(f"{prefix}{c}" for c in by))


def judge(rows: DataFrame, max_sent_groups: int = MAX_SENT_GROUPS) -> DataFrame:
    """Adds ``failed`` (names of ratios above their fence) and ``kept`` to measured rows (lang, source) with ratios."""
    j = _attach(rows, fences(rows, "lang", "source"), ["lang", "source"], "_f_", max_sent_groups)
    j = _attach(j, fences(rows, "lang"), ["lang"], "_g_", max_sent_groups)
    whole = fences(rows).first()  # one row, a number a ratio
    fence = lambda r: F.coalesce(F.col(f"_f_{r}"), F.col(f"_g_{r}"), F.lit(whole[r]).cast("double"))
    j = j.withColumn("failed", F.array_compact(F.array(*(F.when(F.col(r) > fence(r), F.lit(r)) for r in RATIOS))))
    return j.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).select(*rows.columns, "failed", "kept")


def quality_filter(docs: DataFrame, text: str = "text", max_sent_groups: int = MAX_SENT_GROUPS) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, source, counts, ratios, base_failed, failed, kept."""
    rows = materialize(with_ratios(measure(docs, "doc_id", "lang", "source", text=text)), "measured")
    return judge(rows, max_sent_groups)
