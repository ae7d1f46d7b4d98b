"""Quality rules as weak supervision, in DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0) on a document's statistics. Expectation-maximisation
over the table of vote patterns estimates each rule's accuracy where it votes and the share of good
documents; the posterior probability of "good" replaces an all-must-pass filter. A document stays if
the posterior is at least ``KEEP_AT`` and it doesn't fail the base rule.

The pattern table has at most 3 ** len(RULES) rows whatever the input, so the driver's iterations are
bounded; statistics are one row per document, computed inside the row (no window is exploded).

Edge cases: null text has no words; n_words < 10 fails the base rule; with no document at all the result
is empty; equal rows each give a row; further columns are ignored. Five-word windows are compared by a
64-bit hash of their words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import store

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
KEEP_AT = 0.5
#: EM: rounds, weight of the starting values, the share of good documents and the accuracy it starts from.
ROUNDS, SMOOTHING, PRIOR, START = 60, 1.0, 0.8, 0.8
#: Bounds of an accuracy: every rule is better than chance and none is infallible.
LOWEST, HIGHEST = 0.55, 0.99


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas use it often."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column) -> Column:
    """Words inside five-word windows that occur at least twice."""
    keys = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
        lambda i: F.struct(F.xxhash64(F.slice(words, i, WINDOW)).alias("h"), i.alias("i")),
    )

    def repeated(s: Column) -> Column:
        m = F.size(s)
        twice = F.filter(
            F.sequence(F.lit(0), m - 1),
            lambda k: ((k > 0) & (F.get(s, k - 1)["h"] == F.get(s, k)["h"])) | ((k < m - 1) & (F.get(s, k + 1)["h"] == F.get(s, k)["h"])),
        )
        return F.array_sort(F.transform(twice, lambda k: F.get(s, k)["i"]))

    total = lambda at: F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
    )["n"]
    found = _let(F.array_sort(keys), lambda s: _let(repeated(s), total))
    return F.when(F.size(words) >= WINDOW + 1, found).otherwise(0).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    less = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    by_words = _let(
        F.array_remove(F.split(text, SPACE, -1), ""),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _covered(w).alias("n_repeat_words"),
        ),
    )
    out = docs.select(
        "doc_id",
        by_words.alias("w"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n"))).alias("l"),
        less(r"[\p{L}\p{N}]+").cast("long").alias("n_letters"),
        less(r"\p{Lu}+").cast("long").alias("n_upper"),
        without("!|").cast("long").alias("n_marks"),
    )
    return out.select(
        "doc_id",
        "w.n_words",
        "word_chars",
        "n_symbols",
        F.col("l.dup").alias("n_dup_lines"),
        "w.n_repeat_words",
        "w.n_distinct",
        F.col("l.n").alias("n_lines"),
        "n_letters",
        "n_upper",
        "n_marks",
    )


def _vote(good: str, bad: str) -> Column:
    return F.expr(f"case when n_words = 0 then -1 when {bad} then -1 when {good} then 1 else 0 end")


#: Name of a rule, when it votes good, when it votes bad; else it abstains.
RULES = {
    "word_length": ("false", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
    "symbols": ("false", "10 * n_symbols > n_words"),
    "marks": ("false", "10 * n_marks > n_words"),
    "capitals": ("false", "4 * n_upper > n_letters"),
    "letters": ("false", "100 * n_letters < 80 * word_chars"),
    "split_words": ("false", "100 * n_letters < 88 * word_chars and 20 * (n_symbols + n_marks) > n_words"),
    "repeats": ("false", "5 * n_repeat_words > n_words"),
    "duplicate_lines": ("false", "10 * n_dup_lines > 3 * n_lines"),
    "clean_surface": ("40 * (n_symbols + n_marks) <= n_words and 6 * n_upper <= n_letters and 100 * n_letters >= 80 * word_chars", "false"),
    "prose": ("word_chars between 3 * n_words and 12 * n_words and 100 * n_letters >= 88 * word_chars and 40 * n_marks <= n_words and 20 * n_repeat_words <= n_words and 20 * n_dup_lines <= n_lines", "false"),
}


def votes(stats: DataFrame) -> DataFrame:
    return stats.select("*", *[_vote(good, bad).alias(f"vote_{name}") for name, (good, bad) in RULES.items()])


def fit(voted: DataFrame) -> tuple[float, dict[str, float]]:
    """EM over the vote patterns: the share of good documents and each rule's accuracy where it votes."""
    names = list(RULES)
    counted = voted.groupBy(*[f"vote_{x}" for x in names]).agg(F.count("*").alias("n")).collect()
    patterns = sorted((tuple(r)[:-1], r["n"]) for r in counted)
    share, accuracy = PRIOR, dict.fromkeys(names, START)
    for _ in range(ROUNDS if patterns else 0):
        got = [(v, n, posterior_of(v, share, accuracy)) for v, n in patterns]
        total = sum(n for _, n, _ in got)
        share = (sum(n * g for _, n, g in got) + SMOOTHING * PRIOR) / (total + SMOOTHING)
        for k, x in enumerate(names):
            right = sum(n * (g if v[k] > 0 else 1 - g) for v, n, g in got if v[k])
            cast = sum(n for v, n, _ in got if v[k])
            accuracy[x] = min(HIGHEST, max(LOWEST, (right + SMOOTHING * START) / (cast + SMOOTHING)))
    return share, accuracy


def posterior_of(pattern: tuple[int, ...], share: float, accuracy: dict[str, float]) -> float:
    """P(good | votes): rules are independent given the class, an abstention says nothing."""
    odds = math.log(share / (1 - share)) + sum(v * math.log(accuracy[x] / (1 - accuracy[x])) for x, v in zip(RULES, pattern, strict=True))
    return 1 / (1 + math.exp(-odds))


def judged(voted: DataFrame) -> DataFrame:
    """The statistics, base_failed, posterior and kept."""
    share, accuracy = fit(voted)
    odds: Column = F.lit(math.log(share / (1 - share)))
    for x in RULES:
        odds = odds + F.col(f"vote_{x}") * F.lit(math.log(accuracy[x] / (1 - accuracy[x])))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        voted.withColumn("base_failed", base)
        .withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_AT))
    )


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, kept and posterior for every document."""
    voted = votes(store(statistics(docs.select("doc_id", "text")), "rule-statistics"))
    return judged(voted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
