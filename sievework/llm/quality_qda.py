"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each whole text gives ``FEATURES`` statistics, transformed by logarithms or logits towards normality.
For either class the labelled training rows give a mean and a covariance, shrunk towards the pooled
covariance and the identity. A document's score is the logistic function of the difference of the two
Gaussian log-densities plus the log prior ratio; Mahalanobis terms use Cholesky factors made once.

Class statistics are sums of x and x x' over all training rows, aggregated by Spark: the driver gets
2 x (1 + d + d*d) numbers whatever the input.

Edge cases: null and empty texts have the features of no characters and are scored; labels that are null
are ignored; a document with several label rows counts with its largest; equal documents rows each give
a row; with a class missing from the training rows every score is the share of label 1 (0.5 if there are
no labels at all). Features of no document are infinite or null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import held_out, map_batches, store

#: Weight of the pooled covariance in each class covariance, and of the identity in both.
SHRINK_POOLED, SHRINK_IDENTITY = 0.3, 0.05
THRESHOLD = 0.3
#: The log-density difference is divided by this: statistics of a text aren't independent samples.
TEMPERATURE = 4.0

FEATURES = (
    "log_words",
    "log_word_length",
    "upper_share",
    "digit_share",
    "symbol_share",
    "bar_share",
    "exclaim_share",
    "stop_share",
    "newline_share",
    "adjacent_repeat_share",
    "distinct_share",
    "repeated_line_share",
    "longest_run",
)
_SYMBOLS = np.frombuffer(b"#*$%&<>=@^~_{}[]\\/", dtype=np.uint8)


def _logit(x: float) -> float:
    return math.log((x + 0.002) / (1.002 - x))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    # continuation bytes don't start a character
    chars = max(1, int(hist.sum() - hist[0x80:0xC0].sum()))
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same, run, longest = 0, 1, 1
    before = None
    for w in words:
        if w == before:
            same += 1
            run += 1
            if run > longest:
                longest = run
        else:
            run = 1
            before = w
    letters = max(1, chars - int(hist[:65].sum() + hist[91:97].sum() + hist[123:128].sum()))
    upper = int(hist[65:91].sum())
    # distinct words fall with length alone; compare with the square root law
    distinct = len(set(words)) / n if n else 1.0
    return [
        math.log1p(n),
        math.log((chars + 1) / (n + 1)),
        _logit(min(1.0, upper / letters)),
        _logit(int(hist[48:58].sum()) / chars),
        _logit(int(hist[_SYMBOLS].sum()) / chars),
        _logit(int(hist[124]) / chars),
        _logit(int(hist[33]) / chars),
        _logit(int(hist[46]) / chars),
        _logit(int(hist[10]) / chars),
        _logit(same / n if n else 0.0),
        math.log(distinct) / math.log(n + 2),
        _logit(1 - len(set(lines)) / len(lines) if lines else 0.0),
        math.log(longest),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but ``text``, and ``x``: the statistics of each text."""
    rest = [c for c in docs.columns if c not in ("text", "x")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest] + ["x array<double>"])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            out = batch.select(rest)
            return pa.RecordBatch.from_arrays([*out.columns, pa.array(x, pa.list_(pa.float64()))], names=[*rest, "x"])

        return work

    return map_batches(docs.select(*rest, "text"), schema, make)


class Discriminant:
    """Class means, Cholesky factors and log-priors."""

    def __init__(self, count, mean, cov):
        self.prior = (count[1] / (count[0] + count[1])) if count[0] + count[1] else 0.5
        self.ready = bool(count[0] > 0 and count[1] > 0)
        if not self.ready:
            return
        self.mean = mean
        pooled = (count[0] * cov[0] + count[1] * cov[1]) / (count[0] + count[1])
        scale = np.diag(np.diag(pooled) + 1e-4)
        self.inverse, self.const = [], []
        for k in (0, 1):
            s = (1 - SHRINK_POOLED) * cov[k] + SHRINK_POOLED * pooled
            s = (1 - SHRINK_IDENTITY) * s + SHRINK_IDENTITY * scale
            factor = np.linalg.cholesky(s)
            self.inverse.append(np.linalg.inv(factor))
            self.const.append(-np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready or not len(x):
            return np.full(len(x), self.prior)
        log = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.inverse[k].T
            log.append(self.const[k] - 0.5 * (z * z).sum(axis=1))
        odds = (log[1] - log[0]) / TEMPERATURE + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """From rows (doc_id, x) and labels; held-out ids are left out."""
    d = len(FEATURES)
    marks = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    rows = stats.select("doc_id", "x").join(marks, "doc_id")

    def sums(batches):
        total = {}
        for b in batches:
            x = np.array(b.column("x").to_pylist(), dtype=float).reshape(-1, d)
            y = np.array(b.column("y").to_pylist())
            for k in (0, 1):
                part = np.concatenate([np.ones((int((y == k).sum()), 1)), x[y == k]], axis=1)
                total[k] = total.get(k, 0) + part.T @ part
        n = (d + 1) ** 2
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(m.ravel())], names=["y", "at", "v"])

    got = rows.select("x", "y").mapInArrow(sums, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((2, (d + 1) ** 2))
    for r in got:
        m[r.y, r.at] = r.v
    m = m.reshape(2, d + 1, d + 1)
    count, mean, cov = m[:, 0, 0], np.zeros((2, d)), np.zeros((2, d, d))
    for k in (0, 1):
        if count[k]:
            mean[k] = m[k, 0, 1:] / count[k]
            cov[k] = m[k, 1:, 1:] / count[k] - np.outer(mean[k], mean[k])
    return Discriminant(count, mean, cov)


def _scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    rest = [c for c in stats.columns if c not in ("x", "score")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema if f.name in rest] + ["score double"])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
            return pa.RecordBatch.from_arrays([*batch.select(rest).columns, pa.array(model.score(x))], names=[*rest, "score"])

        return work

    return map_batches(stats, schema, make)


def score_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. One pass over the texts."""
    stats = store(with_statistics(docs.select("doc_id", "text")), "quality-statistics")
    scored = _scored(stats, fit(stats, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents scored at ``threshold`` or more, with all their columns.

    One narrow pass gathers statistics for the fit (only ids and statistics meet the labels in a shuffle);
    a second narrow pass scores and keeps whole rows.
    """
    model = fit(with_statistics(docs.select("doc_id", "text")), labels)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            return batch.filter(pa.array(model.score(x) >= threshold))

        return work

    return map_batches(docs, docs.schema, make)
