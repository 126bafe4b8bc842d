"""Quality classifier by Bradley-Terry pairwise ranking.

The strength of a document is a linear function of features of its text, learned from preference pairs (one text of
label 1, one of label 0) by logistic loss on their feature differences. The threshold is a quantile of the strengths of
all labelled documents, also of those beyond the fitting sample.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, release, text_or_empty

#: At most so many labelled rows, those with the smallest hashes, are gathered to fit on; all other work covers all rows.
SAMPLE_ROWS = 20_000
PAIRS_PER_ROW, STEPS, RIDGE, SEED = 6, 300, 1e-3, 7
THRESHOLD = 0.3
WIDTH = 95 + 49 + 6  # features of a text

_WORD_END = np.zeros(256, bool)
_WORD_END[[ord(c) for c in " \t\n\r\x0b\x0c"]] = True
_CLASS = np.full(256, 5, np.int64)  # 0 space, 1 lower, 2 upper, 3 digit, 4 sentence marks, 5 other ASCII, 6 beyond ASCII
_CLASS[_WORD_END] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4


def features(text: str) -> np.ndarray:
    """Rates of ASCII bytes and of pairs of byte classes, and a few shape figures; zeros for an empty text."""
    b = np.frombuffer(text.encode(), np.uint8)
    if not len(b):
        return np.zeros(WIDTH)
    n = len(b)
    c = _CLASS[b]
    rates = np.bincount(b, minlength=256)[32:127] / n
    pairs = np.bincount(c[:-1] * 7 + c[1:], minlength=49) / n
    words, lines = text.split(), text.split("\n")
    n_words = max(1, len(words))
    shape = [n / n_words, len(set(words)) / n_words, len(set(lines)) / len(lines), len(lines) / n_words, math.log1p(n), math.log1p(n_words)]
    return np.concatenate([np.log1p(1000 * rates), np.log1p(1000 * pairs), np.log1p(shape)])


@dataclass(frozen=True)
class Ranking:
    """What is fitted on the sample: the strength of a text."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights


@dataclass(frozen=True)
class Cut:
    """What all labelled documents decide: the strength that scores THRESHOLD, and the slope of the scores there."""

    strength: float = -1.0
    slope: float = 1.0


def fit(x: np.ndarray, label: np.ndarray) -> Ranking:
    """Without both labels: a ranking that gives all texts the strength 0.

    A pair's feature difference is never built: the difference of two strengths is taken from the strengths of the rows,
    and the gradient from the sum of the pairs' residuals at each row, so memory stays at one copy of x."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH))
    mean, scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-6
    z = np.clip((x - mean.astype(np.float32)) / scale.astype(np.float32), -6, 6)
    rng = np.random.default_rng(SEED)
    n = PAIRS_PER_ROW * max(len(good), len(bad))
    better, worse = rng.choice(good, n), rng.choice(bad, n)
    w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for t in range(1, STEPS + 1):  # Adam on the whole set of pairs
        s = z @ w.astype(np.float32)
        p = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -30, 30)))
        pull = np.bincount(better, p, len(z)) - np.bincount(worse, p, len(z))
        g = RIDGE * w - (pull.astype(np.float32) @ z) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Ranking(mean, scale, w)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labels to learn from, one row per id (the greater label of a repeated one)."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ranking:
    """Fits on labelled rows that aren't held out, at most sample_rows of them (by the smallest hash of doc_id). Of rows
    that repeat a doc_id one text counts, so at most sample_rows feature vectors reach the driver."""
    chosen = learnable(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("__id"), "quality")
    vector = F.pandas_udf(lambda s: pd.Series([features(t).astype(np.float32).tobytes() for t in s]), T.BinaryType())
    # The sample is bounded by its parameter, so it can be sent to all tasks.
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    found = rows.select("__id", "quality", vector("text").alias("x")).groupBy("__id", "quality").agg(F.min("x").alias("x")).select("quality", "x").toArrow()
    x = np.empty((found.num_rows, WIDTH), np.float32)
    for i, row in enumerate(found.column("x")):
        x[i] = np.frombuffer(row.as_py(), np.float32)
    return fit(x, found.column("quality").to_numpy())


def strength_column(ranking: Ranking, text_col: str = "text") -> Column:
    def strength(texts: pd.Series) -> pd.Series:
        return pd.Series(ranking.strengths(np.array([features(t) for t in texts], float).reshape(len(texts), WIDTH)))

    return F.pandas_udf(strength, T.DoubleType())(text_or_empty(text_col))


def cut_of(strengths: DataFrame, labels: DataFrame) -> Cut:
    """strengths(doc_id, strength), labels -> the cut over all labelled documents that aren't held out: midway between the
    quantile of their strengths at the share of label 0 and the next strength, and a slope by the distance of the means."""
    both = strengths.join(learnable(labels), "doc_id")
    mean = lambda q: F.avg(F.when(F.col("quality") == q, F.col("strength")))
    share, spread = both.agg(F.avg(1.0 - F.col("quality")), mean(1) - mean(0)).first()
    if spread is None:
        return Cut()
    below = both.agg(F.percentile_approx("strength", share, 10_000)).first()[0]
    above = both.where(F.col("strength") > below).agg(F.min("strength")).first()[0]
    return Cut((below + (below if above is None else above)) / 2, 6 / max(spread, 1e-6))


def score_of(strength: Column, cut: Cut) -> Column:
    """0 to 1; the cut's strength gives THRESHOLD."""
    z = F.lit(cut.slope) * (strength - F.lit(cut.strength)) + F.lit(math.log(THRESHOLD / (1 - THRESHOLD)))
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Null text counts as empty; a null doc_id is held out
    as an empty one; other columns are never read. Rows that repeat a doc_id are scored each by its own text. Without
    usable labels every score is the same; an empty table gives an empty table."""
    ranking = train(docs, labels)
    found = materialize(docs.select(F.col("doc_id"), held_out().alias("held_out"), strength_column(ranking).alias("strength")), "strengths")
    scored = found.select("doc_id", "held_out", score_of(F.col("strength"), cut_of(found, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier rejects (score under THRESHOLD); columns as they come. Labels are read from
    sf_dir. Documents are judged row by row, so nulls, repeats and an empty table need no care."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ranking = train(docs, labels)
    found = materialize(docs.select("doc_id", strength_column(ranking).alias("strength")), "strengths")
    cut = cut_of(found, labels)
    release(found)
    return docs.where(score_of(strength_column(ranking), cut) >= THRESHOLD)
