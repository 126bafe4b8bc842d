"""Set similarity over word shingles: MinHash signatures and band keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import let, lower_words
from tessera.operators.greedy import greedy_dropped  # noqa: F401

# Shingle width, permutations, bands and rows of the near-duplicate pass.
K, BANDS, ROWS = 5, 14, 8
PERMUTATIONS = BANDS * ROWS
PRIME = (1 << 31) - 1


def threshold(bands: int = BANDS, rows: int = ROWS) -> float:
    """The similarity at which a pair is about as likely as not to share a band."""
    return (1 / bands) ** (1 / rows)


def captured(similarity: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """Probability that a pair of this similarity shares a band."""
    return 1 - F.pow(1 - F.pow(similarity, F.lit(rows)), F.lit(bands))


def capture_curve(spark: SparkSession, settings: list[tuple[int, int]], steps: int = 20) -> DataFrame:
    """(bands, rows, threshold, similarity, captured) of each setting at steps + 1 similarities."""
    given = spark.createDataFrame([(b, r, threshold(b, r)) for b, r in settings], "bands int, rows int, threshold double")
    points = given.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / steps)).alias("similarity"))
    return points.withColumn("captured", 1 - F.pow(1 - F.pow("similarity", "rows"), "bands"))


def shingles(text: Column, k: int = K) -> Column:
    """Distinct 64-bit hashes of the runs of k words; the whole text as one when it is shorter, none without words."""

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
        return F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " ")))))

    return let(lower_words(text), runs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def signature(shingle_set: Column, permutations: int = PERMUTATIONS, seed: int = 1) -> Column:
    """Minima of seeded linear hashes modulo PRIME, in Arrow batches; an empty set has PRIME in every place."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1, PRIME, permutations), rng.integers(0, PRIME, permutations)

    def one(values: np.ndarray) -> np.ndarray:
        out, x = np.full(permutations, PRIME), np.asarray(values, np.int64) % PRIME
        for at in range(0, len(x), 4096):  # blocks, so that a very long text needs no large matrix
            out = np.minimum(out, ((a[:, None] * x[None, at : at + 4096] + b[:, None]) % PRIME).min(axis=1))
        return out

    return F.pandas_udf(lambda s: pd.Series([one(v) for v in s]), T.ArrayType(T.LongType()))(shingle_set)


def band_keys(sig: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice(sig, i * rows + 1, rows)))


def estimate(a: Column, b: Column, permutations: int = PERMUTATIONS) -> Column:
    """Share of places in which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / permutations
