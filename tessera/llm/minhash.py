"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

A document's set are its distinct 5-word shingles. One hash of each shingle fills 128 bins (the bin is the hash's high
bits, the value its minimum there); empty bins borrow from bins that a two-universal walk picks (Shrivastava, 2017).
Signatures are cut into 32 bands of 4, so that a pair of similarity 0.75 shares a bucket with probability
1 - (1 - 0.75^4)^32 = 0.999995.

Within a bucket, edges form a star: one centre (the least number of a class, which are dealt by hash) against the others,
confirmed on full sets. A pair of non-centres might be similar without either being similar to the centre, so buckets whose
members are then still in different components are settled exactly: the members outside the bucket's largest component are
dealt to blocks of bounded size, every block meets the bucket's members chunk by chunk, and shared shingles are counted
through an index of the block. No pairs are written but those that join components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SMALL_ROWS, KeyFilter, keep_once, materialize, release, split_join, text_or_empty
from tessera.llm.components import connected_components

SHINGLE_WORDS = 5
BINS, BAND_ROWS = 128, 4
SEED = 20_240_501
#: Shingles that a block of members outside the largest component, and a chunk of all members, are planned to hold.
BLOCK_SHINGLES, CHUNK_SHINGLES = 1 << 18, 1 << 21
#: Distinct words that a worker remembers before it starts anew: the frequent ones come back at once, and a small table is
#: faster than one of all words.
MEMO_ENTRIES = 1 << 16

_rng = np.random.default_rng(SEED)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: row i: the bins that bin i asks in turn when it is empty
_WALK = _rng.integers(0, BINS, (BINS, 2048), dtype=np.int64)
_BAND_SALT = _rng.integers(0, 1 << 63, BINS // BAND_ROWS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_words = WordHashes()


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles. Lower-casing and splitting bytes is lower-casing A-Z and splitting
    at ASCII white space."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < SHINGLE_WORDS:
        return mix((w * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    h = w[: n - SHINGLE_WORDS + 1] * _PLACE[0]
    for j in range(1, SHINGLE_WORDS):
        h += w[j : n - SHINGLE_WORDS + 1 + j] * _PLACE[j]
    return np.unique(mix(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation signature of a non-empty sorted set, densified."""
    shift = np.uint64(64 - (BINS.bit_length() - 1))
    edges = np.arange(BINS, dtype=np.uint64) << shift
    first = np.minimum(np.searchsorted(shingles, edges), len(shingles) - 1)
    values = shingles[first]
    filled = (values >> shift) == np.arange(BINS, dtype=np.uint64)
    source, empty, step = np.arange(BINS), np.flatnonzero(~filled), 0
    while empty.size and step < _WALK.shape[1]:
        ask = _WALK[empty, step : step + 32]
        full = filled[ask]
        hit = full.any(axis=1)
        source[empty[hit]] = ask[hit, full.argmax(axis=1)[hit]]
        empty, step = empty[~hit], step + 32
    if empty.size:
        source[empty] = np.flatnonzero(filled)[0]
    return values[source]


def band_keys(sig: np.ndarray) -> np.ndarray:
    return mix((sig.reshape(-1, BAND_ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + _BAND_SALT).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, th, text) -> (doc_id, th, n_shingles, digest, bands); digest identifies the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, bands = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py())
                counts.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
            arrays = [pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "th", "n_shingles", "digest", "bands"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, n_shingles long, digest binary, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """docs(node, text) -> (node, shingles): the whole sorted set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles binary")


@F.pandas_udf(T.LongType())
def common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted sets."""

    def size(x: bytes, y: bytes) -> int:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(x) > len(y):
            x, y = y, x
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        return int((y[at] == x).sum())

    return pd.Series([size(x, y) for x, y in zip(a, b)], dtype="int64")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Written pairs(centre, node) -> (a, b), those whose full sets have percent % of their union in common. A node is in
    few pairs (one a band), a centre in any number: its pairs are dealt to parts, and only its own set is repeated."""
    centres = pairs.groupBy("centre").agg(F.count("*").alias("fan"))
    centres = centres.join(sets.select(F.col("node").alias("centre"), F.col("shingles").alias("sa")), "centre")
    both = split_join(pairs.join(sets.withColumnRenamed("shingles", "sb"), "node"), centres, ["centre"], "fan", pairs.count(), F.col("node"))
    both = both.withColumn("shared", common("sa", "sb"))
    union = F.length("sa") / 8 + F.length("sb") / 8 - F.col("shared")
    return both.where(F.col("shared") * 100 >= union * percent).select(F.col("centre").alias("a"), F.col("node").alias("b"))


def settle(percent: int):
    """For applyInPandas over (bucket, block, chunk): links (a, b) between components, no more than join them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(comp=pd.factorize(pdf["comp"])[0])
        inner = pdf[pdf["inner"]]
        nodes, comps = inner["node"].tolist(), inner["comp"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in inner["shingles"]]
        sizes = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        owner = np.repeat(np.arange(len(sets)), sizes)[order]
        every = every[order]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                c = up
            return c

        out: list[tuple[int, int]] = []
        outer = pdf[~pdf["inner"]]
        for node, comp, raw in zip(outer["node"].tolist(), outer["comp"].tolist(), outer["shingles"]):
            x = np.frombuffer(raw, np.uint64)
            low, high = np.searchsorted(every, x), np.searchsorted(every, x, side="right")
            n = high - low
            if not n.any():
                continue
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            shared = np.bincount(owner[at], minlength=len(sets))
            near = (100 * shared >= percent * (len(x) + sizes - shared)) & (comps != comp)
            for k in np.flatnonzero(near).tolist():
                a, b = find(comp), find(int(comps[k]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((min(node, nodes[k]), max(node, nodes[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def settled(members: DataFrame, n_members: int, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The links that stars have missed: members(bucket, node, n), labels(node, component) -> (a, b)."""
    placed = members.join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("comp"))
    parts = placed.groupBy("bucket", "comp").agg(F.sum("n").alias("size"), F.count("*").alias("k"))
    whole = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("size").alias("size"), F.sum("k").alias("k"), F.max(F.struct("size", "comp")).alias("most")).where("parts > 1")
    blocks = F.ceil((F.col("size") - F.col("most.size")) / BLOCK_SHINGLES)
    whole = whole.select("bucket", "k", F.col("most.comp").alias("largest"), blocks.alias("blocks"), F.ceil(F.col("size") / CHUNK_SHINGLES).alias("chunks"))
    unsettled = split_join(placed, whole, ["bucket"], "k", n_members, F.col("node"), SMALL_ROWS)
    block, chunk = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node", "bucket"), F.col("chunks"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    inner = unsettled.where("comp != largest").select("bucket", block.alias("block"), numbers("chunks").alias("chunk"), F.lit(True).alias("inner"), "node", "comp")
    outer = unsettled.select("bucket", numbers("blocks").alias("block"), chunk.alias("chunk"), F.lit(False).alias("inner"), "node", "comp")
    rows = inner.unionByName(outer).join(sets, "node")
    return rows.groupBy("bucket", "block", "chunk").applyInPandas(settle(percent), "a long, b long").distinct()


def near_groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs(doc_id, th, text) -> (doc_id, th, n_shingles, keep): keep is a struct (none, doc_id, th) of the first row,
    null ids last, of those that its links reach. Equal sets are one class, known by the digest of the set, so that a
    doc_id which repeats over different texts stands in several."""
    signed = materialize(signatures(docs), "signed")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    known = signed.where("n_shingles > 0").groupBy("digest")
    found = known.agg(F.min(own).alias("first"), F.count("*").alias("k"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    classes = materialize(found.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers stay as written
    n_classes = classes.count()
    rows = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = materialize(rows.groupBy("bucket").agg(F.count("*").alias("k"), F.min("node").alias("centre")).where("k > 1"), "shared")
    # Most buckets have one member: a key filter keeps those rows out of the shuffle.
    may = KeyFilter(shared.select(F.col("bucket").alias("h")), shared.count()).may_hold(F.col("bucket"))
    found = materialize(split_join(rows.where(may), shared, ["bucket"], "k", 32 * n_classes, F.col("node"), 32 * SMALL_ROWS), "found")
    # Buckets with the same members, known by their number and two sums of hashes, count once. A group's buckets mostly
    # have one centre, so that a pair is met once.
    alike = found.groupBy("bucket", "k").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    once = alike.groupBy("k", "x", "y").agg(F.min("bucket").alias("bucket"))
    members = materialize(split_join(found.drop("k"), once.select("bucket", "k"), ["bucket"], "k", found.count(), F.col("node"), SMALL_ROWS).drop("k"), "members")
    for done in (shared, found):
        release(done)
    needed = classes.join(members.select("node").distinct(), "node", "left_semi")
    needed = materialize(needed.select("node", F.col("first.doc_id").alias("__d"), F.col("first.th").alias("__t")), "needed")
    n_needed = needed.count()
    may = KeyFilter(needed.select(F.col("__t").alias("h")), n_needed).may_hold(F.col("th"))
    chosen = docs.where(may)
    chosen = chosen.join(needed.hint("merge"), chosen["doc_id"].eqNullSafe(needed["__d"]) & (chosen["th"] == needed["__t"]))
    sets = materialize(full_sets(chosen), "sets")
    if sets.count() > n_needed:  # rows that repeat an id and a text
        sets = materialize(sets.dropDuplicates(["node"]), "sets")
    release(needed)
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent  # sizes bound the similarity
    met = members.where("node != centre").select("centre", "node", "n").distinct()
    sizes = classes.select(F.col("node").alias("centre"), F.col("n").alias("m"))
    pairs = materialize(met.join(sizes, "centre").where(fits).select("centre", "node"), "pairs")
    links = materialize(confirmed(pairs, sets, percent), "links")
    release(pairs)
    labels = materialize(connected_components(links), "labels")
    more = materialize(settled(members.select("bucket", "node", "n"), members.count(), sets, labels, percent), "more")
    for done in (members, sets, labels):
        release(done)
    labels = materialize(connected_components(links.unionByName(more)), "labels")
    linked = materialize(classes.select("node", "first").join(labels, "node"), "linked")
    best = linked.groupBy("component").agg(F.min("first").alias("keep"), F.count("*").alias("n"))
    of_linked = split_join(linked, best, ["component"], "n", linked.count(), F.col("node"), SMALL_ROWS).select("node", "keep")
    kept = classes.select("digest", "node", "k", "first").join(of_linked, "node", "left").select("digest", "k", F.coalesce("keep", "first").alias("keep"))
    grouped = split_join(signed.drop("bands"), kept, ["digest"], "k", signed.count(), F.struct("doc_id", "th"), SMALL_ROWS)
    alone = signed.where("n_shingles = 0").select("doc_id", "th", "n_shingles", own.alias("keep"))
    return grouped.select("doc_id", "th", "n_shingles", "keep").unionByName(alone)


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def near_dedup(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Null text counts as empty; texts without words have no shingles, are linked with nothing and are kept. Texts of
    fewer than five words have one shingle, the whole sequence. Rows that repeat a doc_id are linked each by its own
    text. Rows with a null doc_id have a null component_id and kept, but link what they are like. An empty table gives
    an empty table; other columns are not read."""
    out = near_groups(_hashed(docs, id_col, text_col), percent)
    component = F.when(F.col("doc_id").isNotNull(), F.col("keep.doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest doc_id (null only if no row has
    one; of several texts the least by hash). Rows are dropped by id and text, so a doc_id that repeats over texts that
    aren't alike loses none of them. Texts without words all stay."""
    found = near_groups(_hashed(docs, "doc_id", "text")).where("n_shingles > 0")
    found = materialize(found.select("doc_id", F.col("th").alias("key"), (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("th") == F.col("keep.th"))).alias("stays")), "near")
    dropped = materialize(found.where("not stays").select("doc_id", "key"), "dropped")
    repeated = materialize(found.where("stays").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "repeats")
    release(found)
    return keep_once(docs, F.xxhash64(text_or_empty("text")), dropped, repeated)
