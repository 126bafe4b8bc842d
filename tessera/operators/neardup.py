"""The near-duplicate pass on documents: candidates by band keys, verified by true similarity, clustered, reported, swept.

Copies come first: documents with one shingle set are one class, represented by its least id, so that copies are never
expanded into pairs. Every pair speaks of two classes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import content_hash, let, lower_words
from tessera.operators import similarity as sm
from tessera.sources.tables import cut

#: Members of a bucket that a task compares with as many others; larger buckets are dealt to pairs of blocks.
BLOCK = 256


def stable_shingles(text: Column, k: int = sm.K) -> Column:
    """Sorted distinct 60-bit hashes (leading hex digits of MD5) of the runs of k words; the whole of a shorter text."""

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1)))
        value = lambda i: F.conv(F.left(F.md5(F.array_join(F.slice(w, i, k), " ")), F.lit(15)), 16, 10).cast("long")
        return F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(F.sort_array(F.array_distinct(F.transform(at, value))))

    return let(lower_words(text), runs)


@dataclass(frozen=True)
class NearPass:
    """members(doc_id, rep): the class of every document; candidates(a, b, jaccard): pairs of representatives that share
    a band; verified: those at the threshold; clusters(rep, cluster): representatives in a verified pair."""

    members: DataFrame
    candidates: DataFrame
    verified: DataFrame
    clusters: DataFrame

    def dropped(self) -> DataFrame:
        """(doc_id, keep_id) of the documents that don't stay: all but the least id of each cluster or class."""
        keep = F.coalesce("cluster", "rep")
        return self.members.join(self.clusters, "rep", "left").where(F.col("doc_id") != keep).select("doc_id", keep.alias("keep_id"))

    def report(self) -> DataFrame:
        """One row: pairs proposed and confirmed, clusters, documents removed, the largest cluster's documents."""
        sizes = self.members.join(self.clusters, "rep", "left").groupBy(F.coalesce("cluster", "rep").alias("c")).agg(F.count("*").alias("k")).where("k > 1")
        found = sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("removed"), F.coalesce(F.max("k"), F.lit(0)).alias("largest"))
        pairs = self.candidates.agg(F.count("*").alias("candidate_pairs"))
        return pairs.crossJoin(self.verified.agg(F.count("*").alias("verified_pairs"))).crossJoin(found)  # of one row each

    def cluster_sizes(self) -> DataFrame:
        """(size, n): how many clusters and classes hold so many documents."""
        sizes = self.members.join(self.clusters, "rep", "left").groupBy(F.coalesce("cluster", "rep").alias("c")).agg(F.count("*").alias("size"))
        return sizes.where("size > 1").groupBy("size").agg(F.count("*").alias("n"))

    def examples(self, limit: int = 60, least: float = 0.05) -> DataFrame:
        """The first pairs by ids, with near misses above `least`; a sample for reading, which is what the limit is for."""
        verdict = F.when(F.col("__v"), "duplicate").otherwise("kept")
        marked = self.candidates.join(self.verified.select("a", "b", F.lit(True).alias("__v")), ["a", "b"], "left")
        shown = marked.where(F.col("__v") | (F.col("jaccard") > least)).select("a", "b", F.round("jaccard", 4).alias("jaccard"), verdict.alias("verdict"))
        return shown.orderBy("a", "b").limit(limit)


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """keys(rep, band key) -> distinct (a, b), a < b, that share one. Members of a bucket are dealt to blocks, and two
    blocks meet in a task of their own, so that no task holds a large bucket."""
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    dealt = keys.join(shared, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("key", "rep", "block", other)
    left = dealt.select("key", F.col("rep").alias("a"), F.col("block").alias("i"), F.col("other").alias("j"))
    right = dealt.select("key", F.col("rep").alias("b"), F.col("other").alias("i"), F.col("block").alias("j"))
    return left.join(right, ["key", "i", "j"]).where("a < b").select("a", "b").distinct()


def clusters_of(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) -> (rep, cluster): the least node that each reaches, by alternating stars on checkpointed edges."""
    edges = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        edges = cut(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            return edges.select(F.col("a").alias("rep"), F.col("b").alias("cluster")).unionByName(edges.select(F.col("b").alias("rep"), F.col("b").alias("cluster")).distinct())
        before = now


def near_pass(docs: DataFrame, bands: int = sm.BANDS, rows: int = sm.ROWS, k: int = sm.K, text_col: str = "text") -> NearPass:
    """docs(doc_id unique, text). Texts without words are one class, alike to each other and to nothing else. The threshold
    is that of the banding, sm.threshold(bands, rows)."""
    sets = cut(docs.select("doc_id", stable_shingles(F.coalesce(F.col(text_col), F.lit("")), k).alias("set")))
    return _passed(sets, bands, rows)


def _passed(sets: DataFrame, bands: int, rows: int) -> NearPass:
    classes = cut(sets.groupBy("set").agg(F.min("doc_id").alias("rep")))
    members = cut(sets.join(classes, "set").select("doc_id", "rep"))
    signed = cut(classes.where(F.size("set") > 0).select("rep", sm.signature(F.col("set"), bands * rows).alias("sig")))
    keys = signed.select("rep", F.explode(sm.band_keys(F.col("sig"), bands, rows)).alias("key"))
    of = lambda name: classes.select(F.col("rep").alias(name), F.col("set").alias(f"s{name}"))
    measured = candidate_pairs(keys).join(of("a"), "a").join(of("b"), "b").select("a", "b", sm.jaccard(F.col("sa"), F.col("sb")).alias("jaccard"))
    candidates = cut(measured)
    verified = candidates.where(F.col("jaccard") >= sm.threshold(bands, rows))
    return NearPass(members, candidates, verified, clusters_of(verified))


def swept(docs: DataFrame, settings: Sequence[tuple[int, int]], k: int = sm.K, text_col: str = "text") -> DataFrame:
    """(bands, rows, threshold, removed, candidate_pairs, verified_pairs) of each setting; shingles are made once."""
    sets = cut(docs.select("doc_id", stable_shingles(F.coalesce(F.col(text_col), F.lit("")), k).alias("set")))
    out = None
    for bands, rows in settings:
        one = _passed(sets, bands, rows).report().select(F.lit(bands).alias("bands"), F.lit(rows).alias("rows"), F.lit(round(sm.threshold(bands, rows), 4)).alias("threshold"), "removed", "candidate_pairs", "verified_pairs")
        out = one if out is None else out.unionByName(one)
    return out


def dedup_stage(docs: DataFrame, by: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents that stay, report by corpus): the first of equal texts stays, then one of each near cluster. The report is
    (corpus, docs_in, exact_duplicate, near_duplicate, docs_out), a null corpus being a corpus of its own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = cut(docs.groupBy(content_hash(text).alias("hash")).agg(F.min("doc_id").alias("doc_id"))).select("doc_id")
    gone = near_pass(docs.join(first, "doc_id", "left_semi"), text_col=text_col).dropped().select("doc_id")
    marks = docs.select("doc_id", by).join(first.withColumn("__first", F.lit(True)), "doc_id", "left").join(gone.withColumn("__near", F.lit(True)), "doc_id", "left")
    exact, near = F.col("__first").isNull(), F.col("__near").isNotNull()
    report = marks.groupBy(F.col(by).alias("corpus")).agg(F.count("*").alias("docs_in"), F.count_if(exact).alias("exact_duplicate"), F.count_if(near).alias("near_duplicate"), F.count_if(~exact & ~near).alias("docs_out"))
    return docs.join(first, "doc_id", "left_semi").join(gone, "doc_id", "left_anti"), report
