"""Decontamination with canaries, and an attributed index of benchmark items at several widths."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import let, lower_words
from tessera.sources.tables import cut

WIDEST, NARROWEST = 13, 6


def canaries(spark: SparkSession, n: int, width: int = WIDEST, seed: int = 0) -> DataFrame:
    """(canary, text): n seeded strings of width + 2 made-up words, for planting into a corpus."""
    word = lambda i, j: "zq" + hashlib.sha256(f"{seed}:{i}:{j}".encode()).hexdigest()[:8]
    return spark.createDataFrame([(i, " ".join(word(i, j) for j in range(width + 2))) for i in range(n)], "canary int, text string")


def coverage(held_out_items: int, canary_items: int) -> str:
    """What a verdict rests on; without an index nothing is ever called clean."""
    return "held-out" if held_out_items else "canary-only" if canary_items else "unchecked"


def digests(tokens: Column, n: Column | int) -> Column:
    """Distinct digests of the runs of n tokens; none for shorter arrays."""
    none = F.array().cast("array<string>")
    runs = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.md5(F.array_join(F.slice(t, i, n), " "))))
    return let(tokens, lambda t: F.when(F.size(t) >= n, runs(t)).otherwise(none))


def item_index(items: DataFrame, benchmark: Column, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(width, digest, benchmark): each item's runs of min(its words, 13) words; an item of fewer than 6 words is refused.
    A digest of several benchmarks belongs to that of the least item id."""
    words = items.select(F.col(item_id).alias("ord"), benchmark.alias("benchmark"), lower_words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    sized = words.withColumn("width", F.least(F.size("w"), F.lit(WIDEST))).where(F.col("width") >= NARROWEST)
    each = sized.select("ord", "benchmark", "width", F.explode(digests(F.col("w"), F.col("width"))).alias("digest"))
    return each.groupBy("width", "digest").agg(F.min_by("benchmark", F.struct("ord", "benchmark")).alias("benchmark"))


def refused(items: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: how many items the index takes at full width, at a narrower one, and refuses."""
    n = items.select(F.size(lower_words(F.coalesce(F.col(text_col), F.lit("")))).alias("n"))
    return n.agg(F.count_if(F.col("n") >= WIDEST).alias("full"), F.count_if(F.col("n").between(NARROWEST, WIDEST - 1)).alias("narrow"), F.count_if(F.col("n") < NARROWEST).alias("refused"))


def collisions(docs: DataFrame, index: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, benchmark, n_hits): distinct digests of the index in each document. Documents are cut once at each width
    that the index holds (at most eight values, read first); digests meet in one equi-join, and only hits are counted."""
    held = sorted(r["width"] for r in index.select("width").distinct().collect()) or [WIDEST]
    words = docs.select("doc_id", lower_words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    widths = F.array(*[F.struct(F.lit(n).alias("width"), digests(F.col("w"), n).alias("d")) for n in held])
    cut = words.select("doc_id", F.inline(widths)).select("doc_id", "width", F.explode("d").alias("digest"))
    return cut.join(index, ["width", "digest"]).groupBy("doc_id", "benchmark").agg(F.count("*").alias("n_hits"))


def recovered(docs: DataFrame, planted: DataFrame, text_col: str = "text") -> DataFrame:
    """(canary, recovered): planted strings whose runs of WIDEST words the same join finds in docs; all must be."""
    index = planted.select("canary", F.explode(digests(lower_words(F.col("text")), WIDEST)).alias("digest"))
    found = docs.select(F.explode(digests(lower_words(F.coalesce(F.col(text_col), F.lit(""))), WIDEST)).alias("digest"))
    hit = index.join(found, "digest", "left_semi").select("canary").distinct()
    return hit.withColumn("recovered", F.lit(True))


def decontaminated(docs: DataFrame, items: DataFrame, planted: DataFrame | None = None, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents without a run of WIDEST words of any item or canary, report): the report is one row (docs_in, flagged,
    canary_only, docs_out, coverage). Without items and canaries nothing is checked, and the coverage says so."""
    runs = lambda rows: rows.select(F.explode(digests(lower_words(F.coalesce(F.col(text_col), F.lit(""))), WIDEST)).alias("digest"))
    index = runs(items).withColumn("held", F.lit(True))
    if planted is not None:
        index = index.unionByName(planted.select(F.explode(digests(lower_words(F.col("text")), WIDEST)).alias("digest"), F.lit(False).alias("held")))
    index = index.groupBy("digest").agg(F.max("held").alias("held"))
    each = docs.select("doc_id", F.explode(digests(lower_words(F.coalesce(F.col(text_col), F.lit(""))), WIDEST)).alias("digest"))
    flagged = cut(each.join(index, "digest").groupBy("doc_id").agg(F.max("held").alias("held")))
    n = docs.agg(F.count("*").alias("docs_in"))
    gone = flagged.agg(F.count("*").alias("flagged"), F.count_if(~F.col("held")).alias("canary_only"))
    said = index.agg(F.when(F.count_if("held") > 0, "held-out").when(F.count("*") > 0, "canary-only").otherwise("unchecked").alias("coverage"))
    report = n.crossJoin(gone).crossJoin(said).select("docs_in", "flagged", "canary_only", (F.col("docs_in") - F.col("flagged")).alias("docs_out"), "coverage")  # of one row each
    return docs.join(flagged.select("doc_id"), "doc_id", "left_anti"), report
