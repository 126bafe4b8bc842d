"""Cleaning-pipeline operators on documents: reading budgets, hashing, exact dedup, personal data, decontamination and
manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import content_hash, grams, lower_words
from tessera.sources.tables import cut

#: White space of all scripts as the characters themselves, which every engine reads alike.
_S = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SEP = _S[:-1] + ".-]"
# Structured personal data, with guards on both sides.
PII_PATTERNS = {
    "email": rf"(?<![\p{{L}}\p{{N}}_.+-])[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]{{2,}}(?![\p{{L}}\p{{N}}_.-])",
    "phone": rf"(?<![\p{{L}}\p{{N}}_.])(?:\+\p{{Nd}}{{1,3}}{_SEP}?\p{{Nd}}{{3,5}}{_SEP}?\p{{Nd}}{{4,6}}|\(\p{{Nd}}{{3}}\){_S}?\p{{Nd}}{{3}}{_SEP}?\p{{Nd}}{{4}}|\p{{Nd}}{{3}}{_SEP}\p{{Nd}}{{3}}{_SEP}\p{{Nd}}{{4}}|[6-9]\p{{Nd}}{{9}})(?![\p{{L}}\p{{N}}_.])",
    "ipv4": r"(?<![\p{L}\p{N}_.])(?:(?:25[0-5]|2[0-4]\p{Nd}|1\p{Nd}{2}|[1-9]?\p{Nd})\.){3}(?:25[0-5]|2[0-4]\p{Nd}|1\p{Nd}{2}|[1-9]?\p{Nd})(?![\p{L}\p{N}_.])",
    "mac": r"(?<![\p{L}\p{N}_:])(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}(?![\p{L}\p{N}_:])",
    "aadhaar": rf"(?<!\p{{Nd}})\p{{Nd}}{{4}}{_S}\p{{Nd}}{{4}}{_S}\p{{Nd}}{{4}}(?!\p{{Nd}})",
    "pan": r"(?<![A-Z0-9])[A-Z]{5}\p{Nd}{4}[A-Z](?![A-Z0-9])",
}


def chunked(docs: DataFrame, chunk: int, order: str, by: str) -> DataFrame:
    """docs with __chunk, the number of a row's run of `chunk` rows within its shard. Rows are numbered within ranges of
    (shard, order), and a range's first number is the running count of the shard's ranges before: no task sorts a shard."""
    ranged = cut(docs.repartitionByRange(F.col(by).asc_nulls_first(), F.col(order).asc_nulls_first()).withColumn("__part", F.spark_partition_id()))
    at = F.row_number().over(Window.partitionBy("__part", by).orderBy(F.col(order).asc_nulls_first())) - 1
    sizes = ranged.groupBy("__part", by).agg(F.count("*").alias("n"))  # one row a range and shard
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("__part").alias("__p"), F.col(by).alias("__b"), before.alias("__before"))
    placed = ranged.withColumn("__at", at).join(offsets, (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__b")))
    return placed.withColumn("__chunk", F.floor((F.col("__before") + F.col("__at")) / chunk)).drop("__part", "__p", "__b", "__before", "__at")


def budgeted(docs: DataFrame, tokens: Column, budget: int, chunk: int = 200, order: str = "doc_id", by: str = "source") -> DataFrame:
    """Of each shard, in order (unique within a shard; ties fall anyhow), whole chunks of rows until the running token total
    reaches the budget. The running sum is over one row a chunk."""
    numbered = chunked(docs.select("*", tokens.alias("__tokens")), chunk, order, by)
    return _of_chunks(numbered, _running(numbered, by).where(F.col("__before") < budget), by)


def _running(numbered: DataFrame, by: str) -> DataFrame:
    """(shard, __chunk, __before, __upto): token totals before and including each chunk."""
    sums = numbered.groupBy(by, "__chunk").agg(F.sum("__tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, 0))
    return sums.select(by, "__chunk", (upto - F.col("n")).alias("__before"), upto.alias("__upto"))


def _of_chunks(numbered: DataFrame, chosen: DataFrame, by: str) -> DataFrame:
    some = chosen.select(F.col(by).alias("__b"), F.col("__chunk").alias("__c"))
    return numbered.join(some, F.col(by).eqNullSafe(F.col("__b")) & (F.col("__chunk") == F.col("__c")), "left_semi").drop("__tokens", "__chunk")


def budgeted_corpus(docs: DataFrame, tokens: Column, budget: int, chunk: int = 200, order: str = "doc_id", by: str = "source") -> DataFrame:
    """One budget for all shards, which are read in order of their names: each takes what is left divided by the shards left
    (1 at least), in whole chunks, so what a small shard leaves goes to those after it; nothing once the budget is met.
    The walk over the shards, a short list, asks one aggregate of each and never holds their rows."""
    numbered = cut(chunked(docs.select("*", tokens.alias("__tokens")), chunk, order, by))
    running = cut(_running(numbered, by))
    names = [r[0] for r in running.select(by).distinct().orderBy(F.col(by).asc_nulls_first()).collect()]
    counted, chosen = 0, None
    for i, name in enumerate(names):
        if counted >= budget:
            break
        share = max((budget - counted) // (len(names) - i), 1)
        of = running.where(F.col(by).eqNullSafe(F.lit(name)) & (F.col("__before") < share))
        counted += of.agg(F.max("__upto")).first()[0] or 0
        chosen = of if chosen is None else chosen.unionByName(of)
    return docs.where("false") if chosen is None else _of_chunks(numbered, chosen, by)


def probed(docs: DataFrame, limit: int, order: str = "doc_id") -> DataFrame:
    """The first documents by count, for sources whose tokens can't be measured: a capped read is the feature."""
    return docs.orderBy(order).limit(limit)


def exact_first(docs: DataFrame, order: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id of the first in load order, hash, cluster size) of each distinct text; partial aggregates, no window."""
    return docs.groupBy(content_hash(F.coalesce(F.col(text_col), F.lit(""))).alias("hash")).agg(F.min(order).alias("keep_id"), F.count("*").alias("n"))


def pii_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, a count of each kind of structured personal data)."""
    return docs.select("doc_id", *[F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(p)).cast("long").alias(f"n_{k}") for k, p in PII_PATTERNS.items()])


def contaminated(docs: DataFrame, items: DataFrame, n: int = 13, text_col: str = "text") -> DataFrame:
    """(doc_id, n_hits): documents that share word n-grams with benchmark items, and how many distinct ones. Grams meet
    in an equi-join whose sides are deduplicated before the shuffle."""
    index = items.select(F.explode(grams(lower_words(F.col(text_col)), n)).alias("gram")).distinct()
    found = docs.select("doc_id", F.explode(grams(lower_words(F.col(text_col)), n)).alias("gram"))
    return found.join(index, "gram", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_hits"))


def corpus_hash(docs: DataFrame, buckets: int = 4096, text_col: str = "text") -> DataFrame:
    """One row: n documents and an order-independent hash of the corpus. Hashes are sorted and digested within buckets
    of their leading hex digits, then the buckets' digests in order, so that no task holds all of them."""
    width = len(f"{buckets - 1:x}")
    each = docs.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("h")).select("h", F.left("h", F.lit(width)).alias("b"))
    parts = each.groupBy("b").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"))
    return parts.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("corpus_hash"))
