"""What stages of a cleaning run report about a corpus. A stage's documents and its report are two plans over one input."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import quality as ql
from tessera.operators.corpus import corpus_hash

# Joiners that cleaning keeps.
JOINERS = {"zwnj": "‌", "zwj": "‍"}


def _escapes(text: Column) -> Column:
    """0 without an entity, 1 with one, 2 when unescaping once leaves some."""

    def level(t: str) -> int:
        once = html.unescape(t)
        return 0 if once == t else 1 if html.unescape(once) == once else 2

    found = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else level(t)).astype("Int64"), "long")(F.when(text.contains("&"), text))
    return F.coalesce(found, F.lit(0))


def findings(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keep, the cleaned text, and what cleaning found: entities, double escapes, characters of each noise class, runs of
    white space, joiners kept."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, raw.alias("__raw"), tx.unescape_nfc(raw).alias("__plain"), _escapes(raw).alias("__level"))
    rows = rows.withColumn("cleaned", tx.collapse_space(tx.strip_noise(F.col("__plain"))))
    joiners = [tx.literal_count(F.col("cleaned"), j).alias(f"joiner_{k}") for k, j in JOINERS.items()]
    return rows.select(
        *keep,
        "cleaned",
        (F.col("__level") > 0).cast("long").alias("entities"),
        (F.col("__level") > 1).cast("long").alias("double_escaped"),
        *[tx.noise_count(F.col("__plain"), k).alias(k) for k in tx.NOISE_CLASSES],
        F.regexp_count(F.col("__plain"), F.lit(tx.SPACE + "{2,}")).cast("long").alias("space_runs"),
        *joiners,
        F.length("__raw").cast("long").alias("chars_before"),
        F.length("cleaned").cast("long").alias("chars_after"),
        tx.content_hash(F.col("__raw")).alias("raw_hash"),
    )


def normalise_report(found: DataFrame) -> DataFrame:
    """One row of findings(): sums, documents that cleaned to nothing, and how many more copies hashing sees after cleaning."""
    sums = [F.sum(c).alias(c) for c in found.columns if c not in ("doc_id", "cleaned", "raw_hash")]
    filled = F.when(F.col("cleaned") != "", F.col("cleaned"))
    gained = (F.count(filled) - F.count_distinct(F.sha2(filled, 256))) - (F.count("*") - F.count_distinct("raw_hash"))
    return found.agg(F.count("*").alias("docs_in"), F.count(filled).alias("docs_out"), *sums, gained.alias("collisions_gained"))


def survival(measured: DataFrame, by: str = "source") -> DataFrame:
    """measures() with a corpus column -> (corpus, docs, english, aware, survives): documents that fail under English rules
    and under script-aware ones, of which the latter decide."""
    failing = lambda aware: ~F.least(*ql.verdicts(measured, aware).values())
    rows = measured.select(F.col(by).alias("corpus"), failing(False).alias("e"), failing(True).alias("a"))
    return rows.groupBy("corpus").agg(F.count("*").alias("docs"), F.count_if("e").alias("english"), F.count_if("a").alias("aware"), F.round(1 - F.count_if("a") / F.count("*"), 4).alias("survives"))


def bias(survived: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """(group, mean) of the corpora's survival, for named groups of them."""
    name = F.coalesce(*[F.when(F.col("corpus").isin(*some), F.lit(k)) for k, some in groups.items()])
    return survived.select(name.alias("group"), "survives").where("group is not null").groupBy("group").agg(F.round(F.avg("survives"), 4).alias("mean"))


def quality_survivors(docs: DataFrame, measured: DataFrame, gate: float | None = None) -> DataFrame:
    """docs whose measures() pass all script-aware rules, and where a gate is given also its points."""
    judged = ql.judged(measured)
    kept = judged.where(F.size("failing") == 0)
    if gate is not None:
        kept = kept.where(F.col("gate") >= gate)
    return docs.join(kept.select("doc_id"), "doc_id", "left_semi")


def masked_by_corpus(masked: DataFrame, corpora: DataFrame, by: str = "source") -> DataFrame:
    """masked(doc_id, spans), corpora(doc_id, corpus) -> (corpus, n_spans, n_docs) of documents with any span."""
    rows = masked.where(F.size("spans") > 0).select("doc_id", F.size("spans").alias("k")).join(corpora.select("doc_id", by), "doc_id")
    return rows.groupBy(F.col(by).alias("corpus")).agg(F.sum("k").cast("long").alias("n_spans"), F.count("*").alias("n_docs"))


def manifest(docs: DataFrame, stages: tuple[str, ...], identity: dict[str, str], lang: str = "lang") -> DataFrame:
    """One row that identifies a run: documents, hash of the content, documents by claimed language (the most frequent
    first), the stages, and what identity says of configuration and code. No clock is part of it."""
    claimed = docs.groupBy(F.coalesce(F.nullif(F.col(lang), F.lit("")), F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "lang"))), lambda x: F.struct(x["lang"].alias("lang"), (-x["k"]).alias("n")))
    languages = claimed.agg(ordered.alias("languages"))
    row = corpus_hash(docs).crossJoin(languages)  # of one row each
    return row.select(F.col("n").alias("documents"), F.col("corpus_hash").alias("content_hash"), "languages", F.array(*map(F.lit, stages)).alias("stages"), *[F.lit(v).alias(k) for k, v in sorted(identity.items())])


def stage_summary(before: DataFrame, after: DataFrame, name: str, rejections: dict[str, int] | None = None) -> dict:
    """A stage's record: documents in and out, and rejections by reason."""
    return {"stage": name, "docs_in": before.count(), "docs_out": after.count(), "rejections": dict(rejections or {})}


def by_rule(judged_rows: DataFrame) -> pd.DataFrame:
    """Failures of each rule as a small frame, the most frequent first (nine rows at most)."""
    each = judged_rows.select(F.explode_outer("failing").alias("rule")).where("rule is not null")
    return each.groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").toPandas()
