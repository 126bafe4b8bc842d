"""Language identification by Bayesian evidence fusion.

log posterior = log prior of the host + tempered log likelihood of the text + log likelihoods of the declared markup
language and of the address suffix. Text likelihoods are hashed character trigrams counted over all labelled documents.
The other terms come from grouped aggregation over all pages: the text-only posteriors are summed by declared language,
by suffix and by host; host priors are smoothed by their domain's, those by their suffix's, those by the whole's.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, text_or_empty
from tessera.llm.url_filter import host_of

BUCKETS = 1 << 14
#: Trigrams are far from independent: a text's likelihood counts as that of at most so many of them.
EFFECTIVE_TRIGRAMS = 60
SMOOTHING, PRIOR_WEIGHT, EVIDENCE_SMOOTHING = 0.5, 4.0, 1.0
#: More distinct languages than this are taken for a wrong column and raise; at most so many profiles reach the driver.
MOST_LANGUAGES = 400

_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"<[^>]*>")


def visible_text(markup: str) -> str:
    return html_lib.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", markup)))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed trigrams of the lower-cased letters, each run of anything else being one space."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    c = np.where(((c >= 97) & (c <= 122)) | (c > 127), c, np.uint64(32))
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
    if len(c) < 3:
        return np.zeros(BUCKETS, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(50)
    return np.bincount(h.astype(np.int64), minlength=BUCKETS)


def train_profiles(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """docs(lang, text) -> languages and their log probabilities of the buckets, from all rows with a language. One
    profile a language reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += trigram_counts(text.as_py())
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    known = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), text_or_empty("text").alias("text"))
    counts = known.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def profile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = np.zeros(BUCKETS)
        row[pdf["bucket"].to_numpy(int)] = pdf["n"].to_numpy(float)
        return pd.DataFrame({"lang": [key[0]], "counts": [row.tobytes()]})

    rows = counts.groupBy("lang").applyInPandas(profile, "lang string, counts binary").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = sorted(rows, key=lambda r: r["lang"])
    langs = [r["lang"] for r in rows] or ["und"]
    table = np.array([np.frombuffer(r["counts"]) for r in rows] or [np.zeros(BUCKETS)]) + SMOOTHING
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def text_evidence(pages: DataFrame, profiles: np.ndarray, markup: bool) -> DataFrame:
    """pages(..., text last) -> the same columns, with log likelihoods in place of the text."""
    names = pages.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(batch.num_columns - 1):
                n = trigram_counts(visible_text(t.as_py()) if markup else t.as_py())
                total = int(n.sum())
                ll = profiles @ n * (min(total, EFFECTIVE_TRIGRAMS) / total) if total else np.zeros(len(profiles))
                out.append((ll - ll.max()).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], [*names, "ll"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields[:-1])
    return pages.mapInArrow(run, f"{fields}, ll array<double>")


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, keys: list[str], n: int, out: str) -> DataFrame:
    """The sum of the posteriors p over each key, partially aggregated before the shuffle."""
    each = df.groupBy(*keys).agg(*[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)])
    return each.select(*keys, F.array(*[F.col(f"s{i}") for i in range(n)]).alias(out))


def _smoothed(sums: Column, parent: Column) -> Column:
    total = F.aggregate(sums, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(sums, parent, lambda s, q: (s + PRIOR_WEIGHT * q) / (total + PRIOR_WEIGHT))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, host, declared, suffix, text_lang, lang, confidence.

    Languages are those of docs(lang, text). Null or empty markup gives even text likelihoods; a missing declaration,
    suffix or host gives no evidence. Ties go to the first language by name. A page's own posterior counts in its host's
    prior, as in any empirical prior. Repeated rows count each; an empty table gives an empty table; without labelled
    documents the only language is `und`."""
    langs, profiles = train_profiles(docs)
    n = len(langs)
    host = F.regexp_replace(host_of(F.col(url_col)), r"^[^@]*@|:\d*$", "")
    markup = text_or_empty(html_col)
    declared = F.lower(F.regexp_extract(markup, r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z]{2,3})\b""", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(declared, F.lit("")).alias("declared"), markup.alias("markup"))
    rows = rows.select("page_id", "host", F.regexp_extract("host", r"[^.]+\.[^.]+$", 0).alias("domain"), F.regexp_extract("host", r"\.([^.]+)$", 1).alias("suffix"), "declared", "markup")
    seen = text_evidence(rows, profiles, True).withColumn("p", softmax(F.col("ll")))
    seen = materialize(seen, "evidence")

    whole = seen.agg(*[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]).first()
    shares = [(whole[i] or 0.0) + EVIDENCE_SMOOTHING for i in range(n)]
    shares = F.array(*[F.lit(s / sum(shares)) for s in shares])

    def given_language(key: str) -> DataFrame:
        """(key, e): log P(key | language) up to a constant, the sums of a key over those of its language."""
        sums = _sums(seen.where(F.col(key) != ""), [key], n, "s")
        return sums.select(key, F.zip_with("s", shares, lambda s, q: F.log((s + EVIDENCE_SMOOTHING * q) / q)).alias(f"{key}_e"))

    suffixes = _sums(seen, ["suffix"], n, "s").select("suffix", _smoothed(F.col("s"), shares).alias("p_suffix"))
    domains = _sums(seen, ["suffix", "domain"], n, "s").join(suffixes, "suffix").select("suffix", "domain", _smoothed(F.col("s"), F.col("p_suffix")).alias("p_domain"))
    hosts = _sums(seen, ["suffix", "domain", "host"], n, "s").join(domains, ["suffix", "domain"]).select("host", _smoothed(F.col("s"), F.col("p_domain")).alias("prior"))

    none = F.array(*[F.lit(0.0)] * n)
    joined = seen.join(materialize(hosts, "priors"), "host", "left").join(given_language("declared"), "declared", "left").join(given_language("suffix"), "suffix", "left")
    total = F.zip_with(F.zip_with("ll", F.transform("prior", lambda q: F.log(q)), lambda a, b: a + b), F.zip_with(F.coalesce("declared_e", none), F.coalesce("suffix_e", none), lambda a, b: a + b), lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    out = joined.withColumn("posterior", softmax(total))
    return out.select("page_id", "host", "declared", "suffix", best(F.col("p")).alias("text_lang"), best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"))
