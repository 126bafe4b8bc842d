"""Languages by character trigrams: scripts, profiles, detection, its grading and report."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import SCRIPTS, collapse_space, sentences

# Runs kept in a profile, weight of a run outside it, shortest text judged, share of a second script from
# which a text switches, factor of the margin.
TOP, UNSEEN, LEAST_CHARS, SWITCH, MARGIN = 2000, -20.0, 40, 0.20, 10
#: More languages than this are taken for a wrong column: a profile of each is sent to all tasks.
MOST_LANGUAGES = 1000
_BOUNDS = sorted((low, high, name) for name, (low, high) in SCRIPTS.items())
_LOW = np.array([b[0] for b in _BOUNDS])
_HIGH = np.array([b[1] for b in _BOUNDS])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def packed_trigrams(text: str) -> np.ndarray:
    """Runs of three characters, 21 bits each, of the text with a space at both ends; the order is that of strings."""
    c = _codes(f" {text} ")
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:] if len(c) > 2 else c[:0]


def unpacked(gram: Column) -> Column:
    text = lambda g: "".join(chr(g >> k & 0x1FFFFF) for k in (42, 21, 0))
    return F.pandas_udf(lambda s: s.map(text), T.StringType())(gram)


def script_counts(text: str) -> dict[str, int]:
    """Letters by script, in order of their first appearance: by the block, else by the first word of the letter's name."""
    codes, first, n = np.unique(_codes(text), return_index=True, return_counts=True)
    at = np.searchsorted(_LOW, codes, side="right") - 1
    known = (at >= 0) & (codes <= _HIGH[at])
    out: dict[str, int] = {}
    for i in np.argsort(first, kind="stable").tolist():
        ch = chr(int(codes[i]))
        if ch.isalpha():
            name = _BOUNDS[at[i]][2] if known[i] else unicodedata.name(ch, "Unknown").split()[0].title()
            out[name] = out.get(name, 0) + int(n[i])
    return out


def dominant(counts: dict[str, int]) -> tuple[str, float, bool]:
    """The script of most letters (the first met of equals), its share, and whether a second one holds SWITCH of them."""
    if not counts:
        return "Unknown", 0.0, False
    name, total = max(counts, key=counts.get), sum(counts.values())
    rest = sorted(counts.values())[:-1]
    return name, counts[name] / total, bool(rest) and rest[-1] / total >= SWITCH


def language_profiles(docs: DataFrame, top: int = TOP, lang: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n, weight) of each language's most frequent character trigrams (ties by gram), weight
    ln((n + 1) / (sum of kept + kept)). Runs are counted in Arrow batches, so that a row leaves a batch for each distinct
    run and not for each character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pd.factorize(np.array(batch.column(0).to_pylist(), object))
            for k, name in enumerate(names[1]):
                found = [packed_trigrams(batch.column(1)[int(i)].as_py()) for i in np.flatnonzero(names[0] == k)]
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    text = collapse_space(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text.alias("text"))
    counted = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= top).drop("r")
    kept = Window.partitionBy("lang")
    weighed = ranked.withColumn("weight", F.log((F.col("n") + 1) / (F.sum("n").over(kept) + F.count("*").over(kept))))
    return weighed.withColumn("gram", unpacked(F.col("gram")))


class Profiles:
    """Profiles as sorted arrays, and the script of each: that of most letters of its runs."""

    def __init__(self, rows: pd.DataFrame):
        self.of: dict[str, tuple[str, np.ndarray, np.ndarray]] = {}
        for lang, part in sorted(rows.groupby("lang"), key=lambda x: x[0]):
            counts: dict[str, int] = {}
            for gram, n in zip(part["gram"], part["n"]):
                for name, k in script_counts(gram).items():
                    counts[name] = counts.get(name, 0) + k * int(n)
            packed = np.array([sum(ord(c) << k for c, k in zip(g, (42, 21, 0))) for g in part["gram"]], np.int64)
            order = np.argsort(packed)
            self.of[lang] = dominant(counts)[0], packed[order], part["weight"].to_numpy(float)[order]

    def judge(self, text: str, chars: int, unseen: float, least_chars: int) -> tuple:
        """(script, share, switched, lang, score, runner_up, confidence, reason) of a text with collapsed white space;
        chars: the length that counts."""
        counts = script_counts(text)
        script, share, switched = dominant(counts)
        if chars < least_chars or not counts:
            return script, share, switched, None, None, None, 0.0, "too short"
        some = [(lang, p, w) for lang, (s, p, w) in self.of.items() if s == script]
        if not some:
            return script, share, switched, None, None, None, 0.0, "no profile of the script"
        grams, n = np.unique(packed_trigrams(text), return_counts=True)
        scores = []
        for lang, packed, weights in some:
            at = np.minimum(np.searchsorted(packed, grams), len(packed) - 1)
            scores.append((float((np.where(packed[at] == grams, weights[at], unseen) * n).sum() / n.sum()), lang))
        scores.sort(key=lambda x: -x[0])  # of equal scores the first by name
        best, second = scores[0][0], scores[1][0] if len(scores) > 1 else None
        confidence = 1.0 if second is None else min(1.0, MARGIN * abs(best - second) / max(abs(best), 1e-9))
        return script, share, switched, scores[0][1], best, second, confidence, ""


def detect_language(docs: DataFrame, profiles: DataFrame, unseen: float = UNSEEN, least_chars: int = LEAST_CHARS, text_col: str = "text") -> DataFrame:
    """One row per row of docs: its columns but the text, then script, script_share, code_switched, detected, score,
    runner_up, confidence, reason.

    Only languages of the text's own script compete, by the mean weight of the text's trigrams. Undecided (null) are texts
    under least_chars or without letters, and those whose script no profile has; null counts as empty. A label in docs is
    never read. Profiles are a bounded table (TOP rows a language) that every task gets."""
    found = profiles.select("lang", "gram", "n", "weight").limit(TOP * MOST_LANGUAGES + 1).toPandas()
    if len(found) > TOP * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    known = Profiles(found)
    names = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*names, collapse_space(text).alias("__text"), F.length(text).alias("__chars"))
    added = [("script", pa.string()), ("script_share", pa.float64()), ("code_switched", pa.bool_()), ("detected", pa.string()), ("score", pa.float64()), ("runner_up", pa.float64()), ("confidence", pa.float64()), ("reason", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chars = batch.column(len(names)), batch.column(len(names) + 1).to_pylist()
            out = list(zip(*(known.judge(t.as_py(), k, unseen, least_chars) for t, k in zip(texts, chars)))) or [()] * len(added)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(o, t) for o, (_, t) in zip(out, added))], [*names, *(n for n, _ in added)])

    fields = [*docs.select(*names).schema.fields, *T._parse_datatype_string("script string, script_share double, code_switched boolean, detected string, score double, runner_up double, confidence double, reason string").fields]
    return rows.mapInArrow(run, T.StructType(fields))


def graded_languages(docs: DataFrame, profiles: DataFrame, lengths: tuple[int, ...] = (1, 2, 5), text_col: str = "text") -> DataFrame:
    """docs(lang, text) -> (sentences, lang, documents, accuracy, by_script): each text is cut into documents of so many
    sentences and judged; by_script is what guessing among the languages of one script would get. lang is null for all.
    Give texts that the profiles were not made from."""
    units = docs.where(F.col("lang").isNotNull()).select("lang", sentences(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))

    def cut(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("s"), F.lit(1)), F.lit(n))
        return F.struct(F.lit(n).alias("sentences"), F.transform(starts, lambda i: F.array_join(F.slice("s", i, n), " ")).alias("texts"))

    cuts = F.array(*map(cut, lengths))
    each = units.where(F.size("s") > 0).select("lang", F.inline(cuts)).select("lang", "sentences", F.explode("texts").alias("text"))
    scripts = Profiles(profiles.select("lang", "gram", "n", "weight").toPandas()).of
    peers = {lang: sum(s == script for s, _, _ in scripts.values()) for lang, (script, _, _) in scripts.items()}
    chance = F.coalesce(*[F.when(F.col("lang") == k, 1.0 / n) for k, n in peers.items()], F.lit(None).cast("double"))
    hit = (F.col("detected").eqNullSafe(F.col("lang"))).cast("double")
    judged = detect_language(each, profiles).where(chance.isNotNull())
    return judged.groupingSets([["sentences"], ["sentences", "lang"]], "sentences", "lang").agg(F.count("*").alias("documents"), F.round(F.avg(hit), 4).alias("accuracy"), F.round(F.avg(chance), 4).alias("by_script"))


def language_report(detected: DataFrame, profiles: DataFrame, claimed: str = "lang", top: int = 20) -> DataFrame:
    """(kind, key, n): documents by detected language and by script, those that switch or are undecided, the most frequent
    contradictions `claimed->detected`, and claimed languages without a profile, which can be neither confirmed nor
    contradicted. Nothing is dropped from the corpus."""
    adjudicable = profiles.select(F.col("lang").alias("__known")).distinct()
    rows = detected.join(F.broadcast(adjudicable), F.col(claimed) == F.col("__known"), "left")
    decided, named = F.col("detected").isNotNull(), F.coalesce(F.col(claimed), F.lit("")) != ""
    differs = decided & named & (F.col("detected") != F.col(claimed))
    kinds = F.array_compact(
        F.array(
            F.struct(F.lit("detected").alias("kind"), F.coalesce("detected", F.lit("undecided")).alias("key")),
            F.struct(F.lit("script").alias("kind"), F.col("script").alias("key")),
            F.when(F.col("code_switched"), F.struct(F.lit("code_switched").alias("kind"), F.lit("").alias("key"))),
            F.when(differs & F.col("__known").isNotNull(), F.struct(F.lit("mismatch").alias("kind"), F.concat(F.col(claimed), F.lit("->"), F.col("detected")).alias("key"))),
            F.when(differs & F.col("__known").isNull(), F.struct(F.lit("unadjudicable").alias("kind"), F.col(claimed).alias("key"))),
        )
    )
    counts = rows.select(F.inline(kinds)).groupBy("kind", "key").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "key")
    return counts.withColumn("r", F.row_number().over(w)).where((F.col("kind") != "mismatch") | (F.col("r") <= top)).drop("r")


def readability(counts: DataFrame, most_unknown: float = 0.05) -> DataFrame:
    """counts(lang, tokens, words, unknown), one row a text -> (lang, unknown_share, tokens_per_word, admitted, wave):
    a tokenizer reads a language when at most most_unknown of its tokens are unknown; waves admit the cheapest first."""
    sums = counts.groupBy("lang").agg(F.sum("tokens").alias("t"), F.sum("words").alias("w"), F.sum("unknown").alias("u"))
    out = sums.select("lang", (F.col("u") / F.nullif("t", F.lit(0))).alias("unknown_share"), (F.col("t") / F.nullif("w", F.lit(0))).alias("tokens_per_word"))
    out = out.withColumn("admitted", F.coalesce(F.col("unknown_share") <= most_unknown, F.lit(False)))
    return out.withColumn("wave", F.row_number().over(Window.orderBy(F.desc("admitted"), F.col("tokens_per_word").asc_nulls_last(), "lang")))  # one row a language
