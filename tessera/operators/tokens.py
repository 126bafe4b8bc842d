"""Token and unit counts compared between languages and tokenizers: fertility, spread, scores, weights, hold-outs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The penalised language, its limit, the largest share of unknown tokens, and one line of so many held out.
PENALISED, LIMIT, MOST_UNKNOWN, EVERY = "hi", 1.2, 0.05, 5


def usable_count(tokens: Column, unknown: Column) -> Column:
    """tokens, or null when too many of them are unknown: such a count says nothing."""
    return F.when((tokens > 0) & (unknown / tokens <= MOST_UNKNOWN), tokens)


def total_or_unknown(amount: Column) -> Column:
    """A sum that is null when any part is."""
    return F.when(F.count_if(amount.isNull()) == 0, F.sum(amount))


def fertility(counts: DataFrame, key: str = "lang") -> DataFrame:
    """counts(key, tokens, units) -> (key, tokens, units, fertility); 0 where there are no units."""
    sums = counts.groupBy(key).agg(total_or_unknown(F.col("tokens")).alias("tokens"), F.sum("units").alias("units"))
    return sums.withColumn("fertility", F.when(F.col("units") > 0, F.col("tokens") / F.col("units")).otherwise(0.0))


def scores(table: DataFrame, key: str = "lang") -> DataFrame:
    """One row of a fertility table: spread, score (1000 / spread, infinite at none), corpus-wide mean, penalty, adjusted."""
    gap = F.max("fertility") - F.min("fertility")
    one = table.agg(gap.alias("spread"), F.coalesce(F.sum("tokens") / F.nullif(F.sum("units"), F.lit(0)), F.lit(0.0)).alias("mean"), F.max(F.when(F.col(key) == PENALISED, F.col("fertility"))).alias("__x"))
    one = one.withColumn("score", F.when(F.col("spread") > 0, 1000 / F.col("spread")).otherwise(F.lit(float("inf"))))
    one = one.withColumn("penalty", F.coalesce(F.exp(F.greatest(F.lit(0.0), F.col("__x") / LIMIT - 1)), F.lit(1.0))).drop("__x")
    return one.withColumn("adjusted", F.col("score") / F.col("penalty"))


def degrades_best(table: DataFrame, baseline: DataFrame, key: str = "lang") -> DataFrame:
    """One row: whether the baseline's best language became worse."""
    best = baseline.agg(F.min_by(key, F.struct("fertility", key)).alias(key), F.min("fertility").alias("before"))
    return best.join(table.select(key, "fertility"), key, "left").select(key, (F.coalesce("fertility", "before") > F.col("before")).alias("degraded"))


def tokenizer_spread(counts: DataFrame) -> DataFrame:
    """counts(tokenizer, lang, tokens), one row each -> (lang, least, most, ratio) over tokenizers with a known count."""
    t = counts.where("tokens is not null").groupBy("lang").agg(F.min("tokens").alias("least"), F.max("tokens").alias("most"))
    return t.withColumn("ratio", F.col("most") / F.nullif(F.col("least"), F.lit(0)))


def expansion(table: DataFrame, base: str = "en", by: str = "tokenizer", key: str = "lang") -> DataFrame:
    """Fertility of each language against the base language's under the same tokenizer."""
    ref = table.where(F.col(key) == base).select(by, F.col("fertility").alias("base"))
    return table.join(ref, by, "left").select(by, key, "fertility", (F.col("fertility") / F.nullif("base", F.lit(0.0))).alias("expansion"))


def corpus_weights(sizes: DataFrame, mode: str = "balance", key: str = "lang", size: str = "size", manual: dict[str, float] | None = None) -> DataFrame:
    """(key, weight, repeat): flat, manual, balance (largest / size) or sqrt of that; the least weight becomes 1. One row
    a language, so the windows are small."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    balance = F.max(size).over(every) / F.col(size)
    listed = F.lit(1.0)
    for k, w in (manual or {}).items():
        listed = F.when(F.col(key) == k, F.lit(float(w))).otherwise(listed)
    raw = {"flat": F.lit(1.0), "manual": listed, "balance": balance, "sqrt": F.sqrt(balance)}[mode]
    weighed = sizes.select(key, raw.alias("raw")).select(key, (F.col("raw") / F.min("raw").over(every)).alias("weight"))
    return weighed.withColumn("repeat", F.greatest(F.lit(1), F.bround("weight").cast("int")))


def held_out_lines(docs: DataFrame, offset: int = 0, every: int = EVERY, text_col: str = "text") -> DataFrame:
    """(doc_id, pos, line, held_out): one line of `every`, counted from the offset within each document, is held out."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    return lines.withColumn("held_out", F.col("pos") % every == offset % every)


def stability(rows: DataFrame, value: str = "score", by: str = "recipe") -> DataFrame:
    """Mean, sample deviation, least and greatest value of each recipe over its splits."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"), F.min(value).alias("low"), F.max(value).alias("high"))


def parity(table: DataFrame, base: str = "en", target: float = 1.5, by: str = "tokenizer", key: str = "lang") -> DataFrame:
    """(tokenizer, parity, met): the worst fertility of any other language over that of the base language."""
    worst, own = F.max(F.when(F.col(key) != base, F.col("fertility"))), F.max(F.when(F.col(key) == base, F.col("fertility")))
    ratio = worst / F.nullif(own, F.lit(0.0))
    return table.groupBy(by).agg(ratio.alias("parity"), (ratio <= target).alias("met"))


def ranked(results: DataFrame) -> DataFrame:
    """results(spec, adjusted, error) with a place: the best adjusted score first, failures last. One row a run."""
    return results.withColumn("place", F.row_number().over(Window.orderBy(F.col("error").isNotNull(), F.col("adjusted").desc_nulls_last(), "spec")))


#: Distinct words that a worker remembers before it starts anew.
MEMO_ENTRIES = 1 << 17


def counted_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with tokens, words and unknown: what a vocabulary file of the tokenizers library makes of each text. A word
    between white space is encoded once a worker and its counts are summed, which is right for vocabularies that don't
    merge over white space; null counts as empty. The file is read, never trained."""
    from tokenizers import Tokenizer

    made: dict[str, tuple] = {}

    def run(texts: pd.Series) -> pd.DataFrame:
        if path not in made:
            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            unk = getattr(t.model, "unk_token", None)
            made[path] = t, t.token_to_id(unk) if unk else None, {}
        t, unk, memo = made[path]
        out = []
        for text in texts:
            words = text.split()
            n = unknown = 0
            for w in words:
                if w not in memo:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    ids = t.encode(w, add_special_tokens=False).ids
                    memo[w] = len(ids), ids.count(unk)
                a, b = memo[w]
                n += a
                unknown += b
            out.append((n, len(words), unknown))
        return pd.DataFrame(out, columns=["tokens", "words", "unknown"])

    found = F.pandas_udf(run, "tokens long, words long, unknown long")(F.coalesce(F.col(text_col), F.lit("")))
    return docs.withColumn("__c", found).select("*", "__c.tokens", "__c.words", "__c.unknown").drop("__c")


def counted_once(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, words, unknown): each distinct text is counted once, and joined back by its hash."""
    hashed = docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.sha2("text", 256))
    counts = counted_tokens(hashed.select("hash", "text").dropDuplicates(["hash"]), path).drop("text")
    return hashed.select("doc_id", "hash").join(counts, "hash").drop("hash")


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with faithful: whether decoding a text's ids gives the text again."""
    from tokenizers import Tokenizer

    made: dict[str, Tokenizer] = {}

    def run(texts: pd.Series) -> pd.Series:
        t = made.setdefault(path, Tokenizer.from_file(path))
        coded = t.encode_batch(texts.tolist(), add_special_tokens=False)
        return pd.Series([t.decode(c.ids, skip_special_tokens=False) == x for c, x in zip(coded, texts)])

    return docs.withColumn("faithful", F.pandas_udf(run, "boolean")(F.coalesce(F.col(text_col), F.lit(""))))

# What stands before a word, and an unknown character's token.
WORD_START, UNKNOWN = "▁", "<unk>"


def merged(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """A word's symbols after merging: the pair of lowest rank first, everywhere it occurs."""
    parts = list(word)
    while len(parts) > 1:
        best = min(zip(parts, parts[1:]), key=lambda p: ranks.get(p, len(ranks)))
        if best not in ranks:
            break
        out, i = [], 0
        while i < len(parts):
            joined = i + 1 < len(parts) and (parts[i], parts[i + 1]) == best
            out.append(parts[i] + parts[i + 1] if joined else parts[i])
            i += 2 if joined else 1
        parts = out
    return parts


def merge_encode(docs: DataFrame, vocabulary: dict[str, int], merges: list[tuple[str, str]], text_col: str = "text") -> DataFrame:
    """(doc_id, ids) under given merges: NFKC, words between white space with a mark before each; a symbol that the vocabulary
    lacks is the unknown token. A distinct word is merged once a worker."""
    ranks = {m: i for i, m in enumerate(merges)}
    memo: dict[str, list[int]] = {}

    def ids(word: str) -> list[int]:
        if word not in memo:
            if len(memo) >= MEMO_ENTRIES:
                memo.clear()
            memo[word] = [vocabulary.get(s, vocabulary[UNKNOWN]) for s in merged(WORD_START + word, ranks)]
        return memo[word]

    encode = F.pandas_udf(lambda s: pd.Series([[i for w in unicodedata.normalize("NFKC", t).split() for i in ids(w)] for t in s]), "array<int>")
    return docs.select("doc_id", encode(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))


def merge_decode(encoded: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text), words joined by single spaces."""
    of = {i: s for s, i in vocabulary.items()}
    decode = F.pandas_udf(lambda s: pd.Series(["".join(of[i] for i in x).replace(WORD_START, " ").strip() for x in s]), "string")
    return encoded.select("doc_id", decode("ids").alias("text"))
