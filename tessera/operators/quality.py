"""Nine quality rules, each judged for English alone and aware of the text's script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import SPACE, collapse_space, collapsed_sentences, letters, literal_count

# Thresholds and word lists of the rules.
MEAN_WORD_LENGTH, SYMBOLS, TERMINAL, DUPLICATES, TOP_BIGRAM, STOP_WORDS, BULLETS, ELLIPSES, WORDS = (3.0, 10.0), 0.10, 0.30, 0.30, 0.20, 2, 0.90, 0.30, (50, 100_000)
ENGLISH_MARKS, SCRIPT_MARKS = ".!?", ".!?।॥…"
STOP_WORD_LISTS = {
    "Latin": ("the", "be", "to", "of", "and", "that", "have", "with"),
    "Devanagari": ("के", "में", "की", "है", "और", "को", "से", "का", "एक", "पर"),
    "Telugu": ("మరియు", "ఒక", "ఈ", "అని", "కు", "లో", "తో", "నుండి", "ఆ", "చేసిన"),
    "Bengali": ("এবং", "এই", "করে", "থেকে", "হয়", "তার", "সঙ্গে", "একটি", "না", "যে"),
}
RULES = ("mean_word_length", "symbol_to_word_ratio", "terminal_punctuation", "duplicate_lines", "top_bigram", "stop_words", "bullet_lines", "ellipsis_lines", "word_count")


def longest_run(sorted_values: Column) -> Column:
    """Length of the longest run of equal values in a sorted array."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, v: Column) -> Column:
        run = F.when(v.eqNullSafe(acc["last"]), acc["run"] + 1).otherwise(1)
        return F.struct(v.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(sorted_values, start, step, lambda acc: acc["best"])


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", script: Column | None = None) -> DataFrame:
    """keep and the figures that the rules judge. Shares over no lines or words take one as the count."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*keep, text.alias("t"), collapse_space(text).alias("c"), (script if script is not None else F.lit("Latin")).alias("script"))
    split = lambda c: F.array_remove(F.split(c, " "), "")
    base = base.select("*", split(F.col("c")).alias("w"), collapsed_sentences(F.col("c")).alias("s"), split(F.lower("c")).alias("l"))
    n_words, n_lines = F.greatest(F.size("w"), F.lit(1)), F.greatest(F.size("s"), F.lit(1))
    share = lambda f: F.size(F.filter("s", f)) / n_lines
    pairs = F.zip_with(F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0))), F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    listed = F.lit(None).cast("array<string>")
    for name, some in STOP_WORD_LISTS.items():
        listed = F.when(F.col("script") == name, F.array(*map(F.lit, some))).otherwise(listed)
    english = F.array(*map(F.lit, STOP_WORD_LISTS["Latin"]))
    return base.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        (letters(F.col("t")) / n_words).alias("mean_word_length"),
        ((literal_count(F.col("t"), "#") + literal_count(F.col("t"), "…") + literal_count(F.col("t"), "...")) / n_words).alias("symbols"),
        share(lambda x: F.right(x, F.lit(1)).isin(*ENGLISH_MARKS)).alias("terminal_english"),
        share(lambda x: F.right(x, F.lit(1)).isin(*SCRIPT_MARKS)).alias("terminal_aware"),
        (1 - F.size(F.array_distinct("s")) / n_lines).alias("duplicates"),
        (longest_run(F.sort_array(pairs)) / F.greatest(F.size("w") - 1, F.lit(1))).alias("top_bigram"),
        F.size(F.array_intersect("l", english)).cast("long").alias("stops_english"),
        F.size(F.array_intersect("l", F.coalesce(listed, english))).cast("long").alias("stops_aware"),
        share(lambda x: x.rlike(rf"^{SPACE}*[-*•·‣▪]|^{SPACE}*[0-9]+[.)]{SPACE}")).alias("bullets"),
        share(lambda x: x.rlike(rf"(\.\.\.|…){SPACE}*$")).alias("ellipses"),
    )


def verdicts(measured: DataFrame, aware: bool = True) -> dict[str, Column]:
    which = "aware" if aware else "english"
    return dict(
        zip(
            RULES,
            (
                F.col("mean_word_length").between(*MEAN_WORD_LENGTH),
                F.col("symbols") < SYMBOLS,
                F.col(f"terminal_{which}") >= TERMINAL,
                F.col("duplicates") < DUPLICATES,
                F.col("top_bigram") < TOP_BIGRAM,
                F.col(f"stops_{which}") >= STOP_WORDS,
                F.col("bullets") < BULLETS,
                F.col("ellipses") < ELLIPSES,
                F.col("n_words").between(*WORDS),
            ),
        )
    )


def judged(measured: DataFrame, aware: bool = True) -> DataFrame:
    """measured with a boolean column for each rule, the failing rules, and the share of rules passed out of five points."""
    v = verdicts(measured, aware)
    failing = F.array_compact(F.array(*[F.when(~c, F.lit(r)) for r, c in v.items()]))
    return measured.select("*", *[c.alias(f"ok_{r}") for r, c in v.items()], failing.alias("failing"), F.round(5.0 * (len(v) - F.size(failing)) / len(v), 2).alias("gate"))


def failures(judged_rows: DataFrame, by: str = "source") -> DataFrame:
    """Failures by rule and by corpus and rule in one pass. The outer form of explode keeps the planner from filtering
    by the size of the array first, which would compute every measure once more."""
    each = judged_rows.select(by, F.explode_outer("failing").alias("rule")).where("rule is not null")
    return each.groupingSets([["rule"], [by, "rule"]], by, "rule").agg(F.count("*").alias("n"))
