"""Conversations: turns to text, renderings in several formats and what each costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import collapse_space, let, literal_count, strip

#: Formats in which a conversation is rendered.
FORMATS = ("content", "samvaad", "chatml", "alpaca", "header")


def _marked(role: Column, user: str, assistant: str, other: str) -> Column:
    return F.when(role.isin("user", "human"), user).when(role.isin("assistant", "gpt"), assistant).otherwise(other)


def _piece(fmt: str, role: Column, text: Column) -> tuple[Column, str]:
    """A turn in a format, and what stands between turns."""
    if fmt == "content":
        return text, "\n\n"
    if fmt == "samvaad":
        return F.concat(_marked(role, "[USER]", "[ASSISTANT]", "[SYSTEM]"), F.lit(" "), text), " "
    if fmt == "chatml":
        return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n")), ""
    if fmt == "alpaca":
        return F.concat(F.when(role.isin("user", "human"), "### Instruction:").otherwise("### Response:"), F.lit("\n"), text, F.lit("\n")), "\n"
    return F.concat(_marked(role, "Q:", "A:", "Note:"), F.lit(" "), text), "\n"


def rendered(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, turns, a column for each format). Blank turns are dropped but count
    in turns; roles are lower-cased, a missing one is user."""
    role, text = F.lower(F.coalesce(F.col("role"), F.lit("user"))), strip(F.coalesce(F.col("text"), F.lit("")))
    each = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    grouped = each.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    kept = F.filter("all", lambda t: t["text"] != "")

    def column(fmt: str) -> Column:
        between = _piece(fmt, F.lit(""), F.lit(""))[1]
        return F.array_join(F.transform(kept, lambda t: _piece(fmt, t["role"], t["text"])[0]), between).alias(fmt)

    return grouped.select("conv_id", "turns", *[column(f) for f in FORMATS])


def format_costs(conversations: DataFrame, cost: Column | None = None) -> DataFrame:
    """(format, units, overhead, share): each format's length and what it adds to the bare content. One pass."""
    size = lambda f: F.sum(F.length(f)).alias(f)
    one = conversations.agg(*[size(f) for f in FORMATS])
    long = one.select("content", F.explode(F.create_map(*[x for f in FORMATS for x in (F.lit(f), F.col(f))])).alias("format", "units"))
    return long.select("format", "units", (F.col("units") - F.col("content")).alias("overhead"), F.round((F.col("units") - F.col("content")) / F.col("content"), 4).alias("share"))


def cost_per_turn(conversations: DataFrame) -> DataFrame:
    """(format, per_turn): what each format adds to the bare content, over all turns."""
    one = conversations.agg(F.nullif(F.sum("turns"), F.lit(0)).alias("__turns"), *[F.sum(F.length(f)).alias(f) for f in FORMATS])
    long = one.select("__turns", F.col("content").alias("__content"), F.explode(F.create_map(*[x for f in FORMATS for x in (F.lit(f), F.col(f))])).alias("format", "units"))
    return long.select("format", F.round((F.col("units") - F.col("__content")) / F.col("__turns"), 2).alias("per_turn"))


#: Lengths of a turn for which its overhead is told.
TURN_LENGTHS = (15, 50, 200, 2000)


def projected(per_turn: DataFrame, lengths: tuple[int, ...] = TURN_LENGTHS) -> DataFrame:
    """(length, format, share): the part of a turn of that length which the format's marks take."""
    each = per_turn.select("format", "per_turn", F.explode(F.array(*map(F.lit, lengths))).alias("length"))
    return each.select("length", "format", F.round(F.col("per_turn") / F.nullif(F.col("length") + F.col("per_turn"), F.lit(0.0)), 4).alias("share"))


def rebuilt(text: Column, turns: Column) -> Column:
    """An array of turns from a text of which only their number is known: as many equal runs of words; words beyond them
    are left out, and a text of fewer words has fewer turns."""
    w = F.array_remove(F.split(collapse_space(text), " "), "")

    def cut(words: Column) -> Column:
        size = F.greatest(F.lit(1), F.floor(F.size(words) / F.greatest(turns, F.lit(1))).cast("int"))
        starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), size)
        chunks = F.slice(F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " ")), F.lit(1), F.greatest(turns, F.lit(1)))
        return F.when(F.size(words) > 0, chunks).otherwise(F.array().cast("array<string>"))

    return let(w, cut)


def format_report(docs: DataFrame, markers: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """(marker, n, documents): literal role markers in texts, which are counted and never removed."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    each = docs.select(F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), literal_count(t, m).alias("k")) for m in markers])).alias("m")).select("m.*")
    return each.groupBy("marker").agg(F.sum("k").alias("n"), F.count_if(F.col("k") > 0).alias("documents"))


def worst_format(costs: DataFrame) -> DataFrame:
    """One row: the format whose markup takes the greatest share of its own length."""
    own = F.coalesce(F.col("overhead") / F.nullif("units", F.lit(0)), F.lit(0.0))
    return costs.select("format", F.round(own, 4).alias("share")).agg(F.max_by("format", F.struct("share", "format")).alias("format"), F.max("share").alias("share"))
