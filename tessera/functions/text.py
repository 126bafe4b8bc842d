"""Text scalars as column expressions. Patterns are written so that Java's and RE2's engines read them alike."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that carry no text, by class.
NOISE_CLASSES = {
    "control": r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]",
    "zero_width": r"[\x{200B}\x{200E}\x{200F}\x{2060}-\x{2064}]",
    "bidi": r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]",
    "bom": r"\x{FEFF}",
    "replacement": r"\x{FFFD}",
}
NOISE = "|".join(NOISE_CLASSES.values())
#: White space of all scripts.
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD_RUN = r"[\p{L}\p{N}\p{M}_]+"
#: A run of letters, marks and digits, or one visible symbol.
UNIT_RUN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}" + SPACE[1:]
#: Characters below U+0300 are the same in NFC, whatever stands beside them.
BEYOND_NFC = r"[^\x{00}-\x{2FF}]"
# Literal role markers.
ROLE_MARKERS = ("[USER]", "[ASSISTANT]", "[SYSTEM]", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "### Instruction:", "### Response:")
# First and last code point of each script's block.
SCRIPTS = {
    "Latin": (0x0041, 0x024F), "Devanagari": (0x0900, 0x097F), "Bengali": (0x0980, 0x09FF), "Gurmukhi": (0x0A00, 0x0A7F),
    "Gujarati": (0x0A80, 0x0AFF), "Odia": (0x0B00, 0x0B7F), "Tamil": (0x0B80, 0x0BFF), "Telugu": (0x0C00, 0x0C7F),
    "Kannada": (0x0C80, 0x0CFF), "Malayalam": (0x0D00, 0x0D7F), "Arabic": (0x0600, 0x06FF), "MeeteiMayek": (0xABC0, 0xABFF),
}


def _settle(text: str) -> str:
    while (plain := html.unescape(text)) != text:
        text = plain
    return unicodedata.normalize("NFC", text)


def _where_needed(text: Column, pattern: str, f) -> Column:
    """f, in Arrow batches, of the texts in which a pattern occurs; the others stay in the JVM."""
    changed = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else f(t)), T.StringType())(F.when(text.rlike(pattern), text))
    return F.coalesce(changed, text)


def unescape_nfc(text: Column) -> Column:
    """Entities unescaped until nothing changes, then NFC; Spark has neither."""
    return _where_needed(text, "&|" + BEYOND_NFC, _settle)


def nfc(text: Column) -> Column:
    return _where_needed(text, BEYOND_NFC, lambda t: unicodedata.normalize("NFC", t))


def strip(text: Column) -> Column:
    """text without white space, of any script, at its ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def slug(text: Column) -> Column:
    """Lower case, each run of anything but a-z and 0-9 a hyphen, none at the ends; `unnamed` when nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("unnamed"))


def strip_noise(text: Column) -> Column:
    return F.regexp_replace(text, NOISE, "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def clean_text(text: Column) -> Column:
    """Unescape, NFC, strip noise (joiners stay), collapse white space, trim. Cleaning twice changes nothing."""
    return collapse_space(strip_noise(unescape_nfc(text)))


def noise_count(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(NOISE_CLASSES[kind])).cast("long")


def literal_count(text: Column, literal: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def lower_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits, marks and underscores, of the text in NFC."""
    return F.regexp_extract_all(F.lower(nfc(text)), F.lit(WORD_RUN), 0)


def sentences(text: Column) -> Column:
    """Units that end after . ! ? or a danda before white space; blank ones dropped."""
    return collapsed_sentences(collapse_space(text))


def collapsed_sentences(text: Column) -> Column:
    """sentences() of a text whose white space is collapsed already."""
    return F.array_remove(F.split(F.regexp_replace(text, "([.!?।॥]) ", "$1\x01"), " *\x01 *"), "")


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]", "")).cast("long")


def script_count(text: Column, script: str) -> Column:
    low, high = SCRIPTS[script]
    plain = F.regexp_replace(text, r"[^\p{L}]", "")
    return F.length(F.regexp_replace(plain, rf"[^\x{{{low:X}}}-\x{{{high:X}}}]", "")).cast("long")


def dominant_script(text: Column) -> Column:
    """The block that holds most letters, of equal ones the first listed; Unknown when none has any."""
    plain = F.regexp_replace(text, r"[^\p{L}]", "")
    count = lambda t, low, high: F.length(F.regexp_replace(t, rf"[^\x{{{low:X}}}-\x{{{high:X}}}]", ""))
    low, high = SCRIPTS["Latin"]

    def most(t: Column) -> Column:
        each = F.array(*[F.struct(count(t, a, b).alias("n"), F.lit(-i).alias("at"), F.lit(k).alias("name")) for i, (k, (a, b)) in enumerate(SCRIPTS.items())])
        return let(F.array_max(each), lambda m: F.when(m["n"] > 0, m["name"]).otherwise("Unknown"))

    return let(plain, lambda t: F.when(t == "", "Unknown").when(~t.rlike(rf"[^\x{{{low:X}}}-\x{{{high:X}}}]"), "Latin").otherwise(most(t)))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row: lambdas would evaluate an expression again for every element."""
    return F.transform(F.array(value), body)[0]


def trigrams(text: Column) -> Column:
    """Runs of three characters of the text with its white space collapsed and a space at both ends; of a shorter one,
    what there is. Characters are split once: substr() would count them from the start for every run."""
    padded = F.concat(F.lit(" "), collapse_space(text), F.lit(" "))
    runs = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 2, F.lit(1))), lambda i: F.array_join(F.slice(c, i, 3), ""))
    return let(F.split(padded, ""), runs)


def grams(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens, joined by spaces; none for shorter arrays."""
    none = F.array().cast("array<string>")
    runs = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " ")))
    return let(tokens, lambda t: F.when(F.size(t) >= n, runs(t)).otherwise(none))
