"""Masking of personal data by spans: patterns and a name list propose spans, overlaps are settled, spans become typed
placeholders. Offsets need the text itself, so one Arrow batch function does all of it; matched text is never returned."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.corpus import PII_PATTERNS

# The given names of the name list, compared in lower case.
GIVEN_NAMES = (
    "ananya", "rahul", "priya", "arjun", "meera", "vikram", "aditya", "kavya", "rohit", "sneha", "karthik", "divya", "sanjay", "pooja", "amit", "neha", "james", "sarah",
    "michael", "emma", "david", "laura", "robert", "anna",
)
# The placeholder of each kind.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "ipv4": "[IP]", "mac": "[MAC]", "aadhaar": "[AADHAAR]", "pan": "[PAN]", "name": "[NAME]"}
# Fixed value: a capitalised word.
CAPITALISED = r"(?<![\p{L}\p{N}_.])[A-Z][a-z]{2,}(?![\p{L}\p{N}_])"
SCHEMA = "doc_id long, masked string, spans array<struct<kind:string,start:int,end:int,layer:string>>"


def settled(spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Of spans by start, longest first at a start, those that don't overlap one already taken."""
    out, end = [], 0
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if s[0] >= end:
            out.append(s)
            end = s[1]
    return out


def _named(capitalised: Iterator[regex.Match], dial: float) -> list[tuple[int, int, str, str]]:
    masks = lambda m: m[0].lower() in GIVEN_NAMES or (dial > 0.5 and m.start() > 0)
    return [(*m.span(), "name", "gazetteer") for m in capitalised if masks(m)]


def mask(docs: DataFrame, dial: float = 0.0, text_col: str = "text") -> DataFrame:
    """(doc_id, masked text, spans in code points). dial: 0 leaves names alone, up to 0.5 masks known given names, above
    it any capitalised word too, but for an unknown one that opens the text. Where they overlap, patterns' spans come first
    among themselves, then the earlier start. Null counts as empty; no document is dropped."""
    patterns = dict(PII_PATTERNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled, word = {k: regex.compile(p) for k, p in patterns.items()}, regex.compile(CAPITALISED)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                taken = settled([(*m.span(), k, "regex") for k, p in compiled.items() for m in p.finditer(text)])
                if dial > 0:
                    taken = settled(taken + _named(word.finditer(text), dial))
                parts, at = [], 0
                for start, end, kind, _ in taken:
                    parts += [text[at:start], PLACEHOLDERS.get(kind, "[REDACTED]")]
                    at = end
                spans = [{"kind": k, "start": s, "end": e, "layer": layer} for s, e, k, layer in taken]
                rows.append((doc_id, "".join(parts) + text[at:], spans))
            yield pd.DataFrame(rows, columns=["doc_id", "masked", "spans"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInPandas(run, SCHEMA)


def masked_by_kind(masked: DataFrame) -> DataFrame:
    """(kind, n spans, n documents) over all masked documents; partial counts before the shuffle."""
    each = masked.select("doc_id", F.explode("spans.kind").alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("k"))
    return each.groupBy("kind").agg(F.sum("k").alias("n_spans"), F.count("*").alias("n_docs"))
