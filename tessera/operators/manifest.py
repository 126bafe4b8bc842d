"""Run manifests: fingerprints of configuration and code, run ids, the yield of stages, and their fold."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import words

Stage = tuple[str, Callable[[DataFrame], DataFrame] | None]


def config_fingerprint(config: dict) -> str:
    """sha256 of the configuration as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def code_fingerprint(folder: str) -> str:
    """sha256 over the names and bytes of a folder's Python files, in order of their paths."""
    h = hashlib.sha256()
    for p in sorted(Path(folder).rglob("*.py")):
        h.update(str(p.relative_to(folder)).encode() + b"\0" + p.read_bytes() + b"\0")
    return h.hexdigest()


def run_id(profile: str, config: str, code: str, content: str) -> str:
    return f"run-{profile}-{hashlib.sha256('|'.join((config, code, content)).encode()).hexdigest()[:12]}"


def folded(docs: DataFrame, stages: Sequence[Stage], write: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Applies the stages in order, each written and reread by `write`; a stage without a function passes its input on.
    Returns the last one's rows and (ord, stage, documents, units), units being white-space separated words."""
    counts = None
    for i, (name, stage) in enumerate((("read", None), *stages)):
        if stage or i == 0:
            docs = write(stage(docs) if stage else docs, name)
        units = F.sum(F.size(words(F.coalesce("text", F.lit("")))).cast("long"))
        one = docs.agg(F.count("*").alias("documents"), F.coalesce(units, F.lit(0)).alias("units")).select(F.lit(i).alias("ord"), F.lit(name).alias("stage"), "documents", "units")
        counts = one if counts is None else counts.unionAll(one)
    return docs, counts


def yield_descent(counts: DataFrame) -> DataFrame:
    """Each stage's units as a share of the first stage's that has any figure, to 4 places; unknown stays unknown.
    One row a stage."""
    first = F.first("units", ignorenulls=True).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.select("ord", "stage", "documents", "units", F.round(F.col("units") / F.nullif(first, F.lit(0)), 4).alias("share"))
