"""The corpus pipeline: STAGES applied in order to documents, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import materialize, table
from tessera.llm.exact_dedup import exact_dedup_stage
from tessera.llm.minhash import near_dedup_stage
from tessera.llm.packing import best_fit_packing
from tessera.llm.quality import quality_stage
from tessera.llm.secrets import secret_stage


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: Model fitting, near-dedup and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
