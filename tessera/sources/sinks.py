"""Sinks: bundles with a size limit, contamination indexes, token ids by content, merges, result dumps."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what a page's bundle may weigh.
BUNDLE_BYTES = 100_000


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file on any file system of the session."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_bundle(tables: dict[str, DataFrame], path: str, limit: int = BUNDLE_BYTES) -> int:
    """One JSON object with an array of rows for each table, and its size. Tables are reports of a few rows: their total
    size is taken by Spark first, and a bundle beyond the limit raises before any row reaches the driver."""
    size = sum((t.select(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()[0] for t in tables.values()), 0)
    if size > limit:
        raise ValueError(f"the bundle has {size} characters, more than {limit}")
    spark = next(iter(tables.values())).sparkSession
    text = json.dumps({k: [json.loads(r) for r in t.select(F.to_json(F.struct("*")).alias("j")).toPandas()["j"]] for k, t in tables.items()}, ensure_ascii=False)
    write_text(spark, path, text)
    return len(text.encode())


def write_index(index: DataFrame, items: DataFrame, private: str, public: str) -> dict:
    """index(width, digest, benchmark) goes to a private Parquet folder by width; its counts, which reveal no item, to a public
    JSON file. items: one row (full, narrow, refused)."""
    index.write.mode("overwrite").partitionBy("width").parquet(private)
    n = index.groupBy("benchmark").agg(F.count("*").alias("n")).orderBy("benchmark")
    payload = {"shingles": index.count(), "widths": sorted(r[0] for r in index.select("width").distinct().collect()), "benchmarks": {r["benchmark"]: r["n"] for r in n.collect()}} | items.first().asDict()
    write_text(index.sparkSession, public, json.dumps(payload, indent=2))
    return payload


def cached_ids(docs: DataFrame, path: str, folder: str, text_col: str = "text") -> DataFrame:
    """(hash, ids): token ids by content hash, kept in a folder for each vocabulary file. Only texts that the folder doesn't
    hold yet are encoded and appended; a changed text has another hash. Null counts as empty."""
    from tokenizers import Tokenizer

    spark, made = docs.sparkSession, {}

    def encode(texts):
        import pandas as pd

        if path not in made:
            made[path] = Tokenizer.from_file(path)
            made[path].no_truncation()
            made[path].no_padding()
        return pd.Series([c.ids for c in made[path].encode_batch(texts.tolist(), add_special_tokens=False)])

    cache = f"{folder.rstrip('/')}/{path.rsplit('/', 1)[-1]}"
    wanted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(F.sha2("text", 256).alias("hash"), "text").dropDuplicates(["hash"])
    schema = "hash string, ids array<int>"
    if exists(spark, cache):
        wanted = wanted.join(spark.read.schema(schema).parquet(cache), "hash", "left_anti")
    wanted.select("hash", F.pandas_udf(encode, T.ArrayType(T.IntegerType()))("text").alias("ids")).write.mode("append").parquet(cache)
    return spark.read.schema(schema).parquet(cache)


def save_merges(spark: SparkSession, path: str, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
    write_text(spark, path, json.dumps({"vocab": vocabulary, "merges": [list(m) for m in merges]}, ensure_ascii=False))


def load_merges(spark: SparkSession, path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return found["vocab"], [tuple(m) for m in found["merges"]]


def write_results(results: DataFrame, path: str) -> None:
    """JSON lines of a result table, nulls kept."""
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
