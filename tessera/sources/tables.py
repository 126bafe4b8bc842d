"""Reading and writing document tables, and cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: What a document needs; other fields of a file are read only when the caller's schema names them.
DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def read_documents(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT) -> DataFrame:
    """Documents from Parquet, or from JSON lines (also gzip) when the path says so. JSON is read with a given schema, so
    that no pass over the data infers it; a malformed line fails the read."""
    if ".json" in path.rsplit("/", 1)[-1]:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.parquet(path)


def write_jsonl(docs: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """gzipped JSON lines, one file a task, split at rows_per_file rows; null fields are kept."""
    docs.write.option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).option("ignoreNullFields", "false").json(path)


def write_parquet(docs: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, in folders by a column where one is named."""
    (docs.write.partitionBy(by) if by else docs.write).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df, read back from a reliable checkpoint in the folder of spark.checkpoint.dir. Where it is unset, a session on one
    machine gets a folder of its own (tests); a cluster's session raises, as its executors share no local folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-cut-"))
    return df.checkpoint()
