"""Shared tables, Arrow helpers and session settings of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as the operators' contracts state it.
SPACE = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: spark.checkpoint.dir. Where it is unset, a session on one machine gets a
    folder of its own (tests); a cluster's session raises, as its executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _own_dirs:
            own = tempfile.TemporaryDirectory(prefix="tessera-")
            atexit.register(own.cleanup)
            _own_dirs[app] = own.name
        base = _own_dirs[app]
    return f"{base.rstrip('/')}/tessera-{app}"


#: Rows of an Arrow batch that a Python worker holds: texts may be very long, and Spark's default is 10,000.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to BATCH_ROWS, unless it has a smaller bound."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, a lost executor costs no recomputation,
    and the planner knows the table's size, so that it broadcasts it only below its own threshold."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a table written by materialize() that no later plan reads."""
    if path := getattr(df, "_tessera_path", None):
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two(n: float, least: int = 1) -> int:
    """The smallest power of two that is at least n and at least `least`."""
    p = least
    while p < n:
        p *= 2
    return p


#: No key with more than this share of all rows stays whole in split_join(), so at most 10,000 keys are split.
SPLIT_SHARE, LEAST_SPLIT = 10_000, 1000


#: Rows of a few numbers that any task can hold, whatever their keys: 50 MB.
SMALL_ROWS = 1_000_000


def split_join(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int, spread: Column, small: int = 0) -> DataFrame:
    """Inner join where a key of left may hold any share of its `total` rows. right has one row per key and, in column n,
    the number of left's rows with it. Keys above a ten-thousandth of all rows are dealt to parts by the hash of
    `spread`, right's row being repeated for each; the table of those keys, which is broadcast, has at most 10,000 rows.
    Where all rows are at most `small`, which one task could hold, it is a plain join."""
    if total <= small:
        return left.join(right, on)
    part = max(LEAST_SPLIT, total // SPLIT_SHARE)
    parts = F.ceil(F.col(n) / part)
    hot = right.where(F.col(n) > part).select(*[F.col(k).alias(f"__{k}") for k in on], parts.alias("__parts"))
    same = [F.col(k) == F.col(f"__{k}") for k in on]
    dealt = left.join(F.broadcast(hot), same, "left").withColumn("__part", F.pmod(F.xxhash64(spread), F.coalesce("__parts", F.lit(1))))
    dealt = dealt.drop("__parts", *[f"__{k}" for k in on])
    copies = F.when(F.col(n) > part, parts - 1).otherwise(F.lit(0))
    return dealt.join(right.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long")))), [*on, "__part"]).drop("__part")


#: Most bits of a key filter, and those of the bitmaps that it is built of. What it lets through beyond them costs a shuffle
#: of rows that the exact join then drops, never a wrong result.
FILTER_BITS, BITMAP_BITS = 1 << 29, 1 << 15


class KeyFilter:
    """A bit for each of `n` 64-bit keys(h), 16 bits a key and at most FILTER_BITS: bitmaps, partially aggregated, that are put
    together on the driver and sent to all tasks. A row whose bit is off has none of the keys."""

    def __init__(self, keys: DataFrame, n: int):
        bits = min(power_of_two(16 * n, BITMAP_BITS), FILTER_BITS)
        slots = keys.select(F.pmod("h", F.lit(bits)).alias("slot"))
        bitmaps = slots.groupBy(F.expr(f"slot div {BITMAP_BITS}").alias("b")).agg(F.bitmap_construct_agg(F.expr(f"slot % {BITMAP_BITS}")).alias("m")).toArrow()
        out = np.zeros(bits // 8, np.uint8)
        for b, m in zip(bitmaps.column("b").to_pylist(), bitmaps.column("m")):
            out[b * BITMAP_BITS // 8 : (b + 1) * BITMAP_BITS // 8] = np.frombuffer(m.as_py(), np.uint8)
        self.sent = keys.sparkSession.sparkContext.broadcast(out)

    @staticmethod
    def on(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Which of the hashes (signed or not) have their bit on."""
        slot = (h.view(np.uint64) & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
        return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1

    def may_hold(self, h: Column) -> Column:
        sent = self.sent
        return F.pandas_udf(lambda s: pd.Series(KeyFilter.on(sent.value, s.to_numpy(np.int64))), T.BooleanType())(h)


def keep_once(docs: DataFrame, key: Column, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs without the rows that dropped(doc_id, key) names, and with one of those that repeated(doc_id, key) names;
    both are written tables. Ids are compared null-safe, and a key tells texts of one id apart. Only rows whose id may be
    named, by a key filter, are shuffled."""
    named = dropped.unionByName(repeated).select(F.xxhash64("doc_id").alias("h"))
    may = KeyFilter(named, named.count()).may_hold(F.xxhash64("doc_id"))
    tagged = docs.withColumn("__may", may)
    clear, rest = tagged.where("not __may"), tagged.where("__may").withColumn("__key", key)

    def names(rows: DataFrame) -> tuple[DataFrame, Column]:
        some = rows.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k")).distinct().hint("merge")
        return some, rest["doc_id"].eqNullSafe(some["__d"]) & (rest["__key"] == some["__k"])

    kept = rest.join(*names(dropped), "left_anti")
    if not repeated.isEmpty():
        once = kept.join(*names(repeated), "left_semi").dropDuplicates(["doc_id", "__key"])
        kept = kept.join(*names(repeated), "left_anti").unionByName(once)
    return clear.select(*docs.columns).unionByName(kept.select(*docs.columns))
