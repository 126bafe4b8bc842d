"""Exact dedup with counting quotient filters.

Every partition builds counting quotient filters of its texts' 64-bit fingerprints, one per fingerprint prefix (shard).
A shard's filters merge losslessly by their sorted remainders. Fingerprints with a count above one route their texts to
byte verification: texts are grouped by all their bytes, with partial aggregation before the shuffle, so that a group
holding a third of all rows is one row per task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, keep_once, materialize, power_of_two, release, text_or_empty

#: Fingerprints that a shard is planned to hold, and that a task gathers before it emits a set of filters.
SHARD_ROWS = 1 << 18
FLUSH_ROWS = 1 << 22


class CountingQuotientFilter:
    """Lossless multiset of `bits`-bit fingerprints. The high bits (quotient) are kept as a bit vector of occupied
    quotients and a bit vector of run ends, the low bits (remainder) in sorted slots; counts above one are kept apart
    as (slot, count)."""

    def __init__(self, bits: int, qbits: int, occupied: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray, extra: tuple[np.ndarray, np.ndarray]):
        self.bits, self.qbits, self.occupied, self.run_ends, self.remainders, self.extra = bits, qbits, occupied, run_ends, remainders, extra

    @classmethod
    def of(cls, fps: np.ndarray, bits: int = 64, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        fps = np.asarray(fps, np.uint64)
        counts = np.ones(len(fps), np.int64) if counts is None else counts
        order = np.argsort(fps, kind="stable")  # runs that are sorted already merge in linear time
        fps, counts = fps[order], counts[order]
        first = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]]) if len(fps) else np.zeros(0, np.int64)
        counts = np.add.reduceat(counts, first) if len(fps) else counts
        fps = fps[first]
        qbits = min(bits, max(3, int(len(fps)).bit_length()))
        quotient = fps >> np.uint64(bits - qbits)
        occupied = np.zeros(1 << qbits, bool)
        occupied[quotient.astype(np.int64)] = True
        ends = np.r_[quotient[1:] != quotient[:-1], True] if len(fps) else np.zeros(0, bool)
        more = np.flatnonzero(counts > 1)
        return cls(bits, qbits, np.packbits(occupied), np.packbits(ends), fps & np.uint64((1 << (bits - qbits)) - 1), (more, counts[more]))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        n = len(self.remainders)
        quotients = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.qbits)).astype(np.uint64)
        run = np.cumsum(np.r_[0, np.unpackbits(self.run_ends, count=n)[:-1]]) if n else np.zeros(0, np.int64)
        counts = np.ones(n, np.int64)
        counts[self.extra[0]] = self.extra[1]
        return (quotients[run] << np.uint64(self.bits - self.qbits)) | self.remainders, counts

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        parts = [f.items() for f in filters]
        return cls.of(np.concatenate([p[0] for p in parts]), filters[0].bits, np.concatenate([p[1] for p in parts]))

    def to_bytes(self) -> bytes:
        width = (self.bits - self.qbits + 7) // 8
        slots = np.ascontiguousarray(self.remainders.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
        return struct.pack("<BBII", self.bits, self.qbits, len(self.remainders), len(self.extra[0])) + self.occupied.tobytes() + self.run_ends.tobytes() + slots.tobytes() + self.extra[0].astype("<u4").tobytes() + self.extra[1].astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, qbits, n, more = struct.unpack_from("<BBII", data)
        at = struct.calcsize("<BBII")

        def take(count: int, dtype: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        occupied, ends = take(((1 << qbits) + 7) // 8, "u1"), take((n + 7) // 8, "u1")
        width = (bits - qbits + 7) // 8
        slots = np.zeros((n, 8), np.uint8)
        slots[:, :width] = take(n * width, "u1").reshape(n, width)
        return cls(bits, qbits, occupied, ends, slots.view("<u8").ravel().astype(np.uint64), (take(more, "<u4").astype(np.int64), take(more, "<i8")))


def repeated_fingerprints(rows: DataFrame, column: str = "fp", n_rows: int | None = None) -> DataFrame:
    """rows with a 64-bit integer column -> (fp, n) of the values that occur more than once, by merged filters. The
    number of shards follows the number of rows, so that a merging task's filters hold about SHARD_ROWS entries."""
    n_rows = rows.count() if n_rows is None else n_rows
    shards = power_of_two(n_rows / SHARD_ROWS, 16)
    shift, low = 64 - (shards.bit_length() - 1), 64 - (shards.bit_length() - 1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
            fps = np.sort(np.concatenate(parts))
            shard = (fps >> np.uint64(shift)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            made = [CountingQuotientFilter.of(x & np.uint64((1 << low) - 1), low).to_bytes() for x in np.split(fps, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(shard[cuts]), pa.array(made, pa.binary())], ["shard", "filter"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += batch.num_rows
            if n >= FLUSH_ROWS:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fps, counts = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in pdf["filter"]]).items()
        keep = counts > 1
        return pd.DataFrame({"fp": (fps[keep] | (np.uint64(key[0]) << np.uint64(shift))).view(np.int64), "n": counts[keep]})

    filters = rows.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(build, "shard long, filter binary")
    return filters.groupBy("shard").applyInPandas(merge, "fp long, n long")


def normalized(text_col: str = "text"):
    return F.regexp_replace(text_or_empty(text_col), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (other columns are not read).

    Texts are equal when identical after each run of ASCII white space became one space; null counts as empty. Of equal
    texts the row with the smallest doc_id stays. Rows that repeat a doc_id count in group_size and share its decision.
    A null doc_id never is a keep_id unless the whole group has none; its kept is null then (no id to keep by). An empty
    table gives an empty table."""
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalized(text_col).alias("norm"))
    keyed = norm.select("doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256"))
    digests = materialize(keyed, "digests")
    repeated = materialize(repeated_fingerprints(digests).select("fp"), "repeated")
    # Byte verification of the routed texts: the text itself is the grouping key.
    routed = norm.withColumn("fp", F.xxhash64("norm")).join(repeated, "fp", "left_semi")
    verified = routed.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = (
        verified.select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
        .groupBy("fp", "text_sha256")
        .agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts have one SHA-256 digest"))))
        .drop("texts")
    )
    joined = digests.join(groups, ["fp", "text_sha256"], "left")
    keep_id = F.coalesce("keep_id", "doc_id")
    return joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id") == keep_id).alias("kept"), "text_sha256")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of equal texts: one with the smallest doc_id, null only if the group has no other.
    Rows are dropped by id and text, so a doc_id that repeats over different texts loses none of them; of rows that
    repeat an id and a text (but for white space) any one stays."""
    found = materialize(exact_dedup(docs).where("group_size > 1").select("doc_id", "keep_id", F.col("text_sha256").alias("key")), "exact")
    dropped = materialize(found.where("not (doc_id <=> keep_id)").select("doc_id", "key"), "dropped")
    repeated = materialize(found.where("doc_id <=> keep_id").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "repeats")
    release(found)
    return keep_once(docs, F.sha2(normalized(), 256), dropped, repeated)
