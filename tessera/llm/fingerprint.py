"""Document fingerprints: improbable-feature similarity digests.

Every 16-byte window of a text has an entropy. Entropies are ranked by how rare they are among the windows of all
documents (a grouped histogram). Of each 16 neighbouring windows the rarest is elected; windows elected 4 times or more
are features. Features go into a chain of 2048-bit Bloom filters of 160 features each, and two digests are compared by
the overlap of their bits, normalised between chance and the most that is possible.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import text_or_empty
from tessera.llm.minhash import mix

WINDOW, NEIGHBOURS, ELECTED = 16, 16, 4
MOST_ENTROPY = 4  # bits, log2(WINDOW)
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
LEVELS = 1024
#: Windows of less entropy (bits) are never improbable features: runs of one or two characters.
LEAST_ENTROPY = 1.0
#: Bytes of text that a worker handles at once, and documents that a bucket of neighbours is planned to hold: few, so that
#: buckets dealt by hash fill tasks evenly. Buckets grow only where MOST_BUCKETS don't suffice; they are read as streams.
CHUNK_BYTES, BUCKET_ROWS, MOST_BUCKETS = 1 << 20, 512, 50_000

_c = np.arange(WINDOW + 2, dtype=np.float64)
_SUM = np.zeros(WINDOW + 2)
_SUM[1:] = _c[1:] * np.log2(_c[1:])
_STEP = np.zeros(WINDOW + 2, np.int64)
_STEP[1:] = np.diff(np.round(_SUM * (1 << 20)).astype(np.int64))
_PLACE = np.random.default_rng(11).integers(1, 1 << 63, WINDOW // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def entropy_levels(b: np.ndarray) -> np.ndarray:
    """Level (0 to LEVELS - 1) of the entropy of the window that starts at each byte, for all but the last 15. Counting
    equal bytes at each distance gives, for every byte, how often its value occurs in the 16 bytes that end or start
    there; sliding the window by one changes the sum of c log c by one step down and one up."""
    n = len(b)
    back, ahead = np.ones(n, np.uint8), np.ones(n, np.uint8)
    same = np.empty(n, bool)
    for k in range(1, min(WINDOW, n)):
        eq = same[: n - k]
        np.equal(b[k:], b[:-k], out=eq)
        np.add(back[k:], eq.view(np.uint8), out=back[k:])
        np.add(ahead[:-k], eq.view(np.uint8), out=ahead[:-k])
    gained, lost = np.cumsum(_STEP[back]), np.cumsum(_STEP[ahead])
    s = gained[WINDOW - 1 :].copy()
    s[1:] -= lost[: n - WINDOW]
    most = WINDOW * MOST_ENTROPY << 20
    return ((most - s) * (LEVELS - 1) // most).clip(0, LEVELS - 1)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts behind a pad in one buffer, and the start and end of each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes) + WINDOW
    return np.frombuffer(b"\0" * WINDOW + b"".join(texts) + b"\0" * WINDOW, np.uint8), ends - sizes, ends


def _valid(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks the starts of windows that lie within one text."""
    edge = np.zeros(n + 1, np.int32)
    long = ends - starts >= WINDOW
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - WINDOW + 1, -1)
    return np.cumsum(edge[:n]) > 0


def level_histogram(texts: list[bytes]) -> np.ndarray:
    buffer, starts, ends = _joined(texts)
    levels = entropy_levels(buffer)
    return np.bincount(levels[_valid(len(levels), starts, ends)], minlength=LEVELS)


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, the rarest first; levels under LEAST_ENTROPY come last, the lowest at the very end."""
    level = np.arange(LEVELS)
    order = np.lexsort((level, np.where(level * MOST_ENTROPY < LEAST_ENTROPY * (LEVELS - 1), LEVELS - level, 0), counts))
    dull = level[order] * MOST_ENTROPY < LEAST_ENTROPY * (LEVELS - 1)
    ranks = np.empty(LEVELS, np.int64)
    ranks[np.concatenate([order[~dull], order[dull]])] = level
    return ranks


def digests(texts: list[bytes], ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text (features in each filter, filters as rows of 32 64-bit words)."""
    buffer, starts, ends = _joined(texts)
    levels = entropy_levels(buffer)
    valid = _valid(len(levels), starts, ends)
    at = np.arange(len(levels), dtype=np.int64)
    none = np.int64(1 << 62)
    key = np.where(valid, ranks[levels] << 32 | at, none)
    # Texts lie 15 windows apart, so no neighbourhood holds windows of two.
    least, step = key, 1
    while step < NEIGHBOURS:
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        step *= 2
    votes = np.bincount((least[least < none] & np.int64(0xFFFFFFFF)), minlength=len(levels))
    chosen = np.flatnonzero(votes >= ELECTED)
    found = np.lib.stride_tricks.sliding_window_view(buffer, WINDOW)[chosen]
    hashes = mix((np.ascontiguousarray(found).view("<u8") * _PLACE).sum(axis=1, dtype=np.uint64)) if len(chosen) else np.zeros(0, np.uint64)
    owner = np.searchsorted(ends, chosen, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    # A text without an elected window has one feature, the whole of it.
    alone = np.flatnonzero((counts == 0) & (ends > starts))
    if len(alone):
        hashes = np.concatenate([hashes, np.array([xxhash.xxh3_64_intdigest(texts[i]) for i in alone], np.uint64)])
        owner = np.concatenate([owner, alone])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
        counts = np.bincount(owner, minlength=len(texts))
    filters = -(-counts // FILTER_FEATURES)
    first = np.cumsum(filters) - filters
    number = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
    slot = first[owner] + number // FILTER_FEATURES
    bits = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    for h in range(HASHES):
        bits[slot, (hashes >> np.uint64(11 * h)).astype(np.int64) & (FILTER_BITS - 1)] = True
    packed = np.packbits(bits, axis=1).view(np.uint64) if len(bits) else np.zeros((0, FILTER_BITS // 64), np.uint64)
    held = np.bincount(slot, minlength=len(bits))
    return [(held[f : f + k], packed[f : f + k]) for f, k in zip(first.tolist(), filters.tolist())]


def to_string(digest: tuple[np.ndarray, np.ndarray]) -> str:
    """`features:base64` of each filter, comma-joined; empty for an empty text."""
    return ",".join(f"{n}:{base64.b64encode(f.tobytes()).decode()}" for n, f in zip(digest[0].tolist(), digest[1]))


def from_string(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [x.split(":") for x in fingerprint.split(",")] if fingerprint else []
    filters = np.frombuffer(b"".join(base64.b64decode(f) for _, f in parts), np.uint64).reshape(-1, FILTER_BITS // 64)
    return np.array([int(n) for n, _ in parts], np.int64), filters


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: each filter of the shorter chain against its best match, weighted by its features. Two empty digests are
    alike, an empty and another are not."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if (len(a[0]), int(a[0].sum())) > (len(b[0]), int(b[0].sum())):
        a, b = b, a
    total = 0.0
    nb = np.bitwise_count(b[1]).sum(axis=1, dtype=np.int64)
    for features, f in zip(a[0].tolist(), a[1]):
        na = int(np.bitwise_count(f).sum())
        shared = np.bitwise_count(f & b[1]).sum(axis=1, dtype=np.int64)
        chance, most = na * nb / FILTER_BITS, np.minimum(na, nb)
        total += features * float(np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / int(a[0].sum())


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Rarity ranks of the entropy levels over all windows of docs(text); 1024 counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(LEVELS, np.int64), [], 0
        for batch in batches:
            for t in batch.column(0):
                held.append(t.as_py().encode())
                size += len(held[-1])
                if size >= CHUNK_BYTES // 4:
                    counts += level_histogram(held)
                    held, size = [], 0
        if held:
            counts += level_histogram(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(counts)], ["level", "n"])

    rows = docs.select("text").mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)
    for r in rows:
        counts[r["level"]] = r["n"]
    return rarity_ranks(counts)


def with_neighbour(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (bucket, look, doc_id, text), dealt by bucket and sorted so that every row's next document
    (descending doc_id, ties by a hash of the text; after the last the first) follows it in its bucket. Buckets are ranges of
    doc_id; an id with more than a ten-thousandth of all rows, as null may be, is cut further by the hash. The first
    document of the next bucket is repeated at the end of each, with look = 1."""
    n = docs.count()
    parts = int(min(MOST_BUCKETS, max(1, -(-n // BUCKET_ROWS))))
    least = -(1 << 63)
    cuts = docs.agg(F.percentile_approx("doc_id", [(i + 1) / parts for i in range(parts - 1)], max(10_000, 10 * parts))).first()[0] if parts > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))
    keyed = docs.withColumn("__order", F.coalesce("doc_id", F.lit(least))).withColumn("__hash", F.xxhash64("text"))
    # At most 10,000 rows.
    frequent = keyed.groupBy("__order").agg(F.count("*").alias("k")).where(F.col("k") > max(2 * BUCKET_ROWS, n // 10_000)).orderBy("__order").collect()
    hot = np.array([r[0] for r in frequent], np.int64)
    pieces = np.array([min(-(-r[1] // BUCKET_ROWS), MOST_BUCKETS * r[1] // n + 1) for r in frequent], np.uint64)
    before = np.concatenate([[0], np.cumsum(pieces)]).astype(np.int64)

    def numbers(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(hot, ids)
        out = np.searchsorted(bounds, ids, side="right") + before[at]
        some = np.flatnonzero(at < len(hot))
        some = some[hot[at[some]] == ids[some]]
        high = (hashes[some].view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        out[some] += ((high * pieces[at[some]]) >> np.uint64(32)).astype(np.int64)
        return out

    bucket = F.pandas_udf(lambda ids, hashes: pd.Series(numbers(ids.to_numpy(np.int64), hashes.to_numpy(np.int64))), T.LongType())
    # At most two rows for each of MOST_BUCKETS.
    firsts = keyed.select(bucket("__order", "__hash").alias("b"), F.struct("__order", "__hash").alias("s")).groupBy("b").agg(F.max("s").alias("s")).collect()
    heads = {r["b"]: (r["s"][0], r["s"][1]) for r in firsts}
    used = sorted(heads, reverse=True)
    previous = {b: used[i - 1] for i, b in enumerate(used)}  # the bucket whose rows come before; of the first, the last

    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        own = numbers(ids.to_numpy(np.int64), hashes.to_numpy(np.int64)).tolist()
        return pd.Series([[2 * b, 2 * previous[b] + 1] if heads[b] == key else [2 * b] for b, key in zip(own, zip(ids.tolist(), hashes.tolist()))])

    dealt = keyed.withColumn("place", F.explode(F.pandas_udf(places, T.ArrayType(T.LongType()))("__order", "__hash")))
    dealt = dealt.select(F.expr("place div 2").alias("bucket"), F.expr("place % 2").cast("int").alias("look"), "doc_id", "__order", "__hash", "text")
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["bucket", "look", F.col("__order").desc(), F.col("__hash").desc(), "text"]
    return dealt.repartition(width, "bucket").sortWithinPartitions(*order).select("bucket", "look", "doc_id", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty (empty fingerprint). The next document follows in descending doc_id (ties by a hash of the
    text, null ids last), the first one after the last; a lone document follows itself. Other columns are not read; an empty table
    gives an empty table."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ranks = corpus_ranks(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def chunk(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
        """Of all rows but the last, which is only a neighbour."""
        edited = []
        for (_, text), (_, after) in zip(rows, rows[1:]):
            m = len(text) // 3
            edited.append((text[: len(text) - m] + after[:m]).encode())
        own = digests([t.encode() for _, t in rows], ranks)
        new = digests(edited, ranks)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _ in rows[:-1]], pa.int64()),
                pa.array([len(t) for _, t in rows[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
                pa.array([to_string(d) for d in own[:-1]]),
                pa.array([to_string(d) for d in new]),
                pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, now, done = 0, None, False
        for batch in batches:
            for b, look, d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if b != now:
                    held, size, now, done = [], 0, b, False
                if done:
                    continue  # a further row with the neighbour's doc_id
                text = t.as_py()
                held.append((d, text))
                size += len(text)
                done = bool(look)
                if done or size >= CHUNK_BYTES // 2:
                    if len(held) > 1:
                        yield chunk(held)
                    held, size = held[-1:], len(text)

    return with_neighbour(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
