"""Exact greedy survivors by prefix filtering: sets are read once, and only what another set may share is kept of them.

Rows that could match share one of the rarest values of both (prefix filter), so nothing is missed. Values are counted from
packed blocks, a block for a range of values and some rows; those of one row alone never come back from there."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import cut

#: Values and rows after which a task packs what it has read; a row's place in a block has two bytes.
PACKED_VALUES, PACKED_ROWS = 500_000, 1 << 16
#: Rows of an Arrow batch that a Python worker holds, at most.
BATCH_ROWS = 1000
#: Ranges of values that are counted apart, at least; a power of two.
RANGES = 256
#: Rows of the first batch in order of ord, and how many times all rows before it a later one ends at.
FIRST, GROWTH = 4096, 8
#: Pairs that the driver settles in one pass; more go through rounds.
LOCAL = 200_000

_BLOCK = "range long, block long, kind int, at binary, a binary, b binary, c binary"
_ROW = "ord long, head long, n int, first int, prefix array<long>, shared array<long>"


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, those of low order first, without the bytes that are 0 in all: shuffles compress them."""
    raw = np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(-1, 8)
    k = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return bytes([k]) + raw[:, :k].T.tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    raw = np.zeros((n, 8), np.uint8)
    raw[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], n).T
    return raw.reshape(-1).view(np.uint64)


def _sorted_planes(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + x[:1].tobytes() + _planes(x[1:] - x[:-1])


def _sorted_numbers(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.cumsum(np.concatenate([np.frombuffer(data[8:16], np.uint64), _numbers(data[16:], n - 1)]), dtype=np.uint64)


def _packed(ords: np.ndarray, sets: list[np.ndarray], ranges: int) -> list[tuple]:
    """Of kind 0: values and the rows' places, by range of values. Else rows, by range of the digests of their sets; kind is the
    number of all rows of the block."""
    block = int.from_bytes(hashlib.blake2b(ords.tobytes(), digest_size=8).digest(), "little", signed=True)
    sizes = np.array([len(s) for s in sets], np.int64)
    digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.uint64).reshape(-1, 2)
    values, at = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint64), sizes)
    by = np.argsort(values, kind="stable")
    values, at, shift = values[by], at[by], np.uint64(65 - ranges.bit_length())
    ends = np.searchsorted(values >> shift, np.arange(ranges + 1, dtype=np.uint64))
    out = [(r, block, 0, _planes(at[a:b]), _sorted_planes(values[a:b]), b"", b"") for r, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if a < b]
    part = (digests[:, 0] >> shift).astype(np.int64)
    for r in np.unique(part).tolist():
        k = np.flatnonzero(part == r)
        out.append((r, block, len(sets), k.tobytes(), ords[k].tobytes(), sizes[k].tobytes(), digests[k].tobytes()))
    return out


def _blocks(ranges: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        ords, sets, held = [], [], 0

        def table() -> pa.RecordBatch:
            columns = zip(*_packed(np.array(ords, np.int64), sets, ranges))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            listed = batch.column(1)
            flat, ends = listed.values.to_numpy(zero_copy_only=False), listed.offsets.to_numpy()
            for i, ord_ in enumerate(batch.column(0).to_pylist()):
                sets.append(np.sort(flat[ends[i] : ends[i + 1]].view(np.uint64)))
                ords.append(ord_)
                held += len(sets[-1])
                if held >= PACKED_VALUES or len(sets) == PACKED_ROWS:
                    yield table()
                    ords, sets, held = [], [], 0
        if sets:
            yield table()

    return pack


def _counted(blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one range -> values that more than one row has, with that number, and the head of each row: the least
    ord with its digest."""
    out, some = [], blocks[blocks["kind"] == 0]
    if len(some):
        each = [_sorted_numbers(d) for d in some["a"]]
        values, sizes = np.concatenate(each), [len(x) for x in each]
        by = np.argsort(values, kind="stable")
        new = np.concatenate([[True], values[by][1:] != values[by][:-1]])
        runs = np.diff(np.append(np.flatnonzero(new), len(values)))
        df = np.empty(len(values), np.int64)
        df[by] = np.repeat(runs, runs)
        ends = np.cumsum([0, *sizes])
        for block, at, x, a, b in zip(some["block"], some["at"], each, ends[:-1], ends[1:]):
            k = df[a:b] > 1
            if k.any():
                out.append((0, block, 0, _planes(_numbers(at, b - a)[k]), _sorted_planes(x[k]), _planes(df[a:b][k].astype(np.uint64)), b""))
    some = blocks[blocks["kind"] > 0]
    if len(some):
        ords, digests = np.frombuffer(b"".join(some["a"]), np.int64), np.frombuffer(b"".join(some["c"]), np.uint64).reshape(-1, 2)
        by = np.lexsort((ords, digests[:, 1], digests[:, 0]))
        new = np.concatenate([[True], (digests[by][1:] != digests[by][:-1]).any(axis=1)])
        heads = np.empty(len(ords), np.int64)
        heads[by] = ords[by][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        ends = np.cumsum([0, *[len(x) // 8 for x in some["a"]]])
        out += [(0, block, kind, at, o, n, heads[a:b].tobytes()) for block, kind, at, o, n, a, b in zip(some["block"], some["kind"], some["at"], some["a"], some["b"], ends[:-1], ends[1:])]
    return pd.DataFrame(out, columns=blocks.columns)


def _rows(least: float):
    def rows(blocks: pd.DataFrame) -> pd.DataFrame:
        """All of one block -> rows that have an earlier head, and heads that may match another, with their prefix (places from
        `first` on: values of one row alone come before) and all values that another row has."""
        told, some = blocks[blocks["kind"] > 0], blocks[blocks["kind"] == 0]
        at = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.int64) for x in told["at"]]])
        if not len(at) or len(at) != told["kind"].iloc[0]:  # a block is named by its rows
            raise RuntimeError("a task was repeated and read its rows in another order: checkpoint them first")
        ords, n, heads = (np.concatenate([np.frombuffer(x, np.int64) for x in told[c]])[np.argsort(at)] for c in ("a", "b", "c"))
        out = [(ords[i], heads[i], n[i], None, None, None) for i in np.flatnonzero(ords != heads)]
        if len(some):
            each = [_sorted_numbers(x) for x in some["a"]]
            values = np.concatenate(each)
            of, df = (np.concatenate([_numbers(d, len(x)) for d, x in zip(some[c], each)]).astype(np.int64) for c in ("at", "b"))
            by = np.lexsort((values, df, of))
            values, ends = values[by].view(np.int64), np.searchsorted(of[by], np.arange(len(n) + 1))
            k = np.diff(ends)
            first, length = n - k, n - np.ceil(n * least - 1e-9).astype(np.int64) + 1
            for i in np.flatnonzero((ords == heads) & (k > 0) & (first < length)):
                shared = values[ends[i] : ends[i + 1]]
                out.append((ords[i], ords[i], n[i], first[i], shared[: length[i] - first[i]], shared))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _ROW.split(", ")]).astype({"first": "Int32"})

    return rows


def _settled(edges: DataFrame) -> DataFrame:
    """edges(by, ord), all similar pairs with by < ord -> (ord) that are dropped: those with an edge from a row that isn't."""
    edges, spark, gone = cut(edges), edges.sparkSession, []
    while (n := edges.count()) > LOCAL:
        leads = cut(edges.select("by").distinct().join(edges.select(F.col("ord").alias("by")).distinct(), "by", "left_anti"))
        gone.append(cut(edges.join(leads, "by", "left_semi").select("ord").distinct()))
        left = edges.join(leads, "by", "left_anti").join(gone[-1], "ord", "left_anti")
        edges = cut(left.join(gone[-1].select(F.col("ord").alias("by")), "by", "left_anti"))
    if n or not gone:
        pairs, dropped = edges.select("by", "ord").toPandas().sort_values("ord"), set()
        for by, ord_ in zip(pairs["by"].tolist(), pairs["ord"].tolist()):
            if by not in dropped:
                dropped.add(ord_)
        gone.append(spark.createDataFrame(pd.DataFrame({"ord": np.array(sorted(dropped), np.int64)}), "ord long"))
    out = gone[0]
    for more in gone[1:]:
        out = out.unionByName(more)
    return out


def greedy_dropped(rows: DataFrame, least: float) -> DataFrame:
    """rows(ord long, unique; set array<long> of distinct values) -> (ord, by): in order of ord, a row is dropped when an
    earlier row that stays has a similarity of `least` or more; by is the first such row. Not transitive: a dropped row drops
    nobody. A null ord has no place in the order and is left out.

    Equal sets are settled as one. Rows go in batches in order of ord, each some times as large as all before. A batch is held
    against the rows that stay first, of which similar sets hold few, so that of a large group of near copies few are left to be
    compared with each other. Batches are cut by reliable checkpoints."""
    spark = rows.sparkSession
    if rows.schema["ord"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("ord must be a whole number")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)
    ranges = max(RANGES, 1 << int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length())
    given = rows.where("ord is not null").select(F.col("ord").cast("long").alias("ord"), F.coalesce("set", F.array().cast("array<long>")).alias("set"))
    blocks = given.mapInArrow(_blocks(ranges), _BLOCK).groupBy("range").applyInPandas(_counted, _BLOCK)
    table = cut(blocks.groupBy("block").applyInPandas(_rows(least), _ROW))
    heads = table.where("prefix is not null")
    entries = heads.select("ord", "n", "first", F.posexplode("prefix").alias("k", "value")).select("value", "ord", "n", (F.col("first") + F.col("k")).alias("at"))

    def similar(a: DataFrame, b: DataFrame) -> DataFrame:
        """(by, ord) of entries a and b, by earlier, that are similar."""
        left = a.select("value", F.col("ord").alias("by"), F.col("n").alias("m"), F.col("at").alias("i"))
        both = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("at"))  # at most, from this value on
        may = (F.col("by") < F.col("ord")) & (F.least("m", "n") >= F.greatest("m", "n") * least - 1e-6) & (both >= (F.col("m") + F.col("n")) * (least / (1 + least)) - 1e-6)
        pairs = left.join(b, "value").where(may).select("by", "ord").distinct()
        of = lambda name, n, s: heads.select(F.col("ord").alias(name), F.col("n").alias(n), F.col("shared").alias(s))
        common = F.size(F.array_intersect("s", "t"))
        return pairs.join(of("by", "m", "s"), "by").join(of("ord", "n", "t"), "ord").where(common / (F.col("m") + F.col("n") - common) >= least).select("by", "ord")

    total, shares = heads.count(), [1.0]
    while total * shares[0] > FIRST:
        shares.insert(0, shares[0] / GROWTH)
    ends = heads.approxQuantile("ord", shares[:-1], 1e-4) if shares[1:] else []  # any ends are right ones
    dropped, low = None, None
    for high in [*sorted(set(map(int, ends))), None]:
        batch = entries if low is None else entries.where(F.col("ord") > low)
        batch = batch if high is None else batch.where(F.col("ord") <= high)
        if low is not None:
            stay = entries.where(F.col("ord") <= low).join(dropped.select("ord"), "ord", "left_anti")
            hit = cut(similar(stay, batch).groupBy("ord").agg(F.min("by").alias("by")))
            dropped, batch = dropped.unionByName(hit), batch.join(hit, "ord", "left_anti")
        edges = cut(similar(batch, batch))
        gone = _settled(edges).select(F.col("ord").alias("by"))
        found = cut(edges.join(gone, "by", "left_anti").groupBy("ord").agg(F.min("by").alias("by")))
        dropped, low = found if dropped is None else dropped.unionByName(found), high
    copies = table.where("ord != head").select("ord", "head").join(dropped.select(F.col("ord").alias("head"), "by"), "head", "left")
    return dropped.select("ord", "by").unionByName(copies.select("ord", F.coalesce("by", "head").alias("by")))
