"""Line dedup by winnowing over line hashes.

A window is a shortest run of lines with at least MIN_WORDS words. The position of its least line hash is selected as a
fingerprint, so any repeated run of MIN_WORDS words holds the same one at the same place. A fingerprint is known by its
line hash and by the lines of the window that selected it; its positions join the first one (a star, not all pairs),
matches are extended both ways while lines agree, and the later run is deleted.

A run may also reach MIN_WORDS only with words of the partly shared lines at its edges. Of every line break inside such a
run the half window of words on its longer side repeats, which a bit filter of all repeated ones tells: windows of exactly
MIN_WORDS words that pass join the first one that is equal, and the whole lines inside the later ones are deleted.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import KeyFilter, materialize, release, split_join, text_or_empty
from tessera.llm.minhash import mix

MIN_WORDS = 50

_ROOT, _UNROOT = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTE = np.random.default_rng(20_240_610).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ZERO = np.zeros(1, np.int64)
_AFTER = np.uint64(0xA0761D6478BD642F)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first powers, n and more, of the root and of its inverse; kept and extended as texts get longer."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (_ROOT, _UNROOT)]
    return _powers


_SPACE_BYTE = np.zeros(256, bool)
_SPACE_BYTE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: White space beyond ASCII.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bytes of text that a worker lays out at once.
CHUNK_BYTES = 1 << 18


class Layout:
    """Words and lines of several documents, counted through all of them; blank lines don't count."""

    def __init__(self, words: np.ndarray, lines: np.ndarray, min_words: int):
        """words: of each line; lines: of each document."""
        self.words, self.count, self.min_words, self.half = words, lines, min_words, min_words // 2
        self.total = np.concatenate([_ZERO, np.cumsum(words)])
        self.first, self.ends = self.total[:-1], self.total[1:]
        self.doc = np.repeat(np.arange(len(lines)), lines)
        last = np.cumsum(lines)
        self.line_end, self.doc_line = last, last - lines
        self.doc_first, self.doc_end = self.total[last - lines], self.total[last]
        inner = np.arange(len(words)) != self.doc_line[self.doc]
        #: words before which a line breaks, and their documents; those with half a window of words before and behind them
        self.breaks, self.break_doc = self.first[inner], self.doc[inner]
        self.before = self.breaks - self.half >= self.doc_first[self.break_doc]
        self.after = self.breaks + self.half <= self.doc_end[self.break_doc]
        #: order of half windows: by document, those before breaks first
        self.order = np.argsort(np.concatenate([2 * self.break_doc[self.before], 2 * self.break_doc[self.after] + 1]), kind="stable")

    def contexts_of_doc(self) -> np.ndarray:
        n = len(self.count)
        return np.bincount(self.break_doc[self.before], minlength=n) + np.bincount(self.break_doc[self.after], minlength=n)

    def windows(self, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, document) of the windows of min_words words over a line break that may repeat: of every break inside,
        the half window on its longer side is on. on: of each half window, in order."""
        size, half = self.min_words, self.half
        flags = np.empty(len(on), bool)
        flags[self.order] = on
        before, after = self.before.copy(), self.after.copy()
        k = int(before.sum())
        before[self.before], after[self.after] = flags[:k], flags[k:]
        n = int(self.total[-1])
        inside, bad = np.zeros(n + 2, np.int64), np.zeros(n + 2, np.int64)
        least, most = self.doc_first[self.break_doc], self.doc_end[self.break_doc] - size

        def mark(into: np.ndarray, some: np.ndarray | slice, low: int, high: int) -> None:
            a, b = np.maximum(self.breaks[some] + low, least[some]), np.minimum(self.breaks[some] + high, most[some])
            a, b = a[a <= b], b[a <= b]
            into += np.bincount(a, minlength=n + 2) - np.bincount(b + 1, minlength=n + 2)

        mark(inside, before | after, 1 - size, -1)
        mark(bad, ~before, 1 - size, -half)
        mark(bad, ~after, half - size, -1)
        at = np.flatnonzero((np.cumsum(inside) > 0) & (np.cumsum(bad) == 0))
        return at, self.doc[np.searchsorted(self.ends, at, side="right")]


class Texts(Layout):
    """Layout of texts, with hashes of spans of words from sums over their bytes. White space counts as one space, or as one
    line break, between words, and not at the edges of a span."""

    def __init__(self, texts: list[str], min_words: int):
        data = [(t if t.isascii() else _WIDE.sub(" ", t)).encode() for t in texts]
        sizes = np.array([len(d) + 1 for d in data], np.int64)
        b = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
        space = _SPACE_BYTE[b]
        solid = ~space
        start = np.flatnonzero(solid[1:] & space[:-1]) + 1
        if solid[0]:
            start = np.concatenate([_ZERO, start])
        end = np.flatnonzero(solid[:-1] & space[1:]) + 1
        break_at = np.cumsum(b == 10)
        doc_at = np.cumsum(sizes) - sizes
        doc = np.searchsorted(doc_at, start, side="right") - 1
        line = break_at[start]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(fresh)
        super().__init__(np.diff(np.append(first, len(start))), np.bincount(doc[first], minlength=len(texts)), min_words)
        #: the number of a line in its text, blank ones counted
        self.place = line[first] - np.concatenate([_ZERO, break_at])[doc_at[doc[first]]]
        length = end - start
        self.start = np.cumsum(length) - length + np.arange(len(length)) + 1  # a separator before each word
        self.end = self.start + length
        plain = np.empty(int(solid.sum()) + len(start), np.uint8)
        letters = np.ones(len(plain), bool)
        letters[self.start - 1] = False
        plain[letters] = b[solid]
        plain[self.start - 1] = np.where(fresh, 10, 32)
        up, self.down = powers(len(plain) + 1)
        self.sums = np.zeros(len(plain) + 1, np.uint64)
        np.cumsum(_BYTE[plain] * up[: len(plain)], out=self.sums[1:])

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        low = self.start[at]
        return mix((self.sums[self.end[at + size - 1]] - self.sums[low]) * self.down[low]).view(np.int64)

    def contexts(self) -> np.ndarray:
        """Hashes of the half windows of words beside line breaks, in order."""
        before = self.hashes(self.breaks[self.before] - self.half, self.half)
        after = mix(self.hashes(self.breaks[self.after], self.half).view(np.uint64) ^ _AFTER).view(np.int64)
        return np.concatenate([before, after])[self.order]

    def lines(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of windows: the first and last whole line's places (last < first without one), the first and last touched."""
        end = at + self.min_words
        a, b = np.searchsorted(self.first, at), np.searchsorted(self.ends, end, side="right") - 1
        u, v = np.searchsorted(self.first, at, side="right") - 1, np.searchsorted(self.ends, end)
        whole = a <= b
        return np.where(whole, self.place[np.where(whole, a, 0)], 0), np.where(whole, self.place[np.where(whole, b, 0)], -1), self.place[u], self.place[v]

    def winnowed(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every window of lines: its first line, its least hash's (the last of equal ones), and the line behind it. A queue
        holds the lines that may still become the least."""
        stop = np.searchsorted(self.total, self.first + self.min_words)
        start = np.flatnonzero(stop <= self.line_end[self.doc])
        least, queue, end, values = [], deque(), 0, hashes.tolist()
        for low, high in zip(start.tolist(), stop[start].tolist()):
            end = max(end, low)
            while end < high:
                while queue and values[queue[-1]] >= values[end]:
                    queue.pop()
                queue.append(end)
                end += 1
            while queue[0] < low:
                queue.popleft()
            least.append(queue[0])
        return start, np.array(least, np.int64), stop[start]


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about CHUNK_BYTES of text each, one row at least."""
    held, size, begin = [], 0, 0
    for i, text in enumerate(map(pa.StringScalar.as_py, batch.column(column))):
        held.append(text)
        size += len(text)
        if size >= CHUNK_BYTES:
            yield batch.slice(begin, len(held)), held
            held, size, begin = [], 0, i + 1
    if held:
        yield batch.slice(begin), held


def listed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([_ZERO, np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int64()).cast(kind))


def lined(docs: DataFrame, min_words: int) -> DataFrame:
    """docs(d, th, text) -> (d, th, place, hash, words, least, mark, whole, around, marks): arrays over the lines that aren't
    blank (place, hash with white space collapsed, words), over the windows (least line, its hash, hash of all lines), over
    the half windows beside line breaks (hash), and over the selected lines (hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, 2):
                t = Texts(texts, min_words)
                hashes = t.hashes(t.first, t.words)
                start, least, stop = t.winnowed(hashes)
                whole = t.hashes(t.first[start], t.total[stop] - t.total[start])
                n, of = len(texts), t.doc[start]
                windows = np.bincount(of, minlength=n)
                picked = np.ones(len(least), bool)
                picked[1:] = least[1:] != least[:-1]
                arrays = [
                    listed(t.place, t.count, pa.int32()), listed(hashes, t.count, pa.int64()), listed(t.words, t.count, pa.int32()), listed(least - t.doc_line[of], windows, pa.int32()),
                    listed(hashes[least], windows, pa.int64()), listed(whole, windows, pa.int64()), listed(t.contexts(), t.contexts_of_doc(), pa.int64()), listed(hashes[least[picked]], np.bincount(of[picked], minlength=n), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], ["d", "th", "place", "hash", "words", "least", "mark", "whole", "around", "marks"])

    return docs.select("d", "th", "text").mapInArrow(run, "d long, th long, place array<int>, hash array<long>, words array<int>, least array<int>, mark array<long>, whole array<long>, around array<long>, marks array<long>")


def break_windows(docs: DataFrame, held: KeyFilter, min_words: int) -> DataFrame:
    """docs(d, th, text) -> (d, th, g, p, a, b, u, v, pg, pp), arrays over a text's windows that may repeat: hash, place and
    what lines() says of those with a whole line inside, hash and place of the plain others."""
    sent = held.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            for part, texts in chunks(batch, 2):
                t = Texts(texts, min_words)
                at, of = t.windows(KeyFilter.on(bits, t.contexts()))
                g, p, (a, b, u, v) = t.hashes(at, min_words), at - t.doc_first[of], t.lines(at)
                rows = np.flatnonzero(np.bincount(of, minlength=len(texts)))
                counts = lambda some: np.bincount(of[some], minlength=len(texts))[rows]
                whole, plain = a <= b, a > b
                arrays = [listed(x[whole], counts(whole), pa.int64() if x is g else pa.int32()) for x in (g, p, a, b, u, v)]
                arrays += [listed(g[plain], counts(plain), pa.int64()), listed(p[plain], counts(plain), pa.int32())]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(rows)) for k in (0, 1)), *arrays], ["d", "th", "g", "p", "a", "b", "u", "v", "pg", "pp"])

    ints = ", ".join(f"{k} array<int>" for k in "pabuv")
    return docs.select("d", "th", "text").mapInArrow(run, f"d long, th long, g array<long>, {ints}, pg array<long>, pp array<int>")


def edged_runs(docs: DataFrame, table: DataFrame, runs: DataFrame, min_words: int) -> DataFrame:
    """docs(d, th, text), lined() as a written table, runs(d, th, runs) of whole lines -> (d, th, a, b): the whole lines inside
    repeated runs of min_words words that have a line break inside."""
    repeated = materialize(table.select(F.explode("around").alias("h")).groupBy("h").count().where("count > 1").select("h"), "repeated")
    held = KeyFilter(repeated, repeated.count())
    bits = held.sent

    def any_window(words: pd.Series, around: pd.Series) -> pd.Series:
        lines = np.array([len(w) for w in words], np.int64)
        t = Layout(np.concatenate([_ZERO[:0], *words]), lines, min_words)
        _, of = t.windows(KeyFilter.on(bits.value, np.concatenate([_ZERO[:0], *around]).astype(np.int64)))
        return pd.Series(np.bincount(of, minlength=len(lines)) > 0)

    repeats = F.pandas_udf(any_window, T.BooleanType())
    chosen = materialize(table.select("d", "th", repeats("words", "around").alias("some")).where("some").select(F.xxhash64("d", "th").alias("h")), "chosen")
    texts = docs.where(KeyFilter(chosen, chosen.count()).may_hold(F.xxhash64("d", "th")))
    found = materialize(break_windows(texts, held, min_words), "breaks")

    indexes = T.ArrayType(T.IntegerType())

    @F.pandas_udf(indexes)
    def outside(runs: pd.Series, u: pd.Series, v: pd.Series) -> pd.Series:
        """Indexes of the windows that no run holds. A window inside a deleted run has an earlier copy, so the first of its
        kind is never among those left out."""
        out = []
        for some, first, last in zip(runs, u, v):
            low, high = np.array([(r[0], r[1]) for r in some]).T  # disjoint and in order
            at = np.searchsorted(low, first, side="right") - 1
            out.append(np.flatnonzero((at < 0) | (last > high[at])).astype(np.int32))
        return pd.Series(out)

    def chosen_of(rows: DataFrame, at: Column) -> DataFrame:
        # A struct for each index: exploding indexes would repeat the arrays in every row.
        return rows.select("d", "th", F.inline(F.transform(at, lambda i: F.struct(*[F.get(k, i).alias(k) for k in "gpab"]))))

    # Only windows with a whole line delete anything; the others count as first copies of those.
    some = found.where(F.size("g") > 0).select("d", "th", *"gpabuv")
    some = some.withColumn("may", KeyFilter(runs.select(F.xxhash64("d", "th").alias("h")), runs.count()).may_hold(F.xxhash64("d", "th")))
    free = some.where("not may").select("d", "th", F.inline(F.arrays_zip("g", "p", "a", "b")))
    near = some.where("may").join(runs.hint("merge"), ["d", "th"], "left")
    loose = near.where("runs is null").select("d", "th", F.inline(F.arrays_zip("g", "p", "a", "b")))
    near = near.where("runs is not null")
    whole = materialize(free.unionByName(loose).unionByName(chosen_of(near, outside("runs", "u", "v"))), "windows")
    sent = KeyFilter(whole.select(F.col("g").alias("h")), whole.count()).sent
    held_by = F.pandas_udf(lambda g: pd.Series([np.flatnonzero(KeyFilter.on(sent.value, np.asarray(h, np.int64))).astype(np.int32) for h in g]), indexes)
    plain = found.where(F.size("pg") > 0).select("d", "th", "pg", "pp", held_by("pg").alias("at"))
    pair = lambda i: F.struct(F.get("pg", i).alias("g"), F.get("pp", i).alias("p"), F.lit(0).alias("a"), F.lit(-1).alias("b"))
    windows = materialize(whole.unionByName(plain.select("d", "th", F.inline(F.transform("at", pair)))), "windows")
    for done in (found, whole):
        release(done)
    again = materialize(windows.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select(F.col("g").alias("h")), "again")
    windows = materialize(windows.where(KeyFilter(again, again.count()).may_hold(F.col("g"))), "windows")
    first = windows.groupBy("g").agg(F.min(F.struct("d", "th", "p")).alias("f"), F.count("*").alias("n")).where("n > 1").select("g", "f", "n")
    later = split_join(windows.where("a <= b"), first, ["g"], "n", windows.count(), F.struct("d", "th", "p")).where("not (d = f.d and th = f.th and p = f.p)")
    return later.select("d", "th", "a", "b").distinct()


def merged(runs: Iterable[Sequence[int]]) -> list[list[int]]:
    """Sorted line ranges, those that share a line made one."""
    out: list[list[int]] = []
    for a, b in sorted((int(a), int(b)) for a, b in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def all_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(d, th, text) -> (d, th, runs): the line ranges to delete of each document that has any."""
    table = materialize(lined(docs, min_words), "lined")
    repeats = materialize(table.groupBy("d", "th").count().where("count > 1").select("d", "th"), "repeats")
    if not repeats.isEmpty():
        once = table.join(repeats, ["d", "th"], "left_semi").dropDuplicates(["d", "th"])
        table = materialize(table.join(repeats, ["d", "th"], "left_anti").unionByName(once), "lined")
    merge = F.pandas_udf(lambda s: pd.Series([merged(x) for x in s]), T.ArrayType(T.ArrayType(T.IntegerType())))
    whole = materialize(repeated_runs(table, min_words).select("d", "th", merge("runs").alias("runs")), "whole")
    edged = edged_runs(docs, table, whole, min_words).select("d", "th", F.array("a", "b").alias("r"))
    ranges = whole.select("d", "th", F.explode("runs").alias("r")).unionByName(edged)
    return ranges.groupBy("d", "th").agg(F.collect_list("r").alias("runs")).select("d", "th", merge("runs").alias("runs"))


class LinePrefixes:
    """Hashes of all spans of a document's lines, by sums of the lines' hashes times powers of one root."""

    def __init__(self, hashes: np.ndarray):
        self.n = n = len(hashes)
        up, self.power = powers(n + 1)
        values = mix(np.asarray(hashes, np.int64).view(np.uint64))
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(values * up[:n], dtype=np.uint64)]

    def of(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.power[at]


def reach(later: LinePrefixes, earlier: LinePrefixes, i: np.ndarray, j: np.ndarray, ahead: bool) -> np.ndarray:
    """How many lines from the positions i and j on (or before them) agree, by bisection for all matches at once."""
    low = np.zeros(len(i), np.int64)
    high = np.minimum(later.n - i, earlier.n - j) if ahead else np.minimum(i, j)
    while (open_ := low < high).any():
        half = np.where(open_, (low + high + 1) // 2, low)
        back = 0 if ahead else half
        same = later.of(i - back, half) == earlier.of(j - back, half)
        low, high = np.where(same, half, low), np.where(same, high, half - 1)
    return low


def extended(later: np.ndarray, earlier: np.ndarray, words: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, min_words: int) -> list[list[int]]:
    """Line ranges (first, last) of the later text that repeat the earlier one's, for matching positions i and j. Time
    is in proportion to lines and matches, but for a logarithm, also where all lines are equal."""
    a, b = LinePrefixes(later), LinePrefixes(earlier)
    first, end = i - reach(a, b, i, j, False), i + reach(a, b, i, j, True)
    total = np.r_[0, np.cumsum(words)]
    long = total[end] - total[first] >= min_words
    place = np.asarray(place)
    return merged(np.unique(np.stack([place[first[long]], place[end[long] - 1]], axis=1), axis=0).tolist()) if long.any() else []


def repeated_runs(table: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """lined() as a written table -> (d, th, runs): the ranges of repeated whole lines of each document that has any.
    Documents are in the order of (d, th); of equal runs the first stays."""
    marks = table.select(F.explode("marks").alias("h"))
    repeated = materialize(marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    selected = table.select("d", "th", F.inline(F.arrays_zip("least", "whole", "mark"))).toDF("d", "th", "i", "g", "h")
    selected = materialize(selected.where(KeyFilter(repeated, repeated.count()).may_hold(F.col("h"))), "selected")
    first = selected.groupBy("h", "g").agg(F.min(F.struct("d", "th", "i")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = first.select("h", "g", "n", F.col("f.d").alias("fd"), F.col("f.th").alias("fth"), F.col("f.i").alias("j"))
    pairs = split_join(selected, first, ["h", "g"], "n", selected.count(), F.struct("d", "th", "i")).where("not (d = fd and th = fth and i = j)")
    pairs = pairs.groupBy("d", "th", "fd", "fth").agg(F.collect_set(F.struct("i", "j")).alias("m"))
    pairs = materialize(pairs.select("d", "th", "fd", "fth", F.col("m.i").alias("i"), F.col("m.j").alias("j")), "pairs")
    release(selected)
    n = pairs.count()
    of = lambda d, th: table.where(KeyFilter(pairs.select(F.xxhash64(d, th).alias("h")), n).may_hold(F.xxhash64("d", "th")))
    own = of("d", "th").select("d", "th", "place", F.col("hash").alias("later"), "words")
    # A passage that very many documents share joins all of them to its first one: that one's lines are repeated instead.
    fans = pairs.groupBy("fd", "fth").agg(F.count("*").alias("fan"))
    other = of("fd", "fth").select(F.col("d").alias("fd"), F.col("th").alias("fth"), F.col("hash").alias("earlier")).join(fans, ["fd", "fth"])
    both = split_join(pairs.join(own, ["d", "th"]), other, ["fd", "fth"], "fan", n, F.struct("d", "th"))

    def runs(later: pd.Series, earlier: pd.Series, words: pd.Series, place: pd.Series, i: pd.Series, j: pd.Series) -> pd.Series:
        return pd.Series([extended(a, b, w, p, np.asarray(x, np.int64), np.asarray(y, np.int64), min_words) for a, b, w, p, x, y in zip(later, earlier, words, place, i, j)])

    found = F.pandas_udf(runs, T.ArrayType(T.ArrayType(T.IntegerType())))("later", "earlier", "words", "place", "i", "j")
    return both.select("d", "th", found.alias("runs")).where(F.size("runs") > 0).groupBy("d", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, runs (array of [first, last] line), text without them.

    A run has min_words words, which may count those of partly shared lines at its edges; its whole lines are deleted.
    Of equal runs the one in the document with the smallest doc_id stays (null ids come first, ties by a hash of the
    text). Blank lines neither match nor break a match. Null text counts as empty. Rows that repeat a doc_id and a text
    are one document and share its result; an empty table gives an empty table; other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("d", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("th", F.xxhash64("text"))
    runs = materialize(all_runs(rows, min_words), "runs")
    lines = F.split("text", "\n", -1)
    inside = lambda i: F.exists("runs", lambda r: (r[0] <= i) & (i <= r[1]))
    kept = F.filter(lines, lambda x, i: ~inside(i))
    # The runs grow with the corpus: a merge join at every size, and only of the texts that may have any.
    may = KeyFilter(runs.select(F.xxhash64("d", "th").alias("h")), runs.count()).may_hold(F.xxhash64("d", "th"))
    marked = rows.withColumn("__may", may)
    clear = marked.where("not __may").withColumn("runs", F.lit(None).cast("array<array<int>>"))
    joined = marked.where("__may").join(runs.hint("merge"), ["d", "th"], "left").unionByName(clear)
    cut = joined.select("doc_id", "runs", "text", F.size(lines).cast("long").alias("n_lines"), F.when(F.col("runs").isNotNull(), kept).alias("kept"))
    return cut.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.col("n_lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("runs", F.array().cast("array<array<int>>")).alias("runs"),
        F.coalesce(F.array_join("kept", "\n"), "text").alias("text"),
    )
