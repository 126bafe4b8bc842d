"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Pieces are dealt at random to shards of bounded size. A shard that decreasing best-fit packs to the lower bound, the sum
of lengths over the capacity, is done; each other shard is solved by several islands with seeds of their own, and in every
epoch each island receives the best packing of its neighbour (elite migration, through a written table).
Crossover injects whole well-filled bins of one parent into the other, removes the bins that hold duplicates of their
pieces, and best-fits what was displaced: first in place of pieces of open bins that fill them worse (those are displaced
then), the rest in decreasing order. An island ends when its packing meets the bound. The poorly filled bins of all shards
are packed once more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import materialize, text_or_empty

CAPACITY = 2048
SHARD_ITEMS, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 16_384, 3, 2, 80, 10
#: Share of a bin from which it counts as well filled; below LEFT_OVER a bin is packed again with those of other shards.
WELL_FILLED, LEFT_OVER = 0.998, 0.97
#: Bins that a crossover injects at most, open ones that it breaks up, and those in which displaced pieces are swapped (with
#: SWAP_PIECES at most: pairs of a bin's pieces are looked at); beyond SWAP_ITEMS displaced pieces none are.
INJECTED, OPENED, SWAP_BINS, SWAP_PIECES, SWAP_ITEMS = 3, 3, 256, 48, 80
#: Distinct words that a worker remembers before it starts anew.
MEMO_ENTRIES = 800_000


#: 1: ASCII letters, 2: ASCII digits and symbols but for the apostrophe
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[97:123], _KIND[ord("'")] = 1, 0


def split_words(text: str) -> list[bytes]:
    """Parts of a text whose ids can be concatenated. The vocabulary's pre-tokenizer removes white space and its matches
    end between an ASCII letter and a symbol or digit; only contractions (`'s`) hold both, so apostrophes stay where
    they are. Case goes first, as in the normalizer, unless the text may hold a special token."""
    data = text.encode()
    if b"<|" in data:
        return data.split()
    data = data.lower()
    b = np.frombuffer(data, np.uint8)
    kind = _KIND[b]
    at = np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1
    at = at[(kind[at] > 0) & (kind[at - 1] > 0)]
    return np.insert(b, at, 32).tobytes().split()


class WordIds(dict):
    """A word's bytes -> its ids as little-endian unsigned 32-bit integers."""

    _made: dict[str, WordIds] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: ids with which a match of the pre-tokenizer ends
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def keep(self, words: list[bytes], part: list[int], ids: np.ndarray, cuts: np.ndarray) -> None:
        data, ends = ids.tobytes(), cuts.tolist()
        for k, a, b in zip(part, [0, *ends], ends):
            self[words[k]] = data[4 * a : 4 * b]

    def encode(self, words: list[list[bytes]]) -> list[bytes]:
        """The ids of each list of words. Words not known yet are encoded many at a time, joined by spaces. Words of letters
        are one match each, which its last id tells; of others, the place where a token starts tells its word."""
        found = [list(map(self.get, w)) for w in words]
        new = list({x for w, f in zip(words, found) if None in f for x, ids in zip(w, f) if ids is None})
        if len(self) + len(new) > MEMO_ENTRIES:
            self.clear()
        texts = [w.decode() for w in new]
        plain = [k for k, t in enumerate(texts) if t.isalpha()]
        mixed = [k for k, t in enumerate(texts) if not t.isalpha()]
        for i in range(0, len(plain), 400):
            part = plain[i : i + 400]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.last[ids]) + 1
            if len(cuts) == len(part):
                self.keep(new, part, ids, cuts)
            else:  # a letter whose lower case isn't one
                mixed += part
        for i in range(0, len(mixed), 400):
            part = mixed[i : i + 400]
            coded = self.tokenizer.encode(" ".join([texts[k] for k in part]), add_special_tokens=False)
            starts = np.fromiter((a for a, _ in coded.offsets), np.int64, len(coded.ids))
            self.keep(new, part, np.array(coded.ids, "<u4"), np.searchsorted(starts, np.cumsum([len(texts[k]) + 1 for k in part])))
        out = [b"".join(f) if None not in f else b"".join(ids if ids is not None else self[x] for x, ids in zip(w, f)) for w, f in zip(words, found)]
        for w in new:
            if len(w) > 64:  # a long word is hardly met again
                del self[w]
        return out


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), for each row its ids and end_id, in pieces of at most capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end = WordIds.of(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            coded = (x for i in range(0, batch.num_rows, 500) for x in memo.encode([split_words(t.as_py()) for t in batch.column(1).slice(i, 500)]))
            for d, ids in zip(batch.column(0).to_pylist(), coded):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    doc.append(d)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, room: list[int], capacity: int) -> None:
    """Puts the items of order, in that order, each into the fullest bin that takes it; bins and room change in place.
    Bins with equal room are a stack; a bit mask of the rooms in use finds the least that fits."""
    stacks: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r > 0:
            stacks.setdefault(r, []).append(b)
            mask |= 1 << r
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            stack = stacks[r]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        room[b] = r = r - n
        bins[i] = b
        if r:
            stacks.setdefault(r, []).append(b)
            mask |= 1 << r


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then uneven fill. Greater is better."""
    fill = np.bincount(bins, lengths)
    fill = fill[fill > 0] / capacity
    return -len(fill), float((fill**2).mean()) if len(fill) else 0.0


def swapped(lengths: np.ndarray, bins: np.ndarray, free: list[int], capacity: int, rng: np.random.Generator) -> list[int]:
    """Puts one or two displaced pieces in place of one or two pieces of an open bin wherever they fill it better, until
    that's nowhere the case; changes bins and returns what is displaced then."""
    for _ in range(len(free)):
        placed = np.flatnonzero(bins >= 0)
        fill = np.bincount(bins[placed], lengths[placed]).astype(np.int64)
        opened = np.flatnonzero((fill > 0) & (fill < capacity) & (np.bincount(bins[placed], minlength=len(fill)) <= SWAP_PIECES))
        if not len(opened) or not free:
            break
        if len(opened) > SWAP_BINS:
            opened = rng.choice(opened, SWAP_BINS, replace=False)
        chosen = np.zeros(len(fill), bool)
        chosen[opened] = True
        items = placed[chosen[bins[placed]]]
        items = items[np.argsort(bins[items], kind="stable")]
        where = bins[items]
        parts = [(items, np.full(len(items), -1))]  # the pieces of a bin, and all pairs of them
        for k in range(1, len(items)):
            same = where[k:] == where[:-k]
            if not same.any():
                break
            parts.append((items[:-k][same], items[k:][same]))
        one, two = (np.concatenate(x) for x in zip(*parts))
        size = lengths[one] + np.where(two >= 0, lengths[two], 0)
        target = bins[one]
        f = np.array(free)
        i, j = np.triu_indices(len(f), 1)
        first, second = np.r_[f, f[i]], np.r_[np.full(len(f), -1), f[j]]
        sums = np.r_[lengths[f], lengths[f[i]] + lengths[f[j]]]
        order = np.argsort(sums, kind="stable")
        at = np.searchsorted(sums[order], size + capacity - fill[target], side="right") - 1
        gain = np.where(at >= 0, sums[order][at], 0) - size
        done: set[int] = set()
        used: set[int] = set()
        for x in np.argsort(-gain, kind="stable")[:64].tolist():
            if gain[x] <= 0:
                break
            b, new = int(target[x]), {int(first[order[at[x]]]), int(second[order[at[x]]])} - {-1}
            if b in done or used & new:
                continue
            done.add(b)
            used |= new
            for old in {int(one[x]), int(two[x])} - {-1}:
                bins[old] = -1
                free.append(old)
            for q in new:
                bins[q] = b
                free.remove(q)
        if not done:
            break
    return free


def crossover(lengths: np.ndarray, base: np.ndarray, donor: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(donor, lengths)
    good = np.flatnonzero(fill >= WELL_FILLED * capacity)
    if not len(good):
        good = np.argsort(fill)[-max(1, len(fill) // 10) :]
    injected = np.isin(donor, rng.choice(good, min(len(good), int(rng.integers(1, INJECTED + 1))), replace=False))
    fill = np.bincount(base, lengths)
    broken = np.zeros(len(fill), bool)
    broken[base[injected]] = True
    opened = np.flatnonzero(fill < WELL_FILLED * capacity)
    if len(opened):
        broken[rng.choice(opened, min(len(opened), OPENED), replace=False)] = True
    child = np.where(broken[base], -1, base)
    displaced = np.flatnonzero(broken[base] & ~injected).tolist()
    _, again = np.unique(donor[injected], return_inverse=True)
    child[injected] = again + len(fill)
    if len(displaced) <= SWAP_ITEMS:
        displaced = swapped(lengths, child, displaced, capacity, rng)
    known = child >= 0
    room = (capacity - np.bincount(child[known], lengths[known])).astype(np.int64).tolist() if known.any() else []
    displaced = np.array(displaced, np.int64)
    best_fit(lengths, displaced[np.argsort(-lengths[displaced], kind="stable")], child, room, capacity)
    return np.unique(child, return_inverse=True)[1]


def evolve(lengths: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int) -> np.ndarray:
    """The best packing of an island after its generations; elites: packings it starts from."""
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // capacity)

    def fitted(noise: np.ndarray | float) -> np.ndarray:
        bins = np.full(len(lengths), -1, np.int64)
        best_fit(lengths, np.argsort(-lengths * noise, kind="stable"), bins, [], capacity)
        return bins

    population = [*elites, fitted(1.0)]
    rate = lambda bins, k: (fitness(lengths, bins, capacity), k, bins)
    best = lambda rated: sorted(rated, key=lambda x: x[:2], reverse=True)[:POPULATION]
    rated = best(rate(b, k) for k, b in enumerate(population))
    if -rated[0][0][0] <= least:
        return rated[0][2]
    rated = best([*rated, *(rate(fitted(rng.uniform(1 - 0.05 * k, 1.0, len(lengths))), k) for k in range(len(population), POPULATION))])
    for g in range(GENERATIONS):
        if -rated[0][0][0] <= least or len(rated) < 2:
            break
        i, j = rng.choice(len(rated), 2, replace=False)
        child = rate(crossover(lengths, rated[min(i, j)][2], rated[max(i, j)][2], capacity, rng), POPULATION + g)
        if all(child[0] != r[0] for r in rated):  # twins would take the population over
            rated = best([*rated, child])
    return rated[0][2]


SOLVED = "item long, length long, shard long, island int, bin long, at long, fill long, score double, met boolean"


def _placed(items: np.ndarray, lengths: np.ndarray, bins: np.ndarray, shard: int, island: int, capacity: int) -> pd.DataFrame:
    """A packing as rows of SOLVED: at is a piece's place in its bin, fill the bin's length, met whether it is the bound."""
    count, squares = fitness(lengths, bins, capacity)
    order = np.argsort(bins, kind="stable")
    n, b = lengths[order], bins[order]
    before = np.cumsum(n) - n
    at = np.empty(len(bins), np.int64)
    at[order] = before - before[np.searchsorted(b, b)] if len(b) else before
    fill = np.bincount(bins, lengths)[bins].astype(np.int64)
    met = -count <= -(-int(lengths.sum()) // capacity)
    return pd.DataFrame({"item": items, "length": lengths, "shard": shard, "island": island, "bin": bins, "at": at, "fill": fill, "score": squares / 2 + count, "met": met})


def _solve(items: DataFrame, capacity: int) -> DataFrame:
    """items(item, length, shard, bin), bin being a first packing's or null -> the same columns with at and fill. Shards that
    decreasing best-fit (or the first packing) solves to the bound are done; the others evolve on islands that start from
    it, so the result is never worse."""

    def plain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        lengths = pdf["length"].to_numpy(np.int64)
        bins = np.full(len(lengths), -1, np.int64)
        best_fit(lengths, np.argsort(-lengths, kind="stable"), bins, [], capacity)
        if pdf["bin"].notna().all():
            given = np.unique(pdf["bin"].to_numpy(np.int64), return_inverse=True)[1]
            bins = max(given, bins, key=lambda x: fitness(lengths, x, capacity))
        return _placed(pdf["item"].to_numpy(), lengths, bins, key[0], 0, capacity)

    def epoch(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "source"], kind="stable")
        sources = sorted(pdf["source"].unique())
        first = pdf[pdf["source"] == sources[0]]
        lengths = first["length"].to_numpy(np.int64)
        elites = [np.unique(pdf.loc[pdf["source"] == s, "bin"].to_numpy(np.int64), return_inverse=True)[1] for s in sources]
        bins = evolve(lengths, elites, capacity, seed=int(key[0]) * 1009 + int(key[1]) * 31 + len(elites))
        return _placed(first["item"].to_numpy(), lengths, bins, key[0], key[1], capacity)

    columns = ["item", "length", "shard", "bin", "at", "fill"]
    first = materialize(items.groupBy("shard").applyInPandas(plain, SOLVED), "best-fit")
    done, open_ = first.where("met").select(*columns), first.where("not met")
    if open_.isEmpty():
        return done
    island = F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island")
    state = open_.select("item", "length", "shard", island, F.lit(ISLANDS).alias("source"), "bin")
    for e in range(EPOCHS):
        solved = materialize(state.groupBy("shard", "island").applyInPandas(epoch, SOLVED), "islands")
        if e < EPOCHS - 1:  # an island's own elite and that of its neighbour
            own = solved.select("item", "length", "shard", "island", F.col("island").alias("source"), "bin")
            sent = solved.select("item", "length", "shard", F.expr(f"(island + 1) % {ISLANDS}").alias("island"), F.col("island").alias("source"), "bin")
            state = own.unionByName(sent)
    best = solved.groupBy("shard").agg(F.max(F.struct("score", "island")).alias("best")).select(F.col("shard").alias("s"), F.col("best.island").alias("i"))
    return done.unionByName(solved.join(best, (F.col("shard") == F.col("s")) & (F.col("island") == F.col("i")), "left_semi").select(*columns))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with a long column length (1 to capacity) -> their columns and sequence_id, offset. Pieces of the whole
    capacity are sequences of their own. An empty table gives an empty table."""
    numbered = materialize(pieces.withColumn("__item", F.monotonically_increasing_id()), "pieces")
    small = numbered.where(F.col("length") < capacity).select(F.col("__item").alias("item"), "length")
    number = lambda level: (F.lit(level) * F.lit(1 << 56) + F.col("shard") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id")
    dealt = lambda key, n: F.pmod(F.xxhash64(*key), F.lit(max(1, -(-n // SHARD_ITEMS)))).alias("shard")
    solved = materialize(_solve(small.select("item", "length", dealt(["item"], small.count()), F.lit(None).cast("long").alias("bin")), capacity), "packed")
    good = solved.where(F.col("fill") >= LEFT_OVER * capacity).select("item", number(1), "at")
    # Whole bins are dealt again, each piece with the bin it has, which is what the second packing has to better.
    left = solved.where(F.col("fill") < LEFT_OVER * capacity).withColumn("whole", F.col("shard") * F.lit(1 << 24) + F.col("bin"))
    again = _solve(left.select("item", "length", dealt(["whole"], left.count()), F.col("whole").alias("bin")), capacity).select("item", number(2), "at")
    placed = good.unionByName(again)
    placed = placed.select(F.col("item").alias("__placed"), "sequence_id", F.col("at").alias("offset"))
    joined = numbered.join(placed, numbered["__item"] == placed["__placed"], "left")
    return joined.select(*pieces.columns, F.coalesce("sequence_id", F.col("__item")).alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null text counts as empty (one
    piece of length 1, the end id); rows that repeat a doc_id each have pieces of their own; columns beside the two are
    not read."""
    return pack(token_pieces(docs, path, capacity, id_col=id_col, text_col=text_col), capacity)
