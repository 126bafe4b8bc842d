"""BPE encoding and decoding by forced-boundary splitting.

A byte pair (a, b) that occurs inside no token of the vocabulary marks a certain cut: no merge can ever span it. A text
is cut at all such pairs where the cut also leaves the pre-tokenizer's matches as they are, the fragments are encoded
independently (each distinct one once per worker), and their ids are concatenated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import text_or_empty

#: Distinct fragments that a worker remembers before it starts anew.
MEMO_ENTRIES = 400_000
#: White space beyond ASCII: after one of these a cut would change what `\s+(?!\S)` matches.
_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")


def byte_characters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class FragmentMemo(dict):
    """bytes of a fragment -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, fragment: bytes) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        ids = np.array(self.tokenizer.encode(fragment.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(fragment) <= 64:
            self[fragment] = ids
        return ids


class Codec:
    """Of one byte-level vocabulary file; made once per worker."""

    _made: dict[str, Codec] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        chars = byte_characters()
        self.table: list[bytes] = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.inside = np.zeros((256, 256), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            raw = token.encode() if token in special else bytes(chars[c] for c in token)
            self.table[i] = raw
            if len(raw) > 1:
                b = np.frombuffer(raw, np.uint8)
                self.inside[b[:-1], b[1:]] = True
        byte = np.arange(256)
        space = (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
        after, before = ~space, ((byte & 0xC0) != 0x80) & (byte != ord("'"))
        #: certain cuts that also leave the pre-tokenizer's matches alone
        self.cut = ~self.inside & after[:, None] & before[None, :]
        self.ascii_cut = self.cut & (byte < 0x80)[:, None]
        self.memo = FragmentMemo(self.tokenizer)

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def fragments(self, text: str) -> list[bytes]:
        data = text.encode()
        if len(data) < 2:
            return [data] if data else []
        b = np.frombuffer(data, np.uint8)
        cut = self.ascii_cut if _WIDE_SPACE.search(text) else self.cut
        at = (np.flatnonzero(cut[b[:-1], b[1:]]) + 1).tolist()
        return [data[i:j] for i, j in zip([0, *at], [*at, len(data)])]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.fragments(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as binary, little-endian unsigned 32-bit integers. Null text counts as empty and gives no
    ids; rows are encoded one by one, so repeated rows, nulls in other columns and an empty table need no care."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for part in slices(batch):
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, decoded). Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            for part in slices(batch):
                texts = [codec.decode(x or b"") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
