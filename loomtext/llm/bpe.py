"""BPE encoding and decoding.

Each piece of text becomes a doubly linked list of symbols. A priority queue holds (merge rank, position) of
all neighbours that have a merge; the smallest is taken, skipped if its symbols have changed meanwhile
(stale), else the two symbols become one and the new neighbours enter the queue. Equal ranks go from left to
right. Decoding concatenates the vocabulary's byte strings and then reads them as UTF-8, U+FFFD for what
isn't valid.

Pieces are found by the pattern of the vocabulary file; results of short pieces are kept in a bounded table, so
a frequent word is merged once per worker. Null or empty text has no tokens and decodes to the empty string;
strings of special tokens inside a text become those tokens; texts are never cut in the middle of a piece, so very
long ones give the same ids; repeated rows give equal ids; an empty table gives an empty result.
"""
from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import vocabulary
from loomtext.llm.common import by_bytes, map_rows, of_row

#: Entries of a worker's table of merged pieces, and the longest piece kept there.
TABLE, LONGEST = 600_000, 48


def merge(piece: bytes, v: vocabulary.Vocabulary) -> list[int]:
    """The token ids of one piece."""
    symbols = [v.singles[b] for b in piece]
    n = len(symbols)
    if n < 2:
        return symbols
    ranks = v.merges.get
    queue = [(m >> 20) << 32 | i for i in range(n - 1) if (m := ranks(symbols[i] << 20 | symbols[i + 1])) is not None]
    heapq.heapify(queue)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while queue:
        top = heapq.heappop(queue)
        i = top & 0xFFFFFFFF
        j = after[i]
        if j >= n or symbols[i] < 0:
            continue
        m = ranks(symbols[i] << 20 | symbols[j])
        if m is None or m >> 20 != top >> 32:
            continue  # stale
        new = m & 0xFFFFF
        symbols[i], symbols[j] = new, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (m := ranks(new << 20 | symbols[k])) is not None:
                heapq.heappush(queue, (m >> 20) << 32 | i)
        h = before[i]
        if h >= 0 and (m := ranks(symbols[h] << 20 | new)) is not None:
            heapq.heappush(queue, (m >> 20) << 32 | h)
    return [s for s in symbols if s >= 0]


class _Pieces(dict):
    """Piece of text -> its ids as little-endian 32-bit integers."""

    def __init__(self, v: vocabulary.Vocabulary):
        super().__init__()
        self.v = v

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.v), dtype="<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= TABLE:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        self.path, self.v = path, vocabulary.load(path)
        self.find = regex.compile(vocabulary.PATTERN).findall
        self.table = _Pieces(self.v)
        self.special = vocabulary.special_pattern(self.v.specials)

    @functools.cached_property
    def library(self):
        """The library's own piece finder, for characters that Unicode tables may class differently."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer

    def _plain(self, text: str) -> bytes:
        get, out = self.table.__getitem__, []
        for part in vocabulary.cut(text):
            if vocabulary.plain(part):
                pieces = self.find(part)
            else:
                pieces = [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)]
            out.append(b"".join(map(get, pieces)))
        return out[0] if len(out) == 1 else b"".join(out)

    def encode_packed(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.special or not any(s in text for s in self.v.specials):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()])] if m.start() > at else []
            out.append(np.array([self.v.specials[m[0]]], dtype="<u4").tobytes())
            at = m.end()
        return b"".join(out + [self._plain(text[at:])] * (at < len(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        """An id outside the vocabulary raises IndexError."""
        return b"".join(map(self.v.tokens.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker process and file."""
    return Codec(path)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with an array of token ids in column `out`, which replaces a column of that name."""

    def run(batches):
        c = codec(path)
        for b in by_bytes(batches, of_row(text)):
            packed = [c.encode_packed(t) for t in of_row(text)(b).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([b.column("row"), ids], names=["row", out])

    return map_rows(docs, run, f"{out} array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of the ids in column `out`, which replaces a column of that name; null ids: the empty string."""

    def run(batches: Iterator[pa.RecordBatch]):
        c = codec(path)
        for b in by_bytes(batches, of_row(ids)):
            texts = [c.decode(x or []) for x in of_row(ids)(b).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", out])

    return map_rows(df, run, f"{out} string")


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode each text and decode its ids in one pass: doc_id, n_tokens, digests of the ids and of the decoded text.

    The ids never leave the worker, so nothing but the digests is moved.
    """
    rows = docs.select("doc_id", F.col(text).alias("text"))

    def run(batches):
        c = codec(path)
        for b in by_bytes(batches, "text"):
            n, ids, back = [], [], []
            for t in b.column("text").to_pylist():
                packed = c.encode_packed(t)
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(c.decode(np.frombuffer(packed, dtype="<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
