"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are cut by bytes, not rows; texts over a limit are cut where every token must end, before a blank
between a non-blank and an ASCII letter or digit, and the counts of the parts are added.

A byte-level .json whose ids rise with the merge ranks is run by the rank-file engine on the same vocabulary,
several times faster, and by the tokenizers library for the parts with special strings or with characters whose Unicode class
differs between versions; other .json files always by that library; .model files by sentencepiece, whole,
since its pieces depend on neighbours. Null or empty text counts 0; repeats count alike; an empty table gives an
empty result.
"""
from __future__ import annotations

import functools
import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import vocabulary
from loomtext.llm.common import by_bytes



class Counter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
        self.pieces = self.ranks = self.library = None
        self.specials: list[str] = []
        self.reaching: list[str] = []
        self.cuts = False
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        try:
            v = vocabulary.load(path)
        except (ValueError, KeyError):
            return
        self.specials = list(v.specials)
        added = self.library.get_added_tokens_decoder().values()
        # special tokens that hold a blank, or take in the blanks beside them, may reach across a cut
        self.reaching = [t.content for t in added if t.lstrip or t.rstrip or " " in t.content]
        self.cuts = True
        if v.in_rank_order:
            import tiktoken

            ranks = {t: i for i, t in enumerate(v.tokens) if t and i not in set(v.specials.values())}
            self.ranks = tiktoken.Encoding("from-json", pat_str=vocabulary.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def by_ranks(self, text: str) -> bool:
        return self.ranks is not None and not any(s in text for s in self.specials) and vocabulary.plain(text)

    def parts(self, text: str) -> list[str]:
        """The text, cut at safe places if it is long; each part can be run by the engine that suits it."""
        if not self.cuts or any(s in text for s in self.reaching):
            return [text]
        return list(vocabulary.cut(text))

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of one text as unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if self.pieces is not None:
            got = [self.pieces.encode(text)]
        else:
            got = [self.ranks.encode_ordinary(p) if self.by_ranks(p) else self.library.encode(p, add_special_tokens=False).ids for p in self.parts(text)]
        return np.concatenate([np.frombuffer(array("I", x), dtype=np.uint32) for x in got])

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        if self.pieces is not None:
            some = [i for i, t in enumerate(texts) if t]
            out[some] = [len(x) for x in self.pieces.encode([texts[i] for i in some], num_threads=1)]
            return out
        rest = []
        for i, t in enumerate(texts):
            for p in self.parts(t) if t else ():
                if self.by_ranks(p):
                    out[i] += len(self.ranks.encode_ordinary(p))
                else:
                    rest.append((i, p))
        if rest:
            np.add.at(out, [i for i, _ in rest], [len(e.ids) for e in self.library.encode_batch_fast([p for _, p in rest], add_special_tokens=False)])
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker process and file."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row."""
    rows = docs.select("doc_id", F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))

    def run(batches):
        c = counter(path)
        for b in by_bytes(batches, "text"):
            n = c.lengths(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
