"""A vocabulary for each group of documents, such as a language: counts by group, and a trainer for each group.

Tasks count pre-tokens by group before anything is shuffled. A group whose distinct pre-tokens have MOST_BYTES at most is trained on by one task, which holds
them; larger ones by the distributed trainer (rounds), one after another, and they can't be many, as each has that many distinct bytes.
"""
from __future__ import annotations

from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions.columns import column
from loomtext.operators import merges, rounds, training
from loomtext.sources import files
from loomtext.sources.arrow import by_bytes

#: Bytes of a group's distinct pre-tokens that one task trains on, which takes some 50 times as much memory.
MOST_BYTES = 4 << 20


def _counter(specials: list[str]):
    def run(batches):
        find = regex.compile(T.PATTERN).findall
        cut = T.special_splitter(specials)
        held: dict = {}
        size = 0

        def out():
            rows = [(g, p, n) for g, c in held.items() for p, n in c.items()]
            return pa.record_batch([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["grp", "pretoken", "n"])

        kind = pa.null()
        for b in by_bytes(batches, 1):
            kind = b.schema.field(0).type
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = held.setdefault(g, Counter())
                size -= len(c)
                for part in cut(t)[::2] if t is not None else ():
                    for piece in T.cut(part):
                        c.update(find(piece))
                size += len(c)
                if size > training.HELD:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    return run


def pretoken_counts(docs: DataFrame, group: str, specials: list[str] | None = None, text: str = "text") -> DataFrame:
    """(grp, pretoken, n) over all texts of each group, null being a group too."""
    rows = docs.select(column(group).alias("grp"), column(text).alias("text"))
    return rows.mapInArrow(_counter(specials or []), f"grp {dict(rows.dtypes)['grp']}, pretoken string, n long").groupBy("grp", "pretoken").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, group: str, vocab_size: int, specials: list[str] | None = None, text: str = "text", most: int = MOST_BYTES) -> DataFrame:
    """(grp, token_id, token): for each group the vocabulary that training.train_bpe makes of its documents alone."""
    specials = specials or []
    base = training.base_vocabulary(docs.sparkSession, specials)  # checks them, too
    first = 256 + len(specials)
    n = max(0, vocab_size - first)
    counts = files.stored(pretoken_counts(docs, group, specials, text), "grouped")
    kind = dict(counts.dtypes)["grp"]
    sizes = counts.groupBy("grp").agg(F.sum(F.octet_length("pretoken")).alias("bytes"))
    large = sizes.where(F.col("bytes") > most).select("grp")

    def one(table: pa.Table) -> pa.Table:
        words = dict(zip((w.encode() for w in table.column("pretoken").to_pylist()), table.column("n").to_pylist(), strict=True))
        found = merges.train(words, n)
        grp = table.column("grp").slice(0, 1).combine_chunks().take(pa.array([0] * len(found), pa.int64()))
        return pa.table({"grp": grp, "token_id": pa.array(range(first, first + len(found)), pa.int32()), "token": pa.array([a + b for a, b in found], pa.binary())})

    same = F.col("grp").eqNullSafe(F.col("own"))
    small = counts.join(F.broadcast(large.withColumnRenamed("grp", "own")), same, "left_anti")
    out = small.groupBy("grp").applyInArrow(one, f"grp {kind}, token_id int, token binary")
    for r in large.collect():
        found, *_ = rounds.train(counts.where(F.col("grp").eqNullSafe(F.lit(r.grp))).select("pretoken", "n"), n)
        rows = docs.sparkSession.createDataFrame([(r.grp, first + i, a + b) for i, (a, b) in enumerate(found)], f"grp {kind}, token_id int, token binary")
        out = out.unionByName(rows)
    groups = docs.select(column(group).alias("grp")).distinct()
    return groups.crossJoin(F.broadcast(base)).select("grp", "token_id", "token").unionByName(out)  # the base vocabulary is 256 rows and the special tokens
