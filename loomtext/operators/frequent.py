"""The most frequent pre-tokens without a shuffle of the vocabulary: mergeable summaries, then an exact recount of the few that can be meant.

A task counts in a table of `size` entries at most. When it is full, the count of its middle entry is taken from all, and those at 0 go: a Misra-Gries
summary, whose counts are too low by the sum of what was taken, at most. Summaries add up, and so do their errors. With L the k-th largest sum and E
the errors' sum, a pre-token whose sum and E are below L together can't be among the k most frequent. The others, if that rules out the ones
that no summary has (E < L) and leaves few enough to broadcast, are counted exactly in a second pass. If it doesn't, the tables are made larger, up to
where nothing is taken; so the result is exact at every size. What is shuffled is bounded by tasks and table size, whatever the vocabulary.
"""
from __future__ import annotations

from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.sources import files
from loomtext.sources.arrow import by_bytes

SIZE, CANDIDATES = 1 << 16, 100_000


def shrink(held: Counter, size: int) -> int:
    """Take the count of the entry in the middle of `size` from all; those left over 0 stay. Returns what was taken."""
    least = sorted(held.values(), reverse=True)[size // 2]
    for key in [key for key, n in held.items() if n <= least]:
        del held[key]
    for key in held:
        held[key] -= least
    return least


def _counted(specials: list[str], size: int | None, only: frozenset | None):
    """(pretoken, n) of a task's texts, and (null, what has been taken) for a summary. only: pre-tokens to count exactly."""

    def run(batches):
        find = regex.compile(T.PATTERN).findall
        cut = T.special_splitter(specials)
        held: Counter[str] = Counter()
        taken = 0
        for b in by_bytes(batches, 0):
            for t in b.column(0).to_pylist():
                for part in cut(t)[::2] if t is not None else ():
                    for piece in T.cut(part):
                        found = find(piece)
                        held.update(found if only is None else filter(only.__contains__, found))
                        if size and len(held) > size:
                            taken += shrink(held, size)
        rows = [*held.items(), *([(None, taken)] if size else [])]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["pretoken", "n"])

    return run


def top_pretokens(docs: DataFrame, k: int, specials: list[str] | None = None, text: str = "text", size: int = SIZE) -> DataFrame:
    """(pretoken, n): the k most frequent pre-tokens of all texts, of equal ones those last in byte order, with their exact counts."""
    specials = specials or []

    def summed(size: int | None, only: frozenset | None = None) -> DataFrame:
        return docs.select(text).mapInArrow(_counted(specials, size, only), "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))

    order = (F.desc("n"), F.desc("pretoken"))
    while True:
        sums = files.stored(summed(size), "summaries")
        error = sums.where("pretoken is null").agg(F.sum("n")).first()[0] or 0
        sums = sums.where("pretoken is not null")
        if not error:  # nothing was taken: the sums are the counts
            return sums.orderBy(*order).limit(k)
        top = sums.orderBy(F.desc("n")).limit(k).collect()
        least = top[-1].n if len(top) == k else 0
        if error < least:
            meant = sums.where(F.col("n") + error >= least).select("pretoken").limit(CANDIDATES + 1).collect()
            if len(meant) <= CANDIDATES:
                only = frozenset(r.pretoken for r in meant)
                return summed(None, only).orderBy(*order).limit(k)
        size *= 8
