"""BPE training that stays distributed: an inverted index from pairs to words, and pair counts changed by signed deltas.

The first merges are in most words, so rounds count all pairs and rewrite all words (rounds.train). Once the next merges are in few words, tables take over:

* words (wid, n, word), and index (l, r, wid), for every pair in a word, each in buckets, that is partition folders;
* counts (l, r, c).

A job takes the most frequent pairs, TOGETHER or with their ties a few more, reads their index buckets, then those buckets of words that hold a word found, by dynamic
partition pruning. An extract of these words gives the merges that are sure to be next (rounds), of new pairs too, and the words that hold them are rewritten. It appends one log: the words' new forms, index entries of pairs
that a word hasn't had, and the words' old and new pairs with their counts, negative and positive. A pair's count is the sum over the counts and the
logs; an index entry whose word has lost the pair since is harmless, as words are looked at. When the logs hold half as many words as the tables,
these are written anew, so that costs no more than in proportion to the words rewritten. A job so costs what its pairs' words cost, not what all do.

Every table is written in the shared folder before anything builds on it, and the driver holds the merges, LOOK pairs and an extract of rounds.MOST symbols.
"""
from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import rounds, training
from loomtext.sources import files

#: The share of all words that a job's merges may be in for the tables to take over, and the share of the words in logs at which they are written anew.
FEW, LOGGED = 0.005, 0.5
#: Pairs whose words a job looks up, and merges that it makes at most.
TOGETHER = 64
_LOG = "job int, kind string, wid long, bucket int, n long, word string, l string, r string, c long"


def pairs_of(word: Column) -> Column:
    """Array of the neighbours (l, r) in a word's symbol string."""
    s = T.symbol_list(word)
    k = F.greatest(F.size(s) - 1, F.lit(0))
    return F.arrays_zip(F.slice(s, 1, k).alias("l"), F.slice(s, 2, k).alias("r"))


def merged(word: Column, merges: list[tuple[str, str]]) -> Column:
    for a, b in merges:
        word = T.apply_merge(word, a, b)
    return word


class Tables:
    """Words, index and counts with their logs. jobs: of each job, its merges and how many words it rewrote."""

    def __init__(self, words: DataFrame, buckets: int):
        self.spark, self.buckets = words.sparkSession, buckets
        self.jobs: list[tuple[list, int]] = []
        self._write(words)

    def _bucket(self, *of: str) -> Column:
        return F.pmod(F.xxhash64(*of), F.lit(self.buckets)).cast("int")

    def _write(self, words: DataFrame) -> None:
        """Tables of words (wid, n, word), without logs."""
        words = words.withColumn("bucket", self._bucket("wid"))
        self.words = self._table(words.repartition(self.buckets, "bucket"), "words", "bucket")
        pairs = self.words.select("wid", "bucket", "n", F.explode(pairs_of(F.col("word"))).alias("p")).select("wid", "bucket", "n", "p.l", "p.r")
        index = pairs.select("wid", "bucket", "l", "r").distinct().withColumn("pair", self._bucket("l", "r"))
        self.index = self._table(index.repartition(self.buckets, "pair"), "index", "pair")
        self.counts = files.stored(pairs.groupBy("l", "r").agg(F.sum("n").alias("c")), "counts")
        self.size, self.logged, self.logs, self.log = self.words.count(), 0, files.scratch(self.spark, "logs"), None

    def _table(self, rows: DataFrame, name: str, by: str) -> DataFrame:
        folder = files.scratch(self.spark, name)
        rows.write.partitionBy(by).parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def _log(self, kind: str) -> DataFrame:
        """Rows of one kind of all logs, which are sorted by it and then by pairs; a folder for each job."""
        if self.log is None:
            self.log = self.spark.read.schema(_LOG).parquet(self.logs) if self.logged else self.spark.createDataFrame([], _LOG)
        return self.log.where(F.col("kind") == kind)

    def top(self, k: int) -> list[tuple[str, str, int]]:
        """The k most frequent pairs in the order of merges."""
        now = self.counts.unionByName(self._log("count").select("l", "r", "c")).groupBy("l", "r").agg(F.sum("c").alias("c")).where("c > 0")
        return [tuple(r) for r in training.top_pairs(now, k).collect()]

    def holders(self, merges: list[tuple[str, str]]) -> DataFrame:
        """(wid, bucket) of words that hold one of the pairs, or have held it."""
        wanted = functools.reduce(operator.or_, ((F.col("l") == a) & (F.col("r") == b) for a, b in merges))
        buckets = functools.reduce(operator.or_, (F.col("pair") == F.pmod(F.xxhash64(F.lit(a), F.lit(b)), F.lit(self.buckets)).cast("int") for a, b in merges))
        found = self.index.where(buckets & wanted).select("wid", "bucket")
        return found.unionByName(self._log("index").where(wanted).select("wid", "bucket")) if self.logged else found

    def current(self, held: DataFrame | None = None) -> DataFrame:
        """(wid, n, word) in the newest form, of the words in `held` or of all."""
        base, new = self.words.select("wid", "bucket", "n", "word", F.lit(-1).alias("job")), self._log("word").select("wid", "bucket", "n", "word", "job")
        if held is not None:
            base, new = base.join(held, ["bucket", "wid"], "left_semi"), new.join(held, ["bucket", "wid"], "left_semi")
        if not self.logged:
            return base.select("wid", "n", "word")
        return base.unionByName(new).groupBy("wid").agg(F.max_by(F.struct("n", "word"), "job").alias("w")).select("wid", "w.n", "w.word")

    def next(self, n: int, names: list[bytes]) -> tuple[list[tuple[str, str]], DataFrame | None]:
        """Up to n merges that are sure to be next, and the words that may hold them. names: all symbols so far."""
        top = self.top(training.LOOK + 1)
        if not top or len(top) > training.LOOK and top[0][2] == top[-1][2]:
            return [t[:2] for t in top[:1]], None
        number = {s.hex().upper(): i for i, s in enumerate(names)}
        code, c = np.array([number[a] << 32 | number[b] for a, b, _ in top], np.int64), np.array([t[2] for t in top], np.int64)
        sought = [t[:2] for t in top if t[2] >= c[: TOGETHER][-1]]
        held = files.stored(self.current(self.holders(sought)), "held")
        got, _ = rounds._round(_numbered(held, number), None, code, c, names, min(n, TOGETHER), rounds.MOST, training.LOOK, TOGETHER)
        return [(a.hex().upper(), b.hex().upper()) for a, b in got], held

    def merge(self, merges: list[tuple[str, str]], held: DataFrame | None = None) -> int:
        """Make merges, which are sure to be next; the number of words rewritten. held: words (wid, n, word) that hold them, if known."""
        rows = (self.current(self.holders(merges)) if held is None else held).withColumn("new", merged(F.col("word"), merges)).where("new <> word")
        seen = Observation()
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
        spelled = lambda word: F.transform(pairs_of(word), lambda p: F.concat(p["l"], F.lit(" "), p["r"]))  # noqa: E731  strings are compared by hash
        old, new, none = spelled(F.col("word")), spelled(F.col("new")), lambda t: F.lit(None).cast(t)
        entry = lambda kind, **of: F.struct(F.lit(kind).alias("kind"), *(of.get(c, none(t)).cast(t).alias(c) for c, t in (("n", "long"), ("word", "string"), ("l", "string"), ("r", "string"), ("c", "long"))))
        rows = rows.select("wid", "n", "new", old.alias("old"), new.alias("are"))
        rows = rows.withColumns({"come": F.array_except("are", "old"), "gone": F.array_except("old", "are")})
        parts = lambda p: {"l": F.substring_index(p, " ", 1), "r": F.substring_index(p, " ", -1)}
        once = lambda x: F.size(F.array_distinct(x)) == F.size(x)
        rows = rows.withColumn("once", once("old") & once("are"))  # then what comes and goes says it all; else both forms are counted in full
        entries = F.concat(
            F.array(entry("word", n=F.col("n"), word=F.col("new"))), F.transform("come", lambda p: entry("index", **parts(p))),
            F.transform(F.when(F.col("once"), F.col("gone")).otherwise(F.col("old")), lambda p: entry("count", **parts(p), c=-F.col("n"))),
            F.transform(F.when(F.col("once"), F.col("come")).otherwise(F.col("are")), lambda p: entry("count", **parts(p), c=F.col("n"))),
        )
        log = rows.select("wid", self._bucket("wid").alias("bucket"), F.explode(entries).alias("e")).select("wid", "bucket", "e.*")
        log.sortWithinPartitions("kind", "l", "r").write.parquet(f"{self.logs}/job={len(self.jobs)}")
        changed, self.log = seen.get["n"], None
        self.jobs.append((merges, changed))
        self.logged += changed
        if self.logged > LOGGED * self.size:
            self._write(files.stored(self.current(), "words"))
        return changed


def _numbered(words: DataFrame, number: dict[str, int]) -> DataFrame:
    """(word, n): symbol strings as rounds has words."""
    shared = words.sparkSession.sparkContext.broadcast(number)  # bounded by the vocabulary

    def run(batches):
        for b in batches:
            parts = [[shared.value[x] for x in w[1:-1].split("><")] for w in b.column(0).to_pylist()]
            flat = np.fromiter((i for p in parts for i in p), np.int32)
            yield rounds._words(flat, np.array([len(p) for p in parts], np.int64), b.column(1).to_numpy())

    return words.select("word", "n").mapInArrow(run, "word binary, n long")


def _spelled(words: DataFrame, names: list[bytes]) -> DataFrame:
    """(word, n): words of rounds as symbol strings."""
    shared = words.sparkSession.sparkContext.broadcast([f"<{s.hex().upper()}>" for s in names])  # bounded by the vocabulary

    def run(batches):
        for b in batches:
            got = ["".join(map(shared.value.__getitem__, np.frombuffer(w, "<i4").tolist())) for w in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array(got, pa.string()), b.column(1)], names=["word", "n"])

    return words.mapInArrow(run, "word string, n long")


def train(counts: DataFrame, n: int, few: float = FEW, buckets: int | None = None) -> tuple[list[tuple[bytes, bytes]], list[tuple[list, int]]]:
    """Up to n merges of counted pre-tokens, and the jobs on tables: their merges and the words that each rewrote."""
    spark = counts.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = files.stored(counts, "counts")  # counted once, then read twice
    size = counts.count()
    out, _, words, names = rounds.train(counts, n, enough=lambda places: places <= few * size)
    if len(out) == n or not size:
        return out, []
    tables = Tables(files.stored(_spelled(words.rows, names).withColumn("wid", F.monotonically_increasing_id()).select("wid", "n", "word"), "train"), buckets)
    while len(out) < n:
        merges, held = tables.next(n - len(out), names)
        if not merges:
            break
        tables.merge(merges, held)
        out += [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in merges]
        known = set(names)
        names = names + [bytes.fromhex(a + b) for a, b in merges if bytes.fromhex(a + b) not in known]
    return out, tables.jobs
