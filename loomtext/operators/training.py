"""BPE training as DataFrame operations: counts, pairs, top pair, merge, vocabulary."""
from __future__ import annotations

import warnings
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import merges as M
from loomtext.sources import files
from loomtext.sources.arrow import by_bytes


#: Distinct pre-tokens that a task counts before it passes them on.
HELD = 500_000


def _counter(specials: list[str]):
    def run(batches):
        find = regex.compile(T.PATTERN).findall
        cut = T.special_splitter(specials)
        held: Counter[str] = Counter()

        def out():
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["pretoken", "n"])

        for b in by_bytes(batches, 0):
            for t in b.column(0).to_pylist():
                if t is None:
                    continue
                for part in cut(t)[::2]:
                    for piece in T.cut(part):
                        held.update(find(piece))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return run


def pretoken_counts(docs: DataFrame, specials: list[str] | None = None, text: str = "text") -> DataFrame:
    """(pretoken, n) over all texts; special tokens are left out.

    A task counts its own pre-tokens while it finds them, so only distinct ones leave it: several times faster than a row per
    pre-token, and what is shuffled follows the words, not the text.
    """
    found = docs.select(text).mapInArrow(_counter(specials or []), "pretoken string, n long")
    return found.groupBy("pretoken").agg(F.sum("n").alias("n"))


def words(counts: DataFrame) -> DataFrame:
    """(word, n): symbol strings of counted pre-tokens."""
    return counts.select(T.symbols(F.col("pretoken")).alias("word"), "n")


def pair_counts(counted: DataFrame) -> DataFrame:
    """(l, r, c): adjacent symbols, weighted by their words' counts."""
    s = counted.select(T.symbol_list(F.col("word")).alias("s"), "n").where(F.size("s") > 1)
    k = F.size("s") - 1
    pairs = s.select(F.explode(F.arrays_zip(F.slice("s", 1, k).alias("l"), F.slice("s", 2, k).alias("r"))).alias("p"), "n")
    return pairs.groupBy("p.l", "p.r").agg(F.sum("n").alias("c"))


def top_pairs(pairs: DataFrame, k: int = 1) -> DataFrame:
    return pairs.orderBy(F.desc("c"), F.desc("l"), F.desc("r")).limit(k)


def merge(counted: DataFrame, left: str, right: str) -> DataFrame:
    return counted.withColumn("word", T.apply_merge(F.col("word"), left, right))


def base_vocabulary(spark: SparkSession, specials: list[str] | None = None) -> DataFrame:
    """(token_id, token): the 256 bytes, then the special tokens. Repeated or one-byte specials raise ValueError."""
    specials = specials or []
    if len(set(specials)) < len(specials) or any(len(s.encode()) < 2 for s in specials):
        raise ValueError("special tokens must differ and have two bytes at least")
    base = spark.range(256).select(F.col("id").cast("int").alias("token_id"), F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("token"))
    if not specials:
        return base
    return base.unionByName(spark.createDataFrame([(256 + i, s.encode()) for i, s in enumerate(specials)], "token_id int, token binary"))


#: Bytes of distinct words that the driver trains on; it takes some 50 times as much memory for them.
MOST_BYTES = 4 << 20
#: Pairs looked at for the merges of one distributed job, and jobs between two times that the words are stored.
LOOK, STORE = 256, 8


def independent(pairs: list[tuple[str, str, int]], known: set[str], complete: bool) -> list[tuple[str, str]]:
    """Of the most frequent pairs (left, right, count), in order, the first ones that are the next merges for sure.

    A pair is, if it shares no symbol with the merges before it, which then leave its count alone, and if no pair that shares one, now or
    once they are made, can come up to its count. A merge whose symbol exists already ends the list, as it may raise other pairs. complete:
    whether the pairs are all there are.
    """
    out: list[tuple[str, str]] = []
    used: set[str] = set()
    for i, (a, b, c) in enumerate(pairs):
        if used & {a, b}:
            break
        if out:
            ties = [p for p in pairs[i + 1 :] if p[2] == c]
            if any(used & {x, y} for x, y, _ in ties) or not complete and pairs[-1][2] == c:
                break
        out.append((a, b))
        used |= {a, b}
        if a + b in known:
            break
        known.add(a + b)
    return out


def train_merges(counts: DataFrame, n: int, strategy: str = "local", most_bytes: int = MOST_BYTES) -> list[tuple[bytes, bytes]]:
    """Up to n merges of counted pre-tokens.

    local: distinct words of up to `most_bytes` bytes are trained on by the driver after Spark has counted them; more stay distributed, and the driver trains on
    bounded extracts of them (rounds.train).
    indexed: words stay distributed in rounds, too; once merges are in few words, jobs look these up in an index and change counts by deltas (indexed.train).
    iterative: words stay distributed; each job counts all pairs and makes all merges that are sure to be next, and the rewritten words are
    stored now and then.
    """
    if strategy not in ("local", "indexed", "iterative"):
        raise ValueError("strategy must be local, indexed or iterative")
    if strategy == "local":
        counts = files.stored(counts, "counts")  # counted once, then read twice
        size = counts.agg(F.sum(F.octet_length("pretoken"))).first()[0] or 0
        if size <= most_bytes:
            got = counts.toArrow()
            return M.train(dict(zip((w.encode() for w in got.column(0).to_pylist()), got.column(1).to_pylist(), strict=True)), n)
        warnings.warn(f"{size} bytes of distinct words: training stays distributed", stacklevel=2)
        from loomtext.operators import rounds

        return rounds.train(counts, n)[0]
    if strategy == "indexed":
        from loomtext.operators import indexed

        return indexed.train(counts, n)[0]
    at, out, known, jobs = files.stored(words(counts), "train"), [], set(), 0
    while len(out) < n:
        top = [tuple(r) for r in top_pairs(pair_counts(at), LOOK).collect()]
        merges = independent(top, known, len(top) < LOOK)[: n - len(out)]
        if not merges:
            break
        for a, b in merges:
            at = merge(at, a, b)
            out.append((bytes.fromhex(a), bytes.fromhex(b)))
        jobs += 1
        if jobs % STORE == 0:
            at = files.stored(at, "train")
    return out


def train_bpe(docs: DataFrame, vocab_size: int, specials: list[str] | None = None, strategy: str = "local", text: str = "text"):
    """(vocabulary id -> bytes, merges). A vocab_size below the base vocabulary warns and gives no merges."""
    specials = specials or []
    vocab = [bytes([i]) for i in range(256)] + [s.encode() for s in specials]
    base_vocabulary(docs.sparkSession, specials)
    n = vocab_size - len(vocab)
    if n < 0:
        warnings.warn("vocab_size is below the 256 bytes and the special tokens", stacklevel=2)
    found = train_merges(pretoken_counts(docs, specials, text), max(0, n), strategy)
    return dict(enumerate(vocab + [a + b for a, b in found])), found


def train_bpe_file(spark: SparkSession, path: str, vocab_size: int, specials: list[str] | None = None, strategy: str = "local"):
    """train_bpe on text files, read in splits that end at a special token."""
    return train_bpe(files.read_corpus(spark, path, specials), vocab_size, specials, strategy)


def main(args: list[str] | None = None) -> None:
    """python -m loomtext.operators.training CORPUS SIZE FOLDER: trains on text files, saves the tokenizer as Parquet and prints the seconds."""
    import argparse
    import time

    p = argparse.ArgumentParser(description="Train a byte-level BPE tokenizer on text files.")
    p.add_argument("corpus", help="a file, folder or pattern that Spark reads")
    p.add_argument("size", type=int, help="entries of the vocabulary")
    p.add_argument("folder", help="where the tokenizer is saved")
    p.add_argument("--special", action="append", default=None, help="a special token; may be repeated (default: %(default)s)")
    p.add_argument("--strategy", choices=("local", "indexed", "iterative"), default="local")
    a = p.parse_args(args)
    spark, began = SparkSession.builder.getOrCreate(), time.perf_counter()
    vocab, merges = train_bpe_file(spark, a.corpus, a.size, a.special or [T.END], a.strategy)
    files.save_tokenizer(spark, a.folder, vocab, merges)
    print(f"{len(vocab)} entries, {len(merges)} merges, {time.perf_counter() - began:.1f} s")


if __name__ == "__main__":
    main()
