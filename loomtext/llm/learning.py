"""Labelled samples and sparse word features shared by the two trained classifiers."""
from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import hashing
from loomtext.llm.common import materialize, remove

#: Words fall in 2**BITS buckets, taken from the high bits of their hash.
BITS = 20


def held_out(doc_id="doc_id"):
    """True for rows that no fit may see: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


#: Texts of a sample have so many bytes together at most: what the driver holds, whatever their number and lengths.
SAMPLE_BYTES = 64 << 20
#: A classifier's sample that texts had to be left out of, for its bytes, needs so many rows at least.
LEAST = 1_000


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, bound: int, most: int = SAMPLE_BYTES, least: int = 10) -> list[tuple]:
    """(doc_id, text, n_chars, label) of up to `bound` labelled documents outside the held-out fold, with texts of up to `most` bytes
    together, in hash order of the id. A text that doesn't fit any more is left out, with a warning, and the sample goes on with the next; if fewer than
    `least` rows, and fewer than there are without the bound, would be left, ValueError is raised.

    Labels other than 0 and 1, null ids and contradicting repeats are left out. Rows that repeat an id are one, that of the smallest text.
    The picked ids number at most `bound`, so broadcasting them is safe at any size; their rows are stored, then sized, then collected.
    """
    spark, by = docs.sparkSession, (F.xxhash64("id"), "id")
    pick = (
        labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .select(F.col("doc_id").alias("id"), F.col(target).alias("y"))
        .groupBy("id")
        .agg(F.min("y").alias("label"), F.max("y").alias("other"))
        .where("label = other")
        .orderBy(*by)
        .limit(bound)
        .select("id", "label")
    )
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    rows = docs.select(F.col("doc_id").alias("id"), F.struct("text", n.alias("n")).alias("row")).join(F.broadcast(pick), "id")
    rows = rows.groupBy("id", "label").agg(F.min("row").alias("row"))
    # (a text over the bound can't fit, so it isn't stored; its size is)
    rows = rows.withColumn("row", F.when(F.octet_length("row.text") > most, F.struct(F.lit(None).cast("string").alias("text"), F.col("row.n").alias("n"), F.octet_length("row.text").alias("over"))).otherwise(F.struct(F.col("row.text").alias("text"), F.col("row.n").alias("n"), F.lit(None).cast("int").alias("over"))))
    rows, path = materialize(rows.select("id", "row.text", "row.n", "label", F.coalesce("row.over", F.octet_length("row.text"), F.lit(0)).cast("long").alias("size")), "sample")
    total, used, sizes = 0, [], rows.orderBy(*by).select("id", "size").collect()
    for r in sizes:
        if total + r["size"] <= most:
            total += r["size"]
            used.append(r.id)
    got = rows.select("id", "text", "n", "label")
    if len(used) < len(sizes):
        said = f"{len(used)} of {len(sizes)} labelled texts, {total} of {sum(r['size'] for r in sizes)} bytes, fit into a sample of {most} bytes"
        if len(used) < min(least, len(sizes)):
            remove(spark, path)
            raise ValueError(said)
        warnings.warn(said, stacklevel=3)
        got = got.join(F.broadcast(spark.createDataFrame([(i,) for i in used], rows.select("id").schema)), "id")
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: r[0])
    remove(spark, path)
    return got


def word_counts(texts: list[str | None], kind: str, keep: np.ndarray | None = None, prefixes: tuple[int, ...] = ()):
    """Distinct buckets of words (and of word beginnings) with counts per text: text index, bucket, count, words
    per text, word lengths, first word of each text.

    keep: a table from bucket to a compact index, -1 for buckets to leave out.
    """
    h, at, size, *cut = hashing.words(texts, kind, prefixes=prefixes)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), n)
    if prefixes:
        h, doc = np.concatenate([h, *(x for _, x in cut[0])]), np.concatenate([doc, *(doc[i] for i, _ in cut[0])])
    bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
    if keep is not None:
        bucket = keep[bucket].astype(np.int64)
        on = bucket >= 0
        bucket, doc = bucket[on], doc[on]
    key, count = np.unique((doc << BITS) | bucket, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count, n, size, at


def active_buckets(rows: list[np.ndarray], least: int) -> np.ndarray:
    """The table for `keep`: buckets that at least `least` of the training texts have."""
    df = np.zeros(1 << BITS, dtype=np.int64)
    for r in rows:
        df[r] += 1
    table = np.full(1 << BITS, -1, dtype=np.int32)
    on = np.flatnonzero(df >= least)
    table[on] = np.arange(len(on), dtype=np.int32)
    return table


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
