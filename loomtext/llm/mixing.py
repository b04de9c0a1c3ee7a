"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share `share` times all words;
a target stops at `most` times its source's words and the excess goes to the others by weight until none is
above. That is water-filling: with sources ordered by cap / weight, the level is the first
(rest of the total) / (rest of the weights) not above the source's own cap / weight.

Sampling: each document of a source expects rate = target / source size copies. In the order of size, then
id, the expected copies are summed up; one random offset is added, and a document is emitted once per integer
that its sum crosses. Ordering by size keeps the words taken within one longest document of the target.

The sum over a source is taken in two levels, so a hot source isn't one task: rows are range-partitioned by
(source, size, id), their position in the partition is written with them, and a small table of (source,
partition) counts gives each partition its start.

Edge cases: null or empty text has size 0, weight in no target, and is emitted as its rate says; a source without
words has target 0 and rate 0; null sources form one source, the last; repeated rows are rows of their own;
reruns agree, ties of (size, id) being rows that can be exchanged; an empty table gives an empty result; other columns, of any
name and type, go with their rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import materialize, whole_row

WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2.0, 20_240_601


def word_count(text: str = "text") -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def offset(seed: int = SEED) -> float:
    """The one random offset, in [0, 1): a fixed integer hash of the seed."""
    x = (seed * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 31
    x = x * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    return (x >> 32 & 0xFFFFF) / 0x100000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (source, source_size), one row per source: with its weight and target. The windows run over sources,
    which are pre-aggregated."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", w.cast("double")).withColumn("_cap", F.lit(most) * F.col("source_size"))
    by = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    everything = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("_level", left / rest).withColumn("_own", F.col("_cap") / F.col("weight"))
    level = F.min(F.when(F.col("_own") >= F.col("_level"), F.struct("_own", "_rank", "_level"))).over(everything)["_level"]
    target = F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("weight")))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def allot(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, text: str = "text", keep_columns: bool = False) -> DataFrame:
    """row, size, source_size, target, copies for every row of docs; row: a struct of doc_id alone, or with keep_columns of all own columns,
    so none can clash with those made here."""
    row = whole_row(docs) if keep_columns else F.struct("doc_id")
    rows = docs.select(row.alias("row"), word_count(text).alias("size"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("key"))
    rows = rows.withColumn("id", F.col("row.doc_id")).withColumn("tie", F.monotonically_increasing_id())
    order = ["no_source", "key", "size", "id", "tie"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.spark_partition_id()).drop("id", "tie")
    rows, _ = materialize(rows, "mix")
    blocks = rows.groupBy("no_source", "key", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("size").alias("words"))
    blocks, _ = materialize(blocks, "mix-blocks")  # sources + partitions rows at most
    before = Window.partitionBy("no_source", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sizes = blocks.groupBy("no_source", "key").agg(F.sum("words").alias("source_size"))
    sizes = sizes.select(F.when(~F.col("no_source"), F.col("key")).alias("source"), "source_size")
    t = targets(sizes, weights, share, most).select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("key"), "source_size", "target")
    plan = blocks.join(t, ["no_source", "key"]).select("no_source", "key", "block", "first", "before", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("at") - F.col("first") + F.col("before")
    u = F.lit(offset(seed))
    copies = (F.floor((rank + 1) * rate + u) - F.floor(rank * rate + u)).cast("long")
    return rows.join(plan, ["no_source", "key", "block"]).select("row", "size", "source_size", "target", copies.alias("copies"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes from the row, repeats counted)."""
    return allot(docs, **options).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: rows of docs, each as often as it is emitted, in docs' columns, whatever their names."""
    got = allot(docs, keep_columns=True, **options).where("copies > 0")
    return got.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


#: The same result in DuckDB SQL, for the default weights, share, cap and seed.
MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, (CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight, {MOST}::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, cap / weight AS own,
  ({SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
v AS (SELECT level FROM l WHERE own >= level ORDER BY own, k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM v) = 0 THEN cap ELSE least(cap, (SELECT level FROM v) * weight) END AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor((n + 1) * rate + {offset()}::DOUBLE) - floor(n * rate + {offset()}::DOUBLE)))::BIGINT AS taken FROM p
"""
