"""Corpus operators: documents of a text, samples, statistics, token streams, chunk boundaries."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import columns
from loomtext.functions import text as T
from loomtext.operators.tokenizer import Tokenizer
from loomtext.sources import files, token_files
from loomtext.sources.arrow import by_bytes


def split_documents(corpus: DataFrame, text: str = "text", delimiter: str = T.END, key: str = "corpus_id") -> DataFrame:
    """(key, pos, document): parts between delimiters, stripped, blank ones dropped."""
    parts = corpus.select(key, F.posexplode(F.split(F.col(text), "\\Q" + delimiter + "\\E")).alias("pos", "document"))
    return parts.withColumn("document", T.strip(F.col("document"))).where("document <> ''")


def split_at_specials(docs: DataFrame, specials: list[str], key: str = "doc_id", text: str = "text", many: int | None = None) -> DataFrame:
    """(key, pos, segment, special): the segments of each text, empty ones dropped, by special_splitter, so for any number of special tokens."""
    schema = f"key {dict(docs.dtypes)[key]}, pos long, segment string, special boolean"

    def run(batches):
        split = T.special_splitter(specials, many)
        for b in by_bytes(batches, 1):
            keys, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = [(p, bool(j % 2)) for j, p in enumerate(split(t)) if p] if t else []
                keys += [i] * len(found)
                rows += [(pos, *x) for pos, x in enumerate(found)]
            cols = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), *cols], names=["key", "pos", "segment", "special"])

    return docs.select(columns.column(key).alias("key"), columns.column(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def sample_documents(docs: DataFrame, n: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """n documents in the order of a hash of seed and key: the same for any partitioning. A limit is this operator's purpose."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return docs.orderBy(order, key).limit(n)


def compression_ratio(sizes: DataFrame, *by: str) -> DataFrame:
    """Pooled bytes per token of (n_bytes, n_tokens) rows; 0 without tokens. Rows with null n_tokens, of texts that can't be tokenized, are
    left out."""
    sizes = sizes.where("n_tokens is not null")
    ratio = F.coalesce(F.try_divide(F.sum("n_bytes"), F.sum("n_tokens")), F.lit(0.0))
    return sizes.groupBy(*by).agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.round(ratio, 6).alias("ratio"))


def longest_token(vocab: DataFrame) -> DataFrame:
    """The longest token in bytes, of equal ones that with the smallest id."""
    return vocab.select("token_id", F.hex("token").alias("token"), F.octet_length("token").alias("n_bytes")).orderBy(F.desc("n_bytes"), "token_id").limit(1)


def stream_offsets(sizes: DataFrame, key: str = "doc_id", n: str = "n_tokens", blocks: int | None = None) -> DataFrame:
    """sizes with `start`, the position of a document's first token in the stream ordered by key (null first). Columns may have any names; one
    called `start` is replaced.

    Two levels: sizes are stored, so whatever computes them runs once, then range-partitioned by key into `blocks` (by default
    spark.sql.shuffle.partitions), which follow the keys' distribution, and stored again, so that all reads see the same blocks.
    The blocks' totals, one row each, are summed up and joined to running sums inside the blocks: no task takes all rows.
    """
    spark = sizes.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = files.stored(sizes.select(columns.whole_row(sizes).alias("row"), columns.column(key).alias("key"), columns.column(n).alias("n")), "sizes")
    dealt = files.stored(held.repartitionByRange(blocks, "key").withColumn("block", F.spark_partition_id()), "blocks")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = dealt.groupBy("block").agg(F.sum("n").alias("sum")).select("block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("head"))  # a row for each block
    ties = F.xxhash64(*(F.col("row").getField(c) for c in sizes.columns if c != key))  # rows equal in all columns can be exchanged
    inside = Window.partitionBy("block").orderBy("key", ties).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(heads), "block")
    return columns.unpacked(dealt, [c for c in sizes.columns if c != "start"], start=F.col("head") + F.col("in"))


def encode_dataset(docs: DataFrame, tokenizer: Tokenizer, path: str, key: str = "doc_id", text: str = "text", most: int = 1 << 16, unknown: str = "raise") -> int:
    """Encode all texts and write their tokens below `path` as one stream (pos, token_id), in order of the key. Returns the number of tokens.

    As in encode_files one exchange deals the texts out by ranges of the key, and they are encoded behind it, once. Their packed ids are stored with their places in
    the range; ranges' places follow from their sizes, a row each. Packed ids, not single tokens, are dealt to the writers, by their place, so each file holds a
    run of the stream. Positions are written as differences. An id of `most` or more raises.
    """
    spark, width = docs.sparkSession, 2 if max(tokenizer.vocab, default=0) < 1 << 16 else 4
    packed = tokenizer.encode_packed(_in_order(docs, key, text), "key", "text", unknown, width)

    def place(batches):
        part, upto = TaskContext.get().partitionId(), 0
        for b in batches:
            n = pc.fill_null(pc.binary_length(b.column("ids")), 0).to_numpy().astype(np.int64) // width
            start = upto + np.cumsum(n) - n
            upto += int(n.sum())
            got = pa.record_batch([pa.array(np.full(len(n), part, np.int32)), pa.array(start), pa.array(n), b.column("ids")], names=["block", "start", "n", "ids"])
            yield got.filter(pa.array(n > 0))

    def single(batches):
        for b in by_bytes(batches, 1):
            ids = [np.frombuffer(x.as_buffer(), f"<u{width}") for x in b.column(1)]
            n = np.array([len(x) for x in ids], np.int64)
            token, first = np.concatenate(ids).astype(np.int64), np.cumsum(n) - n
            if token.max() >= most:
                raise ValueError("token id out of range")
            pos = np.repeat(b.column(0).to_numpy() - first, n) + np.arange(len(token))
            for i in range(0, len(token), 1 << 17):
                yield pa.record_batch([pa.array(pos[i : i + (1 << 17)]), pa.array(token[i : i + (1 << 17)].astype(np.int32))], names=["pos", "token_id"])

    held = files.stored(packed.mapInArrow(place, "block int, start long, n long, ids binary"), "packed", "zstd")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = held.groupBy("block").agg(F.sum("n").alias("sum")).select("block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("head"))  # a row for each block
    rows = held.join(F.broadcast(heads), "block").select((F.col("head") + F.col("start")).alias("start"), "ids")
    rows = rows.repartitionByRange("start").sortWithinPartitions("start").mapInArrow(single, "pos long, token_id int")
    out = rows.write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "v2").option("parquet.enable.dictionary#pos", "false")
    out.parquet(path)
    return spark.read.schema(rows.schema).parquet(path).count()


def stream_blocks(stream: DataFrame, size: int) -> DataFrame:
    """(block, n_tokens, digest) of a stream (pos, token_id) in blocks of `size` positions; digest: the MD5 of the ids in order, joined by commas.

    A task takes runs of positions as they come; it digests blocks that it has whole, and only the parts of others, ids and all, are brought together.
    """

    def run(batches):
        held, first = [], 0  # a run that isn't done, and its first position

        def rows(ids: np.ndarray, last: bool):
            out, at = [], 0
            while at < len(ids) and (last or len(ids) - at >= size - (first + at) % size):
                n = min(size - (first + at) % size, len(ids) - at)
                part = ids[at : at + n].tolist()
                out.append(((first + at) // size, first + at, n, hashlib.md5(",".join(map(str, part)).encode()).hexdigest() if n == size else None, None if n == size else part))
                at += n
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            return at, pa.record_batch(cols, names=["block", "start", "n", "digest", "ids"])

        for b in batches:
            pos, token = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pos) != 1) + 1).tolist(), len(pos)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if held and pos[i] != first + sum(map(len, held)):
                    yield rows(np.concatenate(held), True)[1]
                    held = []
                if not held:
                    first = int(pos[i])
                held.append(token[i:j])
                ids = np.concatenate(held)
                at, got = rows(ids, False)
                first, held = first + at, [ids[at:]] if at < len(ids) else []
                yield got
        if held:
            yield rows(np.concatenate(held), True)[1]

    parts = stream.select("pos", "token_id").mapInArrow(run, "block long, start long, n long, digest string, ids array<int>")
    got = parts.groupBy("block").agg(F.sum("n").alias("n_tokens"), F.max("digest").alias("whole"), F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("t"))
    ids = F.flatten(F.transform("t", lambda r: F.transform(r["ids"], lambda x: x.cast("string"))))
    return got.select("block", "n_tokens", F.coalesce("whole", F.md5(F.array_join(ids, ","))).alias("digest"))


def _in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) of texts that aren't empty, dealt out by ranges of the key, equal keys by a hash of the text, and sorted in them."""
    order = ("key", F.xxhash64("text"))
    rows = docs.select(columns.column(key).alias("key"), columns.column(text).alias("text")).where("text <> ''")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def encode_files(docs: DataFrame, tokenizer: Tokenizer, path: str, key: str = "doc_id", text: str = "text", unknown: str = "raise") -> int:
    """encode_dataset into flat files (token_files): 16 bits a token if the vocabulary's ids fit, else 32. Returns the number of tokens.

    One exchange deals the texts out by ranges of the key, equal keys by a hash of the text, and the tasks behind it encode them, so ids are neither
    stored nor shuffled. A task's range is a run of the stream, whose place follows from the other tasks' sizes when all have written.
    """
    width = 2 if max(tokenizer.vocab, default=0) < 1 << 16 else 4
    return token_files.write_ordered(tokenizer.encode_packed(_in_order(docs, key, text), "key", "text", unknown, width).withColumnRenamed("ids", "packed"), path, width)


#: Neighbours that a prefix sum takes at once.
SEGMENT = 4_096


def prefix_sums(rows: DataFrame, group: str, place: str, value: str, segment: int = SEGMENT) -> DataFrame:
    """(group, place, value, upto): the sums of `value` over the places of a group up to each row, which are whole numbers from 0, each once.

    Two levels: sums by segments of neighbouring places, a running sum over these, and one inside each. So a group of any size is dealt over
    tasks; a task has a segment, or one row for each segment of a group.
    """
    rows = rows.select(columns.column(group).alias("g"), columns.column(place).cast("long").alias("p"), columns.column(value).cast("long").alias("v"))
    rows = files.stored(rows.withColumn("s", F.floor(F.col("p") / segment)), "parts")  # summed up, then read again
    before = Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("g", "s").agg(F.sum("v").alias("sum")).select("g", "s", F.sum("sum").over(before).alias("head")).where("head <> 0")
    inside = Window.partitionBy("g", "s").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("in", F.sum("v").over(inside)).join(heads, ["g", "s"], "left")
    return out.select(F.col("g").alias(group), F.col("p").alias(place), F.col("v").alias(value), (F.col("in") + F.coalesce("head", F.lit(0).cast("long"))).alias("upto"))


def table_chunks(docs: DataFrame, chunks: int, delimiter: str = T.END, key: str = "doc_id", text: str = "text") -> list[int]:
    """chunk_boundaries of all texts in order of the key, joined by the delimiter, without joining them.

    Each text's place comes from the lengths (stream_offsets), each delimiter's from its text's place and a prefix sum over the parts
    before it (prefix_sums), and the cuts are `chunks` minima over them in one aggregate, so no task holds more than a text, and the
    work is in proportion to the delimiters. Null texts are left out.
    """
    d, lengths = len(delimiter), F.transform(F.split(columns.column(text), "\\Q" + delimiter + "\\E", -1), F.length)
    rows = docs.where(columns.column(text).isNotNull()).select(columns.column(key).alias("key"), lengths.alias("lengths"), (F.length(columns.column(text)) + d).cast("long").alias("n"))
    placed = files.stored(stream_offsets(rows, "key", "n"), "places")
    size = (placed.agg(F.max(F.col("start") + F.col("n"))).first()[0] or d) - d
    parts = placed.select("start", F.posexplode("lengths").alias("i", "length"))  # no two texts have one start, for each has a length
    at = prefix_sums(parts, "start", "i", "length").select((F.col("start") + F.col("upto") + F.col("i") * d).alias("at"))  # a text's last one is its end
    guesses = [i * (size // chunks) for i in range(1, chunks)]
    cuts = at.agg(*(F.min(F.when(F.col("at") >= g, F.col("at"))) for g in guesses)).first() if guesses else ()
    return sorted({0, size, *(size if c is None else c for c in cuts)})


def chunk_boundaries(corpus: Column, chunks: int, delimiter: str = T.END) -> Column:
    """Sorted distinct character offsets that cut a text into up to `chunks` parts, each cut at the first delimiter not
    before a uniform guess, or at the end."""
    size = F.length(corpus)
    guess = F.transform(F.sequence(F.lit(1), F.lit(max(1, chunks - 1))), lambda i: F.floor(i * F.floor(size / chunks)).cast("int"))
    found = F.transform(guess, lambda g: F.call_function("locate", F.lit(delimiter), corpus, g + 1))
    cuts = F.zip_with(found, guess, lambda p, g: F.when(p == 0, size).otherwise(p - 1))
    inner = cuts if chunks > 1 else F.array().cast("array<int>")
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), inner, F.array(size))))
