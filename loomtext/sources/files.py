"""Readers and writers: corpora, vocabularies, merge lists, token files, checkpoints."""
from __future__ import annotations

import json
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master, else the warehouse folder."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        got = tempfile.mkdtemp(prefix="loomtext-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_loomtext"
        spark.conf.set("spark.checkpoint.dir", got)
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(rows: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """rows written to a scratch folder and read from there: computed once, and not again if an executor is lost."""
    folder = scratch(rows.sparkSession, name)
    rows.write.option("compression", compression).parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of files up to which a table may be dealt out over the cores.
SMALL = 64 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. A small one, of SMALL bytes at most, whose scan has fewer tasks than there are cores, is dealt out over the cores: a small file is
    often a single row group, which one task would read and work on alone. Larger tables are left as they are, however many cores there are."""
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    if size_of(rows) > SMALL or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)


def size_of(rows: DataFrame) -> int:
    """Bytes that the optimiser reckons with; for a table read from files, theirs."""
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def read_documents(spark: SparkSession, path: str, delimiter: str = "<|endoftext|>") -> DataFrame:
    """(document) rows of a text corpus, cut at the delimiter by Spark's splittable reader."""
    return spark.read.text(path, lineSep=delimiter).select(F.col("value").alias("document"))


def read_corpus(spark: SparkSession, path: str, specials: list[str] | None = None) -> DataFrame:
    """(text) rows of a text corpus whose pre-tokens are those of the whole file.

    The reader splits the file at a special token that is in no other one, where no pre-token reaches across, so a large file is
    read by many tasks. Without special tokens there is no such place: each file is one row.
    """
    specials = specials or []
    free = [s for s in specials if not any(s != o and s in o for o in specials)]
    if not free:
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    return spark.read.text(path, lineSep=free[0]).select(F.col("value").alias("text"))


def read_bytes_as_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; bytes that aren't UTF-8 are dropped."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([x.decode("utf-8", "ignore") for x in b.column(1).to_pylist()], pa.string())], names=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")


def byte_unicode() -> dict[int, str]:
    """The printable character of each byte: itself where printable Latin-1, else the next from U+0100."""
    own = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    spare = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(spare)) for b in range(256)}


def byte_unicode_map(spark: SparkSession) -> DataFrame:
    """(byte, symbol, code_point) for the 256 bytes."""
    return spark.createDataFrame([(b, c, ord(c)) for b, c in byte_unicode().items()], "byte int, symbol string, code_point int")


def is_byte_level(vocab_path: str) -> bool:
    """Whether a vocabulary file is a JSON object of tokens in byte-unicode characters -> id; else it is id -> token."""
    with open(vocab_path, encoding="utf-8") as f:
        got = json.load(f)
    return bool(got) and all(isinstance(v, int) for v in got.values())


def read_vocab(path: str) -> dict[int, bytes]:
    """A JSON object: id -> text or list of byte values, or token -> id. Tokens of the second form are in byte-unicode characters; one with
    other characters (a special token, say) stands for its UTF-8 bytes. Others raise ValueError."""
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    if is_byte_level(path):
        back = {c: b for b, c in byte_unicode().items()}
        return {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in got.items()}
    out = {}
    for k, v in got.items():
        if isinstance(v, str):
            out[int(k)] = v.encode()
        elif isinstance(v, list):
            out[int(k)] = bytes(v)
        else:
            raise ValueError(f"token {k}: {type(v).__name__}")
    return out


def read_merges(path: str, byte_level: bool = False) -> list[tuple[bytes, bytes]]:
    """Lines "left right" in rank order; other lines, and a first line that gives a version, are skipped. byte_level: in byte-unicode
    characters."""
    back = {c: b for b, c in byte_unicode().items()}
    part = (lambda t: bytes(back[c] for c in t)) if byte_level else str.encode
    with open(path, encoding="utf-8") as f:
        lines = [line.strip().split() for i, line in enumerate(f) if i or not line.startswith("#version")]
    return [(part(a[0]), part(a[1])) for a in lines if len(a) == 2]


def _opened(path: str):
    """A file of any store that pyarrow reaches, for reading at any place."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    uri = f"file:///{rest.lstrip('/')}" if scheme == "file" else path if "://" in path else f"file://{os.path.abspath(path)}"
    store, at = fs.FileSystem.from_uri(uri)
    return store.open_input_file(at)


def file_chunks(path: str, chunks: int, delimiter: str = "<|endoftext|>", block: int = 1 << 16) -> list[int]:
    """Sorted distinct byte offsets that cut a file into up to `chunks` parts: each cut is the first delimiter that begins at or after a uniform
    guess, or the end. From each guess on the file is read in blocks, only as far as that delimiter."""
    sought = delimiter.encode()
    with _opened(path) as f:
        size = f.size()
        out = {0, size}
        for i in range(1, chunks):
            at, held = i * (size // chunks), b""
            while True:
                f.seek(at + len(held))
                more = f.read(block)
                held += more
                if (found := held.find(sought)) >= 0 or not more:
                    out.add(at + found if found >= 0 else size)
                    break
                cut = max(0, len(held) - len(sought) + 1)  # a delimiter may begin in the last bytes
                at, held = at + cut, held[cut:]
    return sorted(out)


def read_chunks(spark: SparkSession, path: str, offsets: list[int]) -> DataFrame:
    """(chunk, start, end, text) for each part of a file, read where it is used; bytes that aren't UTF-8 are dropped."""

    def run(batches):
        for b in batches:
            for chunk, start, end in zip(*(b.column(c).to_pylist() for c in ("chunk", "start", "end")), strict=True):
                with _opened(path) as f:
                    f.seek(start)
                    text = f.read(end - start).decode("utf-8", "ignore")
                yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([start]), pa.array([end]), pa.array([text])], names=["chunk", "start", "end", "text"])

    parts = [(i, a, b) for i, (a, b) in enumerate(zip(offsets, offsets[1:]))]
    rows = spark.createDataFrame(parts, "chunk int, start long, end long").repartition(max(1, len(parts)), "chunk")
    return rows.mapInArrow(run, "chunk int, start long, end long, text string")


def save_tokenizer(spark: SparkSession, path: str, vocab: dict[int, bytes], merges: list[tuple[bytes, bytes]]) -> None:
    """Parquet tables below path, without loss."""
    spark.createDataFrame(sorted(vocab.items()), "token_id int, token binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, l binary, r binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")


def load_tokenizer(spark: SparkSession, path: str) -> tuple[dict[int, bytes], list[tuple[bytes, bytes]]]:
    vocab = {r[0]: bytes(r[1]) for r in spark.read.parquet(f"{path}/vocab").collect()}
    return vocab, [(bytes(r[1]), bytes(r[2])) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]


def write_token_stream(stream: DataFrame, path: str, most: int = 1 << 16) -> None:
    """(pos, token_id) in stream order; an id of `most` or more raises."""
    bad = F.raise_error(F.lit("token id out of range"))
    checked = stream.select("pos", F.when((F.col("token_id") >= 0) & (F.col("token_id") < most), F.col("token_id")).otherwise(bad).cast("int").alias("token_id"))
    checked.repartitionByRange("pos").sortWithinPartitions("pos").write.mode("overwrite").parquet(path)


def save_checkpoint(path: str, weights: DataFrame, moments: DataFrame, iteration: int) -> None:
    """weights (name, shape, data), optimizer state rows of any schema, and the iteration."""
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    moments.write.mode("overwrite").parquet(f"{path}/moments")
    weights.sparkSession.createDataFrame([(iteration,)], "iteration int").write.mode("overwrite").parquet(f"{path}/meta")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    return spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/moments"), spark.read.parquet(f"{path}/meta").first()[0]
