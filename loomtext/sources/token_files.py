"""Token streams as flat binary files: a Spark data sink with two-phase commit, and readers by arithmetic.

A stream is a folder of files of little-endian unsigned integers, 16 or 32 bits each, and a manifest that says which positions each holds; a
file without an entry is not part of it. Tasks write files under names of their own and report them; the driver's commit checks that together they
hold every position once, removes the files of attempts that failed, and writes the manifest last. An abort removes what was written.

spark.dataSource.register(TokenSink), then rows (start, ids), the ids of a text and the position of its first one, in order within each task:
rows.write.format("loomtext_tokens").option("width", 2).mode("append").save(path). write_stream does all of it. Rows (packed), ids as pack gives them, are
placed one after another in order of the partitions; the commit then works out the places. write_ordered does all of that.
"""
from __future__ import annotations

import bisect
import functools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from loomtext.sources.corpus_source import located

MANIFEST = "manifest.json"
#: Bytes that a writer holds before it writes them.
BUFFER = 4 << 20


def pack(ids: list[int], width: int) -> bytes:
    """ids as little-endian unsigned integers of `width` bytes."""
    return np.array(ids, np.int64).astype(f"<u{width}").tobytes()


@dataclass
class _Written(WriterCommitMessage):
    """Files of a task: (name, first position, tokens). part: the partition, if its files go after those of the partitions before it."""

    files: list = field(default_factory=list)
    part: int | None = None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int, packed: bool = False):
        if width not in (2, 4):
            raise ValueError("width must be 2 or 4 bytes")
        self.path, self.width, self.packed, self.job = path, width, packed, uuid.uuid4().hex
        store, at = located(path)
        store.create_dir(at, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self._write_packed(batches) if self.packed else self._write_placed(batches)

    def _write_packed(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = located(self.path)
        part = TaskContext.get().partitionId()
        name, out, size = f"tokens-{self.job}-{uuid.uuid4().hex}.bin", None, 0
        try:
            for b in batches:
                for x in b.column("packed"):
                    if not x.is_valid or not len(got := x.as_buffer()):
                        continue
                    if len(got) % self.width:
                        raise ValueError(f"ids aren't of {self.width} bytes each")
                    out = out or store.open_output_stream(f"{root}/{name}", buffer_size=BUFFER)
                    out.write(got)
                    size += len(got)
            if out is None:
                return _Written(part=part)
            out.close()
        except BaseException:
            if out is not None:
                out.close()
                _remove(store, f"{root}/{name}")
            raise
        return _Written([(name, 0, size // self.width)], part)

    def _write_placed(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = located(self.path)
        done: list[tuple[str, int, int]] = []
        out = name = None
        first = after = 0
        try:
            for b in batches:
                for start, ids in zip(b.column("start").to_pylist(), b.column("ids"), strict=True):
                    got = ids.values
                    if not ids.is_valid or not len(got):
                        continue
                    if got.null_count or start is None:
                        raise ValueError("a position or an id is null")
                    values = got.to_numpy().astype(np.int64)
                    if values.min() < 0 or values.max() >= 1 << 8 * self.width:
                        raise ValueError(f"token id out of range of {self.width} bytes")
                    if out is None or start != after:  # a new run of positions
                        if out is not None:
                            out.close()
                            done.append((name, first, after - first))
                        name, first, after = f"tokens-{self.job}-{uuid.uuid4().hex}.bin", start, start
                        out = store.open_output_stream(f"{root}/{name}", buffer_size=BUFFER)
                    out.write(values.astype(f"<u{self.width}").tobytes())
                    after += len(values)
            if out is not None:
                out.close()
                done.append((name, first, after - first))
        except BaseException:
            if out is not None:
                out.close()
            for x in [*(n for n, *_ in done), *([name] if name else [])]:
                _remove(store, f"{root}/{x}")
            raise
        return _Written(done)

    def commit(self, messages: list) -> None:
        store, root = located(self.path)
        if self.packed:
            messages = _placed(messages)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        at = 0
        for _, first, n in files:
            if first != at:
                self.abort(messages)
                raise ValueError(f"positions {min(at, first)} to {max(at, first)} are missing or written twice")
            at += n
        self._sweep({f[0] for f in files})
        manifest = {"width": self.width, "tokens": at, "files": [{"name": n, "first": a, "tokens": k} for n, a, k in files]}
        try:
            with store.open_input_stream(f"{root}/{MANIFEST}") as f:
                old = [x["name"] for x in json.loads(f.read())["files"]]
        except FileNotFoundError:
            old = []
        with store.open_output_stream(f"{root}/_{MANIFEST}.{self.job}") as out:
            out.write(json.dumps(manifest).encode())
        store.move(f"{root}/_{MANIFEST}.{self.job}", f"{root}/{MANIFEST}")
        for name in old:  # of the stream that this one replaces
            _remove(store, f"{root}/{name}")

    def abort(self, messages: list) -> None:
        self._sweep(set())

    def _sweep(self, keep: set[str]) -> None:
        """Remove this job's files, of killed attempts too, but for those to keep."""
        from pyarrow import fs

        store, root = located(self.path)
        for f in store.get_file_info(fs.FileSelector(root)):
            if f.base_name.startswith(f"tokens-{self.job}-") and f.base_name not in keep:
                _remove(store, f.path)


def _placed(messages: list) -> list:
    """The messages of packed rows with the first positions of their files, in order of the partitions."""
    out, at = [], 0
    for m in sorted((m for m in messages if m), key=lambda m: m.part):
        moved = []
        for name, _, n in m.files:
            moved.append((name, at, n))
            at += n
        out.append(_Written(moved, m.part))
    return out


def _remove(store, path: str) -> None:
    try:
        store.delete_file(path)
    except FileNotFoundError:
        pass


class TokenSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomtext_tokens"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("width", 2)), schema.names == ["packed"])


def write_stream(rows: DataFrame, path: str, width: int = 2) -> int:
    """Write rows (start, ids) below `path`; the stream's length. A stream that is there already is replaced when the new one is complete."""
    spark = rows.sparkSession
    spark.dataSource.register(TokenSink)
    dealt = rows.where("size(ids) > 0").repartitionByRange("start").sortWithinPartitions("start").select(F.col("start").cast("long"), F.col("ids").cast("array<int>"))
    dealt.write.format("loomtext_tokens").option("width", width).mode("append").save(path)
    return TokenFiles(path).tokens


def write_ordered(rows: DataFrame, path: str, width: int) -> int:
    """Write the ids of all rows (packed) below `path`, in order of the partitions and of the rows in them; the stream's length. A stream that is there
    already is replaced when the new one is complete."""
    rows.sparkSession.dataSource.register(TokenSink)
    rows.select("packed").write.format("loomtext_tokens").option("width", width).mode("append").save(path)
    return TokenFiles(path).tokens


class TokenFiles:
    """A written stream: any part of it by one seek for each file that it reaches into."""

    def __init__(self, path: str):
        self.path = path
        self.store, self.root = located(path)
        with self.store.open_input_stream(f"{self.root}/{MANIFEST}") as f:
            self.manifest = json.loads(f.read())
        self.width, self.tokens = self.manifest["width"], self.manifest["tokens"]
        self.firsts = [f["first"] for f in self.manifest["files"]]
        self.seeks = 0
        self._open: tuple[int, object] | None = None

    def read(self, start: int, n: int) -> np.ndarray:
        """Tokens [start, start + n); positions outside the stream raise IndexError."""
        if start < 0 or n < 0 or start + n > self.tokens:
            raise IndexError(f"positions {start} to {start + n} of {self.tokens}")
        parts, i = [], bisect.bisect_right(self.firsts, start) - 1
        while n:
            f = self.manifest["files"][i]
            take = min(n, f["first"] + f["tokens"] - start)
            if self._open is None or self._open[0] != i:
                self._open = i, self.store.open_input_file(f"{self.root}/{f['name']}")
            self._open[1].seek((start - f["first"]) * self.width)
            self.seeks += 1
            parts.append(np.frombuffer(self._open[1].read(take * self.width), dtype=f"<u{self.width}"))
            start, n, i = start + take, n - take, i + 1
        return np.concatenate(parts) if parts else np.zeros(0, dtype=f"<u{self.width}")


@functools.lru_cache(maxsize=4)
def _held(path: str, job: str) -> TokenFiles:
    return TokenFiles(path)


def read_blocks(spark: SparkSession, path: str, size: int = 1 << 16) -> DataFrame:
    """(start, ids): the stream in blocks of `size` tokens, each read where it is used."""
    n, job = TokenFiles(path).tokens, uuid.uuid4().hex

    def run(batches):
        for b in batches:
            got = [_held(path, job).read(i * size, min(size, n - i * size)) for i in b.column(0).to_pylist()]
            yield from _rows([b.column(0).to_numpy() * size], ["start"], got, ["ids"])

    return spark.range(-(-n // size)).mapInArrow(run, "start long, ids array<int>")


def read_windows(starts: DataFrame, path: str, length: int) -> DataFrame:
    """(sample_id, start, x, y) for (sample_id, start): x = d[s : s + length], y = d[s + 1 : s + length + 1], by one seek each and no shuffle."""
    job = uuid.uuid4().hex

    def run(batches):
        for b in batches:
            got = [_held(path, job).read(s, length + 1) for s in b.column(1).to_pylist()]
            for at in range(0, len(got), 4096):
                part = got[at : at + 4096]
                yield from _rows([b.column(0).slice(at, 4096), b.column(1).slice(at, 4096)], ["sample_id", "start"], part, ["x", "y"])

    kind = dict(starts.dtypes)["sample_id"]
    return starts.select("sample_id", F.col("start").cast("long")).mapInArrow(run, f"sample_id {kind}, start long, x array<int>, y array<int>")


def _rows(columns: list, names: list[str], got: list[np.ndarray], lists: list[str]) -> Iterator[pa.RecordBatch]:
    if not got:
        return
    parts = [got] if len(lists) == 1 else [[g[:-1] for g in got], [g[1:] for g in got]]
    arrays = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(g) for g in p])]).astype(np.int32)), pa.array(np.concatenate(p).astype(np.int32))) for p in parts]
    yield pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c) for c in columns), *arrays], names=[*names, *lists])
