"""A corpus as a Spark data source: text files read by byte ranges, batch and streaming.

spark.dataSource.register(CorpusSource), then spark.read.format("loomtext_corpus").option("delimiter", ...).load(path), or readStream. Nothing is sought
on the driver, which only lists files and cuts them into ranges of `split` bytes; each task finds where its own first document begins.

Options: path, a file, a folder or a pattern of names in a folder; delimiter, default the end token; split, bytes of a range, default 128 MB; piece,
bytes of a piece where there is no delimiter, default 1 MB.

Rows (file, start, end, text), start and end being byte offsets. With a delimiter, a row is what stands between two of them, empty or not, and a
range has the rows that begin with it (its first byte, in the file's first range) or after a delimiter that begins in it, so a delimiter that lies
across the end of a range counts for the range it begins in. A delimiter that can overlap itself, as "--" in "---", is only unambiguous from the file's
beginning: such files aren't split. With an empty delimiter, a row is a piece of some `piece` bytes, cut where a pre-token must begin, between a printable
ASCII character and a blank before an ASCII letter or digit; a file without such a place is one row. Bytes that aren't UTF-8 are dropped.

A stream has the rows of files as they come; a file that has grown is read on from its former end, as if it were a file of its own. Files are
opened by pyarrow's file systems: in a store that only Spark reads, files.read_documents is the reader.
"""
from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loomtext.functions.text import END

SPLIT, PIECE, BLOCK = 128 << 20, 1 << 20, 1 << 20
_CUT = re.compile(rb"(?<=[!-~]) (?=[A-Za-z0-9])")
SCHEMA = "file string, start long, end long, text string"
_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])


def located(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    return fs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else path if "://" in path else f"file://{os.path.abspath(path)}")


def listed(path: str) -> dict[str, int]:
    """Sizes of the files that a path names; names that begin with _ or . are none."""
    from pyarrow import fs

    store, at = located(path)
    info = store.get_file_info(at)
    pattern = "*"
    if info.type == fs.FileType.NotFound and any(c in at for c in "*?["):
        at, _, pattern = at.rpartition("/")
        info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return {info.path: info.size}
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(at))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[0] not in "_." and fnmatch.fnmatch(f.base_name, pattern)}


def overlaps_itself(delimiter: bytes) -> bool:
    """Whether an end of the delimiter is a beginning of it."""
    return any(delimiter[-k:] == delimiter[:k] for k in range(1, len(delimiter)))


@dataclass
class Range(InputPartition):
    """Bytes [first, last) of a file; low and high: where its text as a whole begins and ends."""

    file: str
    first: int
    last: int
    low: int
    high: int


class _Window:
    """Bytes of a file from a place on, read in blocks as they are asked for."""

    def __init__(self, f, at: int, high: int):
        self.f, self.at, self.high, self.held = f, at, high, bytearray()

    def more(self) -> bool:
        begin = self.at + len(self.held)
        if begin >= self.high:
            return False
        self.f.seek(begin)
        got = self.f.read(min(BLOCK, self.high - begin))
        self.held += got
        return bool(got)

    def find(self, sought: bytes, start: int) -> int:
        """The place of the first `sought` that begins at or after `start`, or -1."""
        i = start - self.at
        while (found := self.held.find(sought, i)) < 0:
            i = max(i, len(self.held) - len(sought) + 1)
            if not self.more():
                return -1
        return self.at + found

    def cut(self, start: int) -> int:
        """The first safe cut at or after `start`, or the end."""
        i = start - self.at
        while True:
            m = _CUT.search(self.held, i)
            if m:
                return self.at + m.start()
            i = max(i, len(self.held) - 2)
            if not self.more():
                return self.high

    def take(self, start: int, end: int) -> bytes:
        """Bytes [start, end); of what lies before `end` only the last byte is kept, which a cut's rule looks at."""
        while self.at + len(self.held) < end and self.more():
            pass
        got = bytes(self.held[start - self.at : end - self.at])
        keep = max(self.at, end - 1)
        del self.held[: keep - self.at]
        self.at = keep
        return got


def documents(w: _Window, part: Range, delimiter: bytes) -> Iterator[tuple[int, int, bytes]]:
    at = part.first
    if at > part.low:  # the first document that begins in this range stands after a delimiter
        found = w.find(delimiter, at)
        if not 0 <= found < part.last:
            return
        at = found + len(delimiter)
    while True:
        end = w.find(delimiter, at)
        stop = part.high if end < 0 else end
        yield at, stop, w.take(at, stop)
        if end < 0 or end >= part.last:
            return
        at = end + len(delimiter)


def pieces(w: _Window, part: Range, size: int) -> Iterator[tuple[int, int, bytes]]:
    at = part.first if part.first == part.low else w.cut(part.first)
    while at < part.last:
        end = w.cut(max(at + 1, at + size if part.last == part.high else min(at + size, part.last)))
        yield at, end, w.take(at, end)
        at = end


class _Reads:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.delimiter = options.get("delimiter", END).encode()
        self.split, self.piece = int(options.get("split", SPLIT)), int(options.get("piece", PIECE))

    def ranges(self, file: str, low: int, high: int) -> list[Range]:
        if high <= low:
            return []
        step = high - low if self.delimiter and overlaps_itself(self.delimiter) else self.split
        return [Range(file, a, min(a + step, high), low, high) for a in range(low, high, step)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        rows, size = [], 0

        def batch():
            cols = list(zip(*rows, strict=True))
            return pa.record_batch([pa.array(cols[i], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)

        with store.open_input_file(part.file) as f:
            w = _Window(f, max(part.low, part.first - 1), part.high)
            found = documents(w, part, self.delimiter) if self.delimiter else pieces(w, part, self.piece)
            for start, end, data in found:
                rows.append((part.file, start, end, data.decode("utf-8", "ignore")))
                size += len(data)
                if size >= 4 << 20 or len(rows) >= 10_000:
                    yield batch()
                    rows, size = [], 0
            if rows:
                yield batch()


class _Batch(_Reads, DataSourceReader):
    def partitions(self):
        return [r for file, size in listed(self.path).items() for r in self.ranges(file, 0, size)]


class _Stream(_Reads, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(listed(self.path), sort_keys=True)}

    def partitions(self, start: dict, end: dict):
        old, new = json.loads(start["files"]), json.loads(end["files"])
        return [r for file, size in sorted(new.items()) for r in self.ranges(file, old.get(file, 0), size)]

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomtext_corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)
