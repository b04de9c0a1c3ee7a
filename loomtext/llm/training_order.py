"""Training-order materialisation of token sequences.

Texts are encoded once, each followed by the end token, and stand in a stream in the order of a hash of doc_id and text, so the
stream doesn't depend on files, splits or partitions. It is cut into sequences of `length` tokens; the last one is filled up with end
tokens. A keyed Feistel network permutes the sequences' numbers: it works on the smallest even number of bits that holds them, and a value outside
[0, n) is walked along its cycle until it falls inside. So every sequence has one global slot, computed without a table
or a sort of random numbers.

Rows are dealt to blocks of the hash's range, where they are sorted, and each block's tokens are counted: one small row per block,
whose sums give each block its place in the stream. Counting and cutting read the same shuffled rows, so nothing is encoded twice. A
block cuts its part of the stream into records; one that reaches across blocks comes in pieces, which are put together when its shard is
written.

Shards hold `shard` consecutive slots each, records of length * width bytes: slot s is at byte (s % shard) * stride of
shard s // shard. Range partitions of the slots write them in order, so a reader goes on from any slot by
arithmetic. A shard is written under a temporary name and renamed, so a repeated task leaves the same file; `finish` removes what
failed attempts left, checks all shards and writes the manifest that a reader starts from. The folder is the caller's and stays.

Edge cases: null and empty texts are one end token; very long texts fill several sequences; repeated rows (equal id and text) stand in
the stream one after another, and all in one block; an empty table writes no shard; null ids are carried as null; ids may be of any
type; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm import hashing, token_counts, vocabulary
from loomtext.llm.common import by_bytes, materialize, scratch_path

LENGTH, SHARD, KEY = 1024, 16_384, 0x5EED
_ROUNDS = 6
#: Bytes of ids that a task holds while it packs them, and the level of their compression.
BUFFER, LEVEL = 8 << 20, 6


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed bijection of [0, n)."""
    half = np.uint64(max(1, (max(2, n) - 1).bit_length() + 1 >> 1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = hashing.mix(np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(2 * key + 1))
    x, out = index.astype(np.uint64), np.zeros(len(index), dtype=np.int64)
    open_ = np.arange(len(index))
    while len(open_):
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (hashing.mix(right + k) & mask)
        x = left << half | right
        inside = x < np.uint64(n)
        out[open_[inside]] = x[inside].astype(np.int64)
        open_, x = open_[~inside], x[~inside]
    return out


def _lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _packed(key: str, keys: np.ndarray, payloads: list[bytes], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """Rows with equal keys as one row: arrays of their columns, of the payloads' sizes in bytes, and the payloads, compressed together. Token ids
    are compressed better that way, and the exchanges of payloads are what takes disk."""
    codec = pa.Codec("zstd", LEVEL)
    order = np.argsort(keys, kind="stable")
    found, starts = np.unique(keys[order], return_index=True)
    sizes = np.diff(np.append(starts, len(keys)))
    lists = {c: _lists(sizes, v.take(pa.array(order))) for c, v in columns.items()}
    bytes_of = np.array([len(x) for x in payloads], dtype=np.int64)
    blobs = [codec.compress(b"".join(payloads[i] for i in part), asbytes=True) for part in np.split(order, starts[1:])]
    cols = {key: pa.array(found.astype(np.int32)), **lists, "bytes": _lists(sizes, pa.array(bytes_of[order])), "packed": pa.array(blobs, pa.binary())}
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _unpacked(key: str, names: list[str], payload: str):
    """The rows that _packed has put together, one batch for each of its rows."""

    def run(batches):
        codec = pa.Codec("zstd", LEVEL)
        for b in batches:
            for i in range(b.num_rows):
                sizes = b.column("bytes")[i].as_py()
                data, ends = codec.decompress(b.column("packed")[i].as_py(), sum(sizes), asbytes=True), np.cumsum(sizes).tolist()
                cols = [b.column(c)[i].values for c in names]
                rows = pa.array([data[e - n : e] for e, n in zip(ends, sizes, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([b.column(key)[i].as_py()] * len(sizes), pa.int32()), *cols, rows], names=[key, *names, payload])

    return run


def _encode(path: str, end: int, kind: str):
    """Rows with a text -> rows with its ids, the end token included, packed by block."""

    def run(batches):
        c, held, size = token_counts.counter(path), [], 0

        def out():
            keys = np.concatenate([b.column("block").to_numpy() for b, _ in held])
            both = {k: pa.concat_arrays([b.column(k) for b, _ in held]) for k in ("place", "doc_id")}
            return _packed("block", keys, [x for _, ids in held for x in ids], both)

        for b in by_bytes(batches, "text"):
            ids = [np.append(c.ids(t), np.uint32(end)).astype(kind).tobytes() for t in b.column("text").to_pylist()]
            held.append((b.drop_columns(["text"]), ids))
            size += sum(map(len, ids))
            if size >= BUFFER:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return run


def _count(width: int):
    """(block, n): tokens by block."""

    def run(batches):
        total: dict[int, int] = {}
        for b in batches:
            for k, sizes in zip(b.column("block").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + sum(sizes) // width
        yield pa.record_batch({"block": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    return run


def _cut(length: int, shard: int, parts: int, key: int, kind: str):
    """Sorted rows of blocks, each with its start and the stream's length -> records, or pieces of them, packed by part: (slot, at, piece, doc_ids).
    part: the one of `parts` ranges of shards that the slot is in."""

    def run(batches):
        block, at, total = None, 0, 0  # at: the stream's position of the first token held
        held, owners, size, ids_type = [], [], 0, None

        def out(last: bool):
            nonlocal held, owners, size, at
            data, ends = np.concatenate(held), at + np.cumsum([len(h) for h in held])
            first, stop = at // length, at + len(data) if last else (at + len(data)) // length * length
            cuts = np.unique(np.concatenate([[at], np.arange((first + 1) * length, stop, length), [stop]]))
            sequence, begins, finishes = cuts[:-1] // length, cuts[:-1], cuts[1:]
            lo, hi = np.searchsorted(ends, begins, "right"), np.searchsorted(ends, finishes, "left") + 1
            sequences = -(-total // length)
            slots = permute(sequence, sequences, key)
            part = slots // shard * parts // -(-sequences // shard)
            pieces = [data[a - at : b - at].tobytes() for a, b in zip(begins, finishes, strict=True)]
            ids = pa.array([owners[a:b] for a, b in zip(lo, hi, strict=True)], pa.list_(ids_type))
            batch = _packed("part", part, pieces, {"slot": pa.array(slots), "at": pa.array(begins % length), "doc_ids": ids})
            rest = data[stop - at :]
            done = int(np.searchsorted(ends, stop, "right"))  # documents that end before the rest
            lengths = np.diff(np.concatenate([[stop], ends[done:]]))
            held, owners = np.split(rest, np.cumsum(lengths)[:-1]) if len(rest) else [], owners[done:] if len(rest) else []
            size, at = len(rest), stop
            return batch

        for b in batches:
            ids_type = b.schema.field("doc_id").type
            for k, start, whole, ids, doc in zip(*(b.column(c).to_pylist() for c in ("block", "start", "total", "ids", "doc_id")), strict=True):
                if k != block:
                    if size:
                        yield out(True)
                    block, at, total, held, owners, size = k, start, whole, [], [], 0
                held.append(np.frombuffer(ids, dtype=kind))
                owners.append(doc)
                size += len(held[-1])
                if size * held[-1].itemsize >= BUFFER and size >= 2 * length:
                    yield out(False)
        if size:
            yield out(True)

    return run


def _write(folder: str, length: int, shard: int, end: int, kind: str):
    """Pieces sorted by (slot, at) -> shards, and a row per record."""
    stride = length * np.dtype(kind).itemsize
    filler = np.full(length, end, dtype=kind).tobytes()

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        task, at, out, name = TaskContext.get().taskAttemptId(), None, None, None
        slot, held, ids, done, ids_type = None, [], [], [], pa.int64()

        def close():
            out.close()
            store.move(f"{root}/_{name}.{task}", f"{root}/{name}")

        def put():
            nonlocal at, out, name
            r = b"".join(held)
            r += filler[len(r) :]
            if slot // shard != at:
                if out is not None:
                    close()
                at, name = slot // shard, f"shard-{slot // shard:08d}.bin"
                out = store.open_output_stream(f"{root}/_{name}.{task}")
            out.write(r)
            done.append((slot, at, slot % shard * stride, hashlib.sha256(r).hexdigest(), ids))

        def rows():
            cols = list(zip(*done, strict=True))
            return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(ids_type))], names=["slot", "shard", "byte_offset", "record_sha256", "doc_ids"])

        for b in batches:
            ids_type = b.schema.field("doc_ids").type.value_type
            for s, piece, docs in zip(*(b.column(c).to_pylist() for c in ("slot", "piece", "doc_ids")), strict=True):
                if s != slot:
                    if slot is not None:
                        put()
                    slot, held, ids = s, [], []
                held.append(piece)
                ids = ids + docs
            if done:
                yield rows()
                done = []
        if slot is not None:
            put()
            close()
            yield rows()

    return run


def materialize_order(docs: DataFrame, path: str, folder: str, length: int = LENGTH, shard: int = SHARD, key: int = KEY, end: int | None = None) -> DataFrame:
    """Write the shards below `folder` (a URI all executors reach), check them, write the manifest, all at the call, and return the stored rows.

    Result, one row per sequence: slot, shard, byte_offset, record_sha256, doc_ids (of the documents in it). end: the end
    token, by default the vocabulary's special token, the one with the smallest id.
    """
    v = vocabulary.load(path)
    end = min(v.specials.values()) if end is None else end
    if len(v.tokens) > 1 << 16 > end:
        raise ValueError("a vocabulary of over 65,536 tokens needs an end token beyond them")
    kind = "<u2" if end < 1 << 16 else "<u4"
    rows, _ = materialize(_written(docs, path, folder, length, shard, key, end, kind), "order")
    finish(docs.sparkSession, folder, rows, length, shard, np.dtype(kind).itemsize)
    return rows


def _written(docs: DataFrame, path: str, folder: str, length: int, shard: int, key: int, end: int, kind: str) -> DataFrame:
    """The rows of materialize_order, whose computation writes the shards."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.xxhash64(F.col("doc_id").cast("string"), "text")
    block = F.floor((F.shiftright("place", 32) + (1 << 31)) * parts / (1 << 32)).cast("int")
    texts = docs.select(place.alias("place"), "doc_id", "text").select(block.alias("block"), "place", "doc_id", "text")
    encoded = texts.mapInArrow(_encode(path, end, kind), f"block int, place array<long>, doc_id array<{id_type}>, bytes array<long>, packed binary")
    dealt = encoded.repartitionById(parts, "block")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.mapInArrow(_count(np.dtype(kind).itemsize), "block int, n long").groupBy("block").agg(F.sum("n").alias("n"))  # a row a block
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rows = dealt.mapInArrow(_unpacked("block", ["place", "doc_id"], "ids"), f"block int, place long, doc_id {id_type}, ids binary")
    rows = rows.join(F.broadcast(blocks), "block").sortWithinPartitions("place", "doc_id", "ids")
    rows = rows.mapInArrow(_cut(length, shard, parts, key, kind), f"part int, slot array<long>, at array<long>, doc_ids array<array<{id_type}>>, bytes array<long>, packed binary")
    rows = rows.repartitionById(parts, "part")
    rows = rows.mapInArrow(_unpacked("part", ["slot", "at", "doc_ids"], "piece"), f"part int, slot long, at long, doc_ids array<{id_type}>, piece binary").sortWithinPartitions("slot", "at")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return rows.mapInArrow(_write(folder, length, shard, end, kind), f"slot long, shard long, byte_offset long, record_sha256 string, doc_ids array<{id_type}>")


def finish(spark: SparkSession, folder: str, result: DataFrame, length: int = LENGTH, shard: int = SHARD, width: int = 2) -> dict:
    """After `result` (the stored rows of materialize_order) is complete: remove the unfinished files of failed attempts, check that every shard is there
    in full, as on some stores a rename is a copy that may have been cut short, and write manifest.json, with what read_from needs. A folder without it
    is not to be read. Returns it; a shard that is missing or of another size raises OSError."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    manifest = {"sequences": (n := result.count()), "length": length, "shard": shard, "width": width}
    want = {f"shard-{i:08d}.bin": min(shard, n - i * shard) * length * width for i in range(-(-n // shard))}
    for f in store.get_file_info(fs.FileSelector(root)):
        if f.base_name.startswith("_shard-"):
            store.delete_file(f.path)
        elif want.get(f.base_name) == f.size:
            del want[f.base_name]
    if want:
        raise OSError(f"{len(want)} shards missing or cut short, such as {min(want)}")
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_from(folder: str, slot: int, n: int, count: int, length: int = LENGTH, shard: int = SHARD, width: int = 2) -> np.ndarray:
    """Up to `count` sequences from `slot` on, of n: how a reader starts or goes on."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    stride, out = length * width, []
    while count > 0 and slot < n:
        take = min(count, shard - slot % shard, n - slot)
        with store.open_input_file(f"{root}/shard-{slot // shard:08d}.bin") as f:
            f.seek(slot % shard * stride)
            out.append(f.read(take * stride))
        slot, count = slot + take, count - take
    return np.frombuffer(b"".join(out), dtype=f"<u{width}").reshape(-1, length)


def scratch_folder(spark) -> str:
    """A new folder in the shared directory, as a URI, removed when the application ends: for results that only the rows are wanted of."""
    path = scratch_path(spark, "training-order")
    return path if "://" in path or path.startswith("file:") else "file://" + path
