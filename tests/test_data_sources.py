"""The corpus reader against plain splitting, the token sink against arrays, aborts and killed attempts."""
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import corpus, tokenizer
from loomtext.plans import queries as Q
from loomtext.sources import corpus_source, token_files
from loomtext.sources.corpus_source import CorpusSource


@pytest.fixture(scope="module")
def sourced(spark):
    spark.dataSource.register(CorpusSource)
    return spark


def read(spark, path, **options):
    return spark.read.format("loomtext_corpus").options(**options).load(str(path))


@pytest.mark.parametrize("split", [1, 2, 5, 7, 64, 10_000])
@pytest.mark.parametrize("delimiter", ["<|e|>", "\n", "é|", "--"])
def test_ranges_equal_a_plain_reader(delimiter, split, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_source, "BLOCK", 3)
    rng = random.Random(split)
    for k in range(6):
        parts = [rng.choice(["", "a", "bc ", "é", "<|", "|>", "-", "long text"]).encode() for _ in range(rng.randint(0, 12))]
        data = delimiter.encode().join(parts) + (b"\xff\xfe" if k % 2 else b"")
        (tmp_path / f"f{k}.txt").write_bytes(data)
        r = corpus_source._Batch({"path": str(tmp_path / f"f{k}.txt"), "delimiter": delimiter, "split": str(split)})
        got = [row for p in r.partitions() for b in r.read(p) for row in b.to_pylist()]
        want = [x.decode("utf-8", "ignore") for x in data.split(delimiter.encode())] if data else []
        assert [x["text"] for x in got] == want
        assert all(data[x["start"] : x["end"]].decode("utf-8", "ignore") == x["text"] for x in got)


@pytest.mark.parametrize("split, piece", [(5, 3), (100, 10), (40, 1000), (1000, 37)])
def test_pieces_keep_the_pre_tokens_of_the_file(split, piece, tmp_path, monkeypatch):
    import regex

    monkeypatch.setattr(corpus_source, "BLOCK", 11)
    rng = random.Random(piece)
    data = "".join(rng.choice(["word", " ", "  ", "\n", "é", "　", "x1", "!?", " a", "'s", "\t"]) for _ in range(400)).encode() + b" \xff end"
    (tmp_path / "f.txt").write_bytes(data)
    r = corpus_source._Batch({"path": str(tmp_path / "f.txt"), "delimiter": "", "split": str(split), "piece": str(piece)})
    got = [row for p in r.partitions() for b in r.read(p) for row in b.to_pylist()]
    assert "".join(x["text"] for x in got) == data.decode("utf-8", "ignore") and len(got) > 1
    assert [got[i]["end"] for i in range(len(got) - 1)] == [x["start"] for x in got[1:]] and got[-1]["end"] == len(data)
    find = regex.compile(T.PATTERN).findall
    assert [p for x in got for p in find(x["text"])] == find(data.decode("utf-8", "ignore"))


def test_reader_in_spark(sourced, tmp_path):
    docs = [f"document {i}\n" * (i % 9) for i in range(500)]
    (tmp_path / "a.txt").write_text("<|endoftext|>".join(docs))
    (tmp_path / "b.txt").write_text("no delimiter here")
    (tmp_path / "_c.txt").write_text("not read")
    (tmp_path / "empty.txt").write_text("")
    got = read(sourced, tmp_path, split=1000)
    assert got.rdd.getNumPartitions() > 5
    assert [r.text for r in got.orderBy("file", "start").collect()] == [*docs, "no delimiter here"]
    assert read(sourced, f"{tmp_path}/b*").count() == 1
    with pytest.raises(Exception, match="FileNotFound|none"):
        read(sourced, tmp_path / "none").count()


def test_stream_equals_batch(sourced, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one|two|three")
    rows = sourced.readStream.format("loomtext_corpus").options(delimiter="|", split=4).load(str(tmp_path / "in"))

    def run():
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    def texts():
        return sorted(r.text for r in sourced.read.parquet(str(tmp_path / "out")).collect())

    run()
    assert texts() == ["one", "three", "two"]
    (tmp_path / "in" / "b.txt").write_text("four|five")
    with (tmp_path / "in" / "a.txt").open("a") as f:
        f.write("six|seven")
    run()
    assert texts() == sorted(["one", "two", "three", "four", "five", "six", "seven"])


def stream(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 60_000, n)
    cuts = sorted({0, n, *rng.integers(0, n, 40).tolist()})
    rows = [(a, ids[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)]
    return ids, spark.createDataFrame([*rows, (n, []), (n, None)], "start long, ids array<int>").repartition(5)


def test_flat_files_hold_the_stream(spark, tmp_path):
    ids, rows = stream(spark, 10_000)
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert token_files.write_stream(rows, path) == 10_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    manifest = json.loads((tmp_path / "t" / "manifest.json").read_text())
    assert {f["name"] for f in manifest["files"]} == {p.name for p in (tmp_path / "t").glob("tokens-*")} and len(manifest["files"]) > 1
    assert sum(p.stat().st_size for p in (tmp_path / "t").glob("tokens-*")) == 20_000
    t = token_files.TokenFiles(path)
    assert (t.read(0, 10_000) == ids).all() and (t.read(9_999, 1) == ids[-1:]).all() and not len(t.read(10_000, 0))
    inside = manifest["files"][1]
    t.seeks = 0
    assert (t.read(inside["first"] + 1, 5) == ids[inside["first"] + 1 :][:5]).all() and t.seeks == 1
    for start, n in ((-1, 2), (9_999, 2), (0, 10_001)):
        with pytest.raises(IndexError):
            t.read(start, n)
    assert np.concatenate([r.ids for r in token_files.read_blocks(spark, path, 999).orderBy("start").collect()]).tolist() == ids.tolist()
    starts = spark.range(9_993).select(F.col("id").alias("sample_id"), F.col("id").alias("start"))
    got = token_files.read_windows(starts, path, 7)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.where("start % 501 = 0").collect():
        assert r.x == ids[r.start : r.start + 7].tolist() and r.y == ids[r.start + 1 : r.start + 8].tolist()
    again, more = stream(spark, 500, 1)  # replaces the stream
    token_files.write_stream(more, path, 4)
    assert (token_files.TokenFiles(path).read(0, 500) == again).all() and token_files.TokenFiles(path).width == 4
    assert sum(p.stat().st_size for p in (tmp_path / "t").glob("tokens-*")) == 2_000


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "t")
    bad = spark.createDataFrame([(0, [1, 2]), (2, [70_000]), (3, [4])], "start long, ids array<int>")
    with pytest.raises(Exception, match="out of range"):
        token_files.write_stream(bad, path)
    assert not list((tmp_path / "t").glob("*"))
    gap = spark.createDataFrame([(0, [1, 2]), (3, [4])], "start long, ids array<int>")
    with pytest.raises(Exception, match="missing or written twice"):
        token_files.write_stream(gap, path)
    assert not list((tmp_path / "t").glob("*"))
    assert token_files.write_stream(gap.where("false"), path) == 0


def test_a_killed_attempt_leaves_no_file(tmp_path):
    """A task that died without a message: its file is of the job, but not in any message."""
    w = token_files._Writer(str(tmp_path / "t"), 2)
    batch = lambda start, ids: pa.record_batch([pa.array([start]), pa.array([ids], pa.list_(pa.int32()))], names=["start", "ids"])
    w.write(iter([batch(0, [9, 9, 9])]))  # killed: the message is lost
    messages = [w.write(iter([batch(2, [3])])), None, w.write(iter([batch(0, [1, 2])]))]
    w.commit(messages)
    assert token_files.TokenFiles(str(tmp_path / "t")).read(0, 3).tolist() == [1, 2, 3]
    assert len(list((tmp_path / "t").glob("tokens-*"))) == 2
    other = token_files._Writer(str(tmp_path / "t"), 2)
    other.abort([other.write(iter([batch(0, [5])]))])
    assert token_files.TokenFiles(str(tmp_path / "t")).read(0, 3).tolist() == [1, 2, 3] and len(list((tmp_path / "t").glob("*"))) == 3


def test_packed_rows_stand_in_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    parts = [(int(k), rng.integers(0, 60_000, int(n))) for k, n in zip(rng.permutation(400), rng.integers(0, 50, 400), strict=True)]
    rows = [(k, token_files.pack(x.tolist(), 2)) for k, x in parts] + [(None, token_files.pack([7, 8], 2)), (401, None)]
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = token_files.write_ordered(spark.createDataFrame(rows, "k int, packed binary").repartitionByRange(5, "k").sortWithinPartitions("k"), path, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [7, 8] + [int(i) for _, x in sorted(parts, key=lambda r: r[0]) for i in x]
    t = token_files.TokenFiles(path)
    assert n == len(want) and t.read(0, n).tolist() == want and len(t.manifest["files"]) > 1
    with pytest.raises(Exception, match="aren't of 4 bytes"):
        token_files.write_ordered(spark.createDataFrame([(1, token_files.pack([1], 2))], "k int, packed binary"), path, 4)
    assert token_files.TokenFiles(path).read(0, n).tolist() == want and len(list((tmp_path / "t").glob("tokens-*"))) == len(t.manifest["files"])
    assert token_files.write_ordered(spark.createDataFrame([], "k int, packed binary"), str(tmp_path / "e"), 2) == 0


def test_equal_and_null_keys_and_texts(spark, tmp_path):
    tok = Q.book()
    docs = spark.createDataFrame([(1, "the then"), (1, "an other"), (1, "the then"), (None, "first"), (2, None), (3, ""), (0, "zero")], "doc_id int, text string")
    n = corpus.encode_files(docs, tok, str(tmp_path / "t"))
    got = token_files.TokenFiles(str(tmp_path / "t")).read(0, n).tolist()
    one, two = tok.encode_text("the then"), tok.encode_text("an other")
    assert got in [tok.encode_text("first") + tok.encode_text("zero") + x for x in (one + one + two, two + one + one)]
    with pytest.raises(ValueError, match="don't fit"):
        tokenizer.Tokenizer({**dict(enumerate(bytes([i]) for i in range(256))), 70_000: b"ab"}, []).encode_packed(docs)


def test_queries_agree_with_the_other_paths(spark):
    sf = "/root/testdata/sf0.001"
    for flat, other in (("encode_files", "encode_dataset"), ("file_windows", "batch_windows")):
        a, b = (sorted(map(str, Q.REGISTRY[x][0](spark, sf).collect())) for x in (flat, other))
        assert a == b and a
    assert re.fullmatch(r"\d+", str(len(a)))


def test_a_stream_is_shuffled_packed_and_digested_where_it_lies(spark, tmp_path):
    import hashlib

    from loomtext import profiling

    path, n = str(tmp_path / "s"), []
    m = profiling.measured(spark, lambda: n.append(corpus.encode_dataset(Q.read(spark, "/root/testdata/sf0.01", "documents"), Q.book(), path)) or corpus.stream_blocks(spark.read.parquet(path), 4096).count())
    assert m["shuffle_bytes"] < 6 * n[0]  # 18 a token when arrays and single tokens with their positions were
    stream = spark.createDataFrame([(i, i % 300) for i in range(1000) if i != 500], "pos long, token_id int").repartitionByRange(3, "pos").sortWithinPartitions("pos")
    want = {}
    for i in range(1000):
        if i != 500:
            want.setdefault(i // 64, []).append(str(i % 300))
    for rows in (stream, stream.repartition(5)):  # runs, and positions in no order
        got = {r.block: (r.n_tokens, r.digest) for r in corpus.stream_blocks(rows, 64).collect()}
        assert got == {b: (len(x), hashlib.md5(",".join(x).encode()).hexdigest()) for b, x in want.items()}


def test_a_worker_remembers_little():
    """Of many distinct words: packed ids, and no more of them than KNOWN."""
    import tracemalloc

    book, words = Q.book(), [f"{i:x} then" for i in range(200_000)]
    tracemalloc.start()
    for make in (lambda: tokenizer.packed_encoder(book.ids, book.ranks, book.specials, 2), lambda: tokenizer.text_encoder(book.ids, book.ranks, book.specials)):
        encode, before = make(), tracemalloc.get_traced_memory()[0]
        for w in words:
            encode(w)
        assert tracemalloc.get_traced_memory()[0] - before < 36 << 20
    tracemalloc.stop()
    assert tokenizer.packed_encoder(book.ids, book.ranks, book.specials, 2)("the then<|endoftext|> and") == tokenizer.token_files.pack(book.encode_text("the then<|endoftext|> and"), 2)
