"""Many special tokens by an automaton; decoding with state."""
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import corpus, training
from loomtext.operators.tokenizer import Tokenizer
from loomtext.plans import queries as Q
from loomtext.streaming import decode

SF = "/root/testdata/sf0.01"


def test_automaton_splits_as_the_expression():
    rng = random.Random(3)
    for _ in range(400):
        specials = list({"".join(rng.choice("abé|") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 9))})
        text = "".join(rng.choice("aabbé|c") for _ in range(rng.randint(0, 60)))
        want = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")").split(text)
        assert T.special_splitter(specials, 0)(text) == want == T.special_splitter(specials, 99)(text)
    assert T.special_splitter([])("ab") == ["ab"]


def test_ten_thousand_special_tokens(spark):
    specials = [f"<|s{i}|>" for i in range(10_000)]
    split = T.special_splitter(specials)
    text = "".join(f"word {i} <|s{i % 10_000}|>" for i in range(100_000))
    began = time.time()
    got = split(text)
    assert time.time() - began < 20 and len(got) == 200_001 and got[1] == "<|s0|>"
    tok = Tokenizer({i: bytes([i]) for i in range(256)}, [], specials)
    assert tok.encode_text("a<|s7|><|s70|>b") == [97, tok.ids[b"<|s7|>"], tok.ids[b"<|s70|>"], 98]
    docs = spark.createDataFrame([(1, "the <|s5|>the"), (2, None)], "doc_id int, text string")
    assert {r.pretoken: r.n for r in training.pretoken_counts(docs, specials).collect()} == {"the": 2, " ": 1}


def test_segments_of_all_documents_equal_the_expression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [corpus.split_at_specials(docs, Q._FOUND, many=many).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64("pos", "segment", "special").cast("decimal(38,0)")).alias("h")) for many in (0, 99)]
    a, b = (sorted(map(tuple, r.collect())) for r in rows)
    assert a == b and len(a) > 900
    (want,) = docs.agg(F.sum(F.size(T.split_special(F.col("text"), Q._FOUND)))).first()
    assert sum(r[1] for r in a) == want


def test_characters_split_over_micro_batches(spark, tmp_path):
    vocab = {i: bytes([i]) for i in range(256)} | {256: "é".encode(), 257: "\U0001f600".encode()[:2], 258: "\U0001f600".encode()[2:]}
    data = list("aé\U0001f600".encode())
    rng = random.Random(0)
    keys = {k: [rng.choice([*data, 256, 257, 258, 255]) for _ in range(60)] for k in "xyz"}
    for batch in range(6):
        rows = [(k, batch * 10 + i, ids[batch * 10 + i : batch * 10 + i + 1]) for k, ids in keys.items() for i in range(10)]
        rows += [(k, 999, None) for k in keys if batch == 5]
        rng.shuffle(rows)
        spark.createDataFrame(rows, "key string, seq int, ids array<int>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by their time
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.schema("key string, seq int, ids array<int>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = decode.decode_stream(stream, vocab, "key", "seq")
    q = out.writeStream.format("memory").queryName("decoded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert q.exception() is None
    got = {}
    for r in spark.sql("SELECT * FROM decoded").collect():
        got.setdefault(r.key, []).append((r.seq, r.text))
    assert {k: "".join(t for _, t in sorted(v)) for k, v in got.items()} == {k: Tokenizer(vocab, []).decode_ids(ids) for k, ids in keys.items()}
    assert any(t == "" for v in got.values() for _, t in v)  # bytes were held


def test_query_is_whole(spark):
    rows = Q.REGISTRY["special_split_many"][0](spark, SF).collect()
    assert len(rows) == 1_000 and sum(r.n_special for r in rows) > 1_000
    with pytest.raises(Exception):
        Tokenizer({0: b"a"}, []).decode_ids([5])
