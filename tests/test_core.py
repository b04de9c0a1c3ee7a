"""Operators of the corpus, tokenizer and vector packages."""
import math
import os
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from loomtext.functions import nn, sql, train
from loomtext.functions import text as T
from loomtext.operators import corpus, merges, tokenizer, training
from loomtext.plans import queries as Q
from loomtext.sources import files
from loomtext.streaming import encode as S

#: Paths of a corpus, its merges in byte-unicode characters and its vocabulary, for the golden test; colon-separated.
GOLDEN = os.environ.get("LOOMTEXT_GOLDEN", "").split(":")
ODD = ["", "s", "🙃", "Héllò hôw are ü? 🙃", "\n\n\nfoo", "a b　c", "I'VE 'dx don't", "abababab", "------", "x  \t\n", "no <|endoftext|>!"]


def test_pretokenize_matches_the_pattern(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, t string")
    for i, p in df.select("i", T.pretokenize(F.col("t"))).collect():
        assert p == regex.findall(T.PATTERN, ODD[i])
    assert spark.sql("SELECT CAST(NULL AS string) t").select(T.pretokenize(F.col("t"))).first()[0] is None


def test_split_special_prefers_the_longer(spark):
    t = f"a{T.END}{T.END} b{T.END}"
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(T.split_special(F.col("t"), Q.SPECIALS)).first()[0] == ["a", T.END * 2, " b", T.END]
    assert df.select(T.split_special(F.col("t"))).first()[0] == [t]
    odd = f"\x00{T.END}\x00\ue000a"  # no character is lost as a separator
    assert spark.createDataFrame([(odd,)], "t string").select(T.split_special(F.col("t"), Q.SPECIALS)).first()[0] == ["\x00", T.END, "\x00\ue000a"]
    assert spark.createDataFrame([(None,)], "t string").select(T.split_special(F.col("t"), Q.SPECIALS)).first()[0] is None


def literal_train(counts, n):
    words, out = {tuple(w[i : i + 1] for i in range(len(w))): c for w, c in counts.items()}, []
    for _ in range(n):
        pairs = {}
        for w, c in words.items():
            for p in zip(w, w[1:]):
                pairs[p] = pairs.get(p, 0) + c
        if not pairs:
            break
        a, b = max(pairs, key=lambda p: (pairs[p], p))
        out.append((a, b))
        new = {}
        for w, c in words.items():
            v, i = [], 0
            while i < len(w):
                if w[i : i + 2] == (a, b):
                    v.append(a + b)
                    i += 2
                else:
                    v.append(w[i])
                    i += 1
            new[tuple(v)] = new.get(tuple(v), 0) + c
        words = new
    return out


@pytest.mark.parametrize("seed", range(5))
def test_incremental_training_is_an_exact_recount(seed):
    r = random.Random(seed)
    counts = {bytes(r.choices(b"ab\x00\xff", k=r.randint(1, 9))): r.randint(1, 9) for _ in range(60)}
    assert merges.train(counts, 40) == literal_train(counts, 40)


def test_training_to_a_vocabulary_of_500(spark, tmp_path):
    r = random.Random(8)
    texts = [" ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(60)) for _ in range(8)]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = {}
    for w in (w for t in texts for w in regex.findall(T.PATTERN, t)):
        counts[w.encode()] = counts.get(w.encode(), 0) + 1
    want = literal_train(counts, 243)
    got = {x.token_id: bytes.fromhex(x.token) for x in Q.REGISTRY["bpe_vocab_500"][0](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate([bytes([i]) for i in range(256)] + [T.END.encode()] + [a + b for a, b in want])) and len(got) == 500
    rows = spark.createDataFrame([(w.decode(), n) for w, n in counts.items()], "pretoken string, n long").coalesce(1)
    assert training.train_merges(rows, 243, "iterative") == want


def test_training_strategies_agree(spark):
    docs = spark.createDataFrame([("abababab abab xy",), ("the cat ate the hat",), (None,)], "text string")
    counts = training.pretoken_counts(docs)
    assert training.train_merges(counts, 5, "iterative") == training.train_merges(counts, 5) == literal_train({r[0].encode(): r[1] for r in counts.collect()}, 5)
    assert training.train_merges(counts.limit(0), 5) == []
    with pytest.warns(UserWarning):
        assert training.train_bpe(docs, 10)[1] == []
    with pytest.raises(ValueError):
        training.base_vocabulary(spark, ["x"])


@pytest.mark.skipif(len(GOLDEN) != 3, reason="no golden files given")
def test_golden_merges(spark):
    corpus_path, merges_path, vocab_path = GOLDEN
    want = files.read_merges(merges_path, byte_level=True)
    vocab, got = training.train_bpe_file(spark, corpus_path, 500, [T.END])
    assert got == want and len(vocab) == 500
    assert set(vocab.values()) == set(files.read_vocab(vocab_path).values())


def test_training_on_files(spark, tmp_path):
    text = f"low low{T.END} lower\n\n\nlow{T.END * 2}abab abab \n{T.END}"
    (tmp_path / "c.txt").write_text(text)
    for specials in ([T.END], [T.END, T.END * 2], [T.END + " l", T.END], None):
        whole = training.pretoken_counts(spark.createDataFrame([(text,)], "text string"), specials)
        got = training.pretoken_counts(files.read_corpus(spark, str(tmp_path / "c.txt"), specials), specials)
        assert {r[0]: r[1] for r in got.collect()} == {r[0]: r[1] for r in whole.collect()}
    vocab, m = training.train_bpe_file(spark, str(tmp_path / "c.txt"), 260, [T.END])
    assert len(vocab) == 260 and m == literal_train({b"low": 2, b" low": 1, b" lower": 1, b"\n\n\n": 1, b"abab": 1, b" abab": 1, b" \n": 1}, 3)


def test_sql_functions(spark):
    sql.register(spark, Q.book())
    spark.createDataFrame([*enumerate(ODD), (99, None)], "i int, t string").createOrReplaceTempView("odd")
    rows = spark.sql("SELECT i, t, lt_pretokenize(t) p, lt_encode(t) ids, lt_decode(lt_encode(t)) back FROM odd").collect()
    for r in rows:
        if r.t is None:
            assert r.p is None and r.ids is None and r.back is None
        else:
            assert r.p == regex.findall(T.PATTERN, r.t) and r.ids == Q.book().encode_text(r.t) and r.back == r.t
    got = spark.sql("SELECT i, collect_list(pretoken) p FROM (SELECT i, x.* FROM odd, LATERAL lt_pretoken_rows(t) x ORDER BY i, pos) GROUP BY i").collect()
    assert {r.i: r.p for r in got} == {i: regex.findall(T.PATTERN, t) for i, t in enumerate(ODD) if t}


def test_tokenizer_round_trip_and_rank_order(spark):
    t = Q.book()
    df = spark.createDataFrame([*enumerate(ODD), (99, None)], "doc_id int, text string")
    got = {r[0]: r[1] for r in t.encode(df).collect()}
    assert got[99] is None and got[0] == [] and {i: t.decode_ids(x) for i, x in got.items() if i != 99} == dict(enumerate(ODD))
    back = {r[0]: r[1] for r in t.decode(t.encode(df.where("doc_id < 99"))).collect()}
    assert back == dict(enumerate(ODD))
    rel = t.encode_relational(df).collect()
    for i in range(len(ODD)):
        assert [r.token_id for r in sorted((r for r in rel if r.doc_id == i), key=lambda r: (r.seg, r.tok, r.part))] == got[i]
    assert list(t.encode_iterable(["a", "", "the"])) == t.encode_text("a") + t.encode_text("the")
    assert merges.in_order(Q.MERGES) and not merges.in_order([(b"ab", b"c"), (b"a", b"b")])
    bad = tokenizer.Tokenizer({i: bytes([i]) for i in range(256)} | {256: b"abc", 257: b"ab"}, [(b"ab", b"c"), (b"a", b"b")])
    one = spark.createDataFrame([("abc",)], "pretoken string")
    assert bad.words(one).first().word == "<616263>"
    assert Q.book().decode_ids([0xF0, 0x9F]) == "�"


def test_files(spark, tmp_path):
    vocab, m = {0: b"a", 1: b"\xff", 2: b" "}, [(b"a", b"\xff")]
    files.save_tokenizer(spark, str(tmp_path / "t"), vocab, m)
    assert files.load_tokenizer(spark, str(tmp_path / "t")) == (vocab, m)
    (tmp_path / "v.json").write_text('{"0": "a", "1": [255]}')
    (tmp_path / "m.txt").write_text("a b\nbad\n c d \n")
    assert files.read_vocab(str(tmp_path / "v.json")) == {0: b"a", 1: b"\xff"}
    assert files.read_merges(str(tmp_path / "m.txt")) == [(b"a", b"b"), (b"c", b"d")]
    (tmp_path / "b.bin").write_bytes(b"a\xffb")
    assert files.read_bytes_as_text(spark, str(tmp_path / "b.bin")).first().text == "ab"
    (tmp_path / "c.txt").write_text(f"one{T.END} two ")
    assert [r[0] for r in files.read_documents(spark, str(tmp_path / "c.txt")).collect()] == ["one", " two "]
    w = spark.createDataFrame([("w", [2], [1.0, 2.0])], "name string, shape array<int>, data array<double>")
    files.save_checkpoint(str(tmp_path / "k"), w, w, 7)
    a, b, it = files.load_checkpoint(spark, str(tmp_path / "k"))
    assert a.collect() == w.collect() == b.collect() and it == 7
    s = spark.createDataFrame([(1, 5), (0, 65535)], "pos long, token_id int")
    files.write_token_stream(s, str(tmp_path / "s"))
    assert [r[1] for r in spark.read.parquet(str(tmp_path / "s")).orderBy("pos").collect()] == [65535, 5]
    with pytest.raises(Exception):
        files.write_token_stream(s.withColumn("token_id", F.lit(65536)), str(tmp_path / "x"))


def test_offsets_and_ratio(spark):
    s = spark.createDataFrame([(i * 3, i % 4) for i in range(50)], "doc_id long, n_tokens long")
    total = 0
    rows = corpus.stream_offsets(s.union(spark.createDataFrame([(None, 5), (10**15, 2)], s.schema)), blocks=7).orderBy("doc_id").collect()
    assert len(rows) == 52 and rows[0].doc_id is None
    for r in rows:
        assert r.start == total
        total += r.n_tokens
    assert corpus.stream_offsets(s.limit(0)).count() == 0
    empty = spark.createDataFrame([], "n_bytes long, n_tokens long")
    assert corpus.compression_ratio(empty).first().ratio == 0.0


def test_vector_functions(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, -2.0, 0.5],)], "x array<double>")
    x = np.array(df.first().x)
    e = np.exp(x - x.max())
    assert np.allclose(df.select(nn.softmax(F.col("x"))).first()[0], e / e.sum())
    assert np.allclose(df.select(nn.silu(F.col("x"))).first()[0], x / (1 + np.exp(-x)))
    a = df.select(nn.rope(F.col("x"), F.lit(3), 4)).first()[0]
    assert np.allclose(a[:2], [x[0] * math.cos(3) - x[1] * math.sin(3), x[0] * math.sin(3) + x[1] * math.cos(3)])
    with pytest.raises(ValueError):
        nn.rope(F.col("x"), F.lit(0), 3)
    loss = df.select(train.cross_entropy(F.col("x"), F.lit(1))).first()[0]
    assert math.isclose(loss, math.log(np.exp(x - x.max()).sum()) + x.max() - x[1])
    assert nn.feed_forward_size(64) == 192 and nn.feed_forward_size(8) == 64


def test_weights_are_exact(spark):
    w = [[0.1, -1e-300, 1 / 3], [5e-324, -0.0, 1.7976931348623157e308], [math.inf, -math.inf, 12345678901234567890]]
    assert spark.range(1).select(nn.weights(w)).first()[0] == [[float(v) for v in row] for row in w]
    assert math.isnan(spark.range(1).select(nn.weights([math.nan])).first()[0][0])


def test_block_matches_dense(spark):
    d, h, n = 8, 2, 5
    rng = np.random.default_rng(0)
    p = {k: rng.normal(size=(d, d)).round(3) / 3 for k in ("wq", "wk", "wv", "wo", "w1", "w2", "w3")}
    x = rng.normal(size=(n, d))
    s = {"token_embeddings.weight": x, "ln_final.weight": np.ones(d), "lm_head.weight": np.eye(d)}
    s |= {f"layers.0.ln{k}.weight": np.ones(d) for k in (1, 2)} | {f"layers.0.attn.{a}_proj.weight": p["w" + b] for a, b in (("q", "q"), ("k", "k"), ("v", "v"), ("output", "o"))}
    s |= {f"layers.0.ffn.{w}.weight": p[w] for w in ("w1", "w2", "w3")}
    rows = spark.createDataFrame([(0, i, x[i].tolist()) for i in range(n)], "b long, pos long, x array<double>")
    lists = {k: v.tolist() for k, v in p.items()} | {"ln1": [1.0] * d, "ln2": [1.0] * d}
    got = np.array([r.x for r in nn.transformer_block(rows, h, d, lists).orderBy("pos").collect()])
    got = got / np.sqrt((got**2).mean(axis=1, keepdims=True) + 1e-5)
    assert np.allclose(got, nn.lm_forward(np.arange(n), s, 1, h, 10_000.0), atol=1e-8)


def test_training_side(spark):
    stream = spark.createDataFrame([(i, i) for i in range(100)], "pos long, token_id long")
    for r in train.get_batch(stream, 32, 7).collect():
        assert r.x == list(range(r.start, r.start + 7)) and r.y == [v + 1 for v in r.x] and r.start < 93
    rows = spark.createDataFrame([(1.0, 0.5, 0.0, 0.0), (2.0, None, 0.0, 0.0)], "w double, g double, m double, v double")
    a, b = train.adamw_step(rows, 1).collect()
    assert math.isclose(a.w, 1 - 1e-5 - 1e-3 * 0.5 / (0.5 + 1e-8), rel_tol=1e-9) and b.w == 2.0
    g = spark.createDataFrame([(3.0,), (4.0,), (None,)], "g double")
    assert [r.g and round(r.g, 4) for r in train.clip_gradients(g, 1.0).collect()] == [0.6, 0.8, None]


def test_streaming_equals_batch(spark, tmp_path):
    spark.createDataFrame([(1, "the cat"), (2, "and")], "id int, text string").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    q = S.encode_stream(rows, Q.book(), "id").writeStream.format("memory").queryName("ids").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r[0]: r[1] for r in spark.sql("SELECT * FROM ids").collect()}
    assert got == {1: Q.book().encode_text("the cat"), 2: Q.book().encode_text("and")}


def test_running_counts(spark, tmp_path):
    spark.createDataFrame([("the cat the",), ("the",), (None,)], "text string").repartition(2).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.count_stream(rows).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r[0]: r[1] for r in spark.sql("SELECT * FROM counts").collect()} == {"the": 2, " cat": 1, " the": 1}


def test_registry_against_sql(spark):
    """A few registered queries against DuckDB; the driver runs them all."""
    import duckdb

    d = "/root/testdata/sf0.001"
    if not os.path.exists(d):
        pytest.skip("test data absent")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("pretoken_counts", "special_split", "pair_counts", "encode_docs", "compression_by_lang", "rmsnorm", "attention_masked", "adamw_step"):
        f, sql = Q.REGISTRY[name]
        df = f(spark, d)
        want = con.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(want.columns)
        pick = [want.columns.index(c) for c in cols]
        assert sorted(repr(tuple(r[i] for i in pick)) for r in want.fetchall()) == sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()), name


def test_decode_is_one_rule_for_all_sizes(spark):
    """Vocabularies on both sides of the number of merges that run as one expression."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 12))) for _ in range(900)]
    merged = merges.train({w.encode(): 1 + i % 7 for i, w in enumerate(words)}, 513)
    for n in (511, 512, 513):
        t = tokenizer.Tokenizer(dict(enumerate([bytes([i]) for i in range(256)] + [a + b for a, b in merged[:n]])), merged[:n])
        rows = spark.createDataFrame([(w,) for w in words], "pretoken string")
        assert all(r.word == "".join(f"<{s.hex().upper()}>" for s in merges.encode_word(r.pretoken.encode(), t.ranks)) for r in t.words(rows).collect())
        ids = spark.createDataFrame([(1, t.encode_text(" ".join(words))), (2, None), (3, [])], "doc_id int, ids array<int>")
        assert {x.doc_id: x.text for x in t.decode(ids).collect()} == {1: " ".join(words), 2: None, 3: ""}
        for bad in ([97, 99_999, 98], [97, None]):
            with pytest.raises(Exception, match="not in the vocabulary"):
                t.decode(spark.createDataFrame([(1, bad)], "doc_id int, ids array<int>")).collect()
        with pytest.raises(ValueError):
            t.decode_ids([-1])


def test_unknown_symbols_raise_or_give_null(spark):
    t = tokenizer.Tokenizer({i: bytes([i]) for i in range(128)}, [])
    df = spark.createDataFrame([(1, "ab"), (2, "é"), (3, None), (4, "")], "doc_id int, text string")
    assert {r.doc_id: r.ids for r in t.encode(df, unknown="null").collect()} == {1: [97, 98], 2: None, 3: None, 4: []}
    assert sorted((r.doc_id, r.token_id is None) for r in t.encode_relational(df, unknown="null").collect()) == [(1, False), (1, False), (2, True), (2, True)]
    for f in (t.encode, t.encode_relational):
        with pytest.raises(Exception):
            f(df).collect()
    with pytest.raises(ValueError):
        t.encode(df, unknown="skip")


def slow_word(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get((parts[k], parts[k + 1]), 1 << 60), k) for k in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_encode_word_is_the_literal_rule_and_quick():
    import time

    for seed in range(200):
        r = random.Random(seed)
        pool = [bytes([c]) for c in b"abc"]
        ranks = {}
        for i in range(12):
            a, b = r.choice(pool), r.choice(pool)
            ranks.setdefault((a, b), r.randint(0, 8))
            pool.append(a + b)
        word = bytes(r.choices(b"abc", k=r.randint(0, 30)))
        assert merges.encode_word(word, ranks) == slow_word(word, ranks)
    ranks = {(b"a" * 2**k, b"a" * 2**k): k for k in range(10)}
    began = time.process_time()
    assert len(merges.encode_word(b"a" * 2**20, ranks)) == 2**10 and time.process_time() - began < 20


def test_files_in_byte_unicode_form(spark, tmp_path):
    """A vocabulary of the 50k public file, written in its usual two files, gives the library's ids."""
    import json

    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    model = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))
    (tmp_path / "vocab.json").write_text(json.dumps(model["model"]["vocab"]), encoding="utf-8")
    lines = [m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"]]
    (tmp_path / "merges.txt").write_text("#version: 0.2\n" + "\n".join(lines) + "\n", encoding="utf-8")
    t = tokenizer.Tokenizer.from_files(str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt"), [T.END])
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [x for x in ODD] + [" hi", "Ġh", "the the" * 50, T.END * 2 + "a", "\x00\xad\xa0"]
    d = "/root/testdata/sf0.001/documents.parquet"
    if os.path.exists(d):
        texts += [r.text for r in spark.read.parquet(d).collect()]
    got = t.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {r.doc_id: r.ids for r in got} == {i: library.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}
    tiny = {"Ġ": 0, "h": 1, "i": 2, "Ġh": 3, "Ġhi": 4}
    (tmp_path / "v.json").write_text(json.dumps(tiny), encoding="utf-8")
    (tmp_path / "m.txt").write_text("Ġ h\nĠh i\n", encoding="utf-8")
    assert tokenizer.Tokenizer.from_files(str(tmp_path / "v.json"), str(tmp_path / "m.txt")).encode_text(" hi") == [4]


def test_merges_of_one_job_are_the_next_ones(spark, monkeypatch):
    assert training.independent([("61", "62", 9), ("63", "64", 8), ("62", "65", 7)], set(), True) == [("61", "62"), ("63", "64")]
    assert training.independent([("61", "62", 9), ("63", "64", 8), ("65", "61", 8)], set(), True) == [("61", "62")]  # a tie that may change
    assert training.independent([("61", "62", 9), ("63", "64", 8)], set(), False) == [("61", "62")]  # the rest may tie
    assert training.independent([("61", "6263", 9), ("64", "65", 8)], {"616263"}, True) == [("61", "6263")]  # an old symbol grows
    r = random.Random(5)
    counts = {"".join(r.choices("abcdxyz", k=r.randint(1, 8))): r.randint(1, 30) for _ in range(150)}
    rows = spark.createDataFrame(list(counts.items()), "pretoken string, n long").coalesce(1)
    want = literal_train({w.encode(): c for w, c in counts.items()}, 60)
    monkeypatch.setattr(training, "STORE", 3)
    assert training.train_merges(rows, 60, "iterative") == want == training.train_merges(rows, 60)
    with pytest.warns(UserWarning):
        assert training.train_merges(rows, 5, most_bytes=10) == want[:5]


def test_chunks_of_a_file(spark, tmp_path):
    r = random.Random(6)
    data = b"".join(r.choices(["é", "ab", T.END, T.END[:5], "\n"], weights=[5, 5, 1, 2, 1], k=4000)[i].encode() for i in range(4000))
    (tmp_path / "f.txt").write_bytes(data)
    for chunks in (1, 2, 7, 60):
        want = {0, len(data)}
        for i in range(1, chunks):
            at = data.find(T.END.encode(), i * (len(data) // chunks))
            want.add(len(data) if at < 0 else at)
        for block in (1, 16, 1 << 16) if chunks == 7 else (1 << 16,):
            assert files.file_chunks(str(tmp_path / "f.txt"), chunks, T.END, block) == sorted(want)
        parts = files.read_chunks(spark, str(tmp_path / "f.txt"), sorted(want)).orderBy("chunk").collect()
        assert "".join(p.text for p in parts).encode() == data and [p.start for p in parts] + [len(data)] == sorted(want)
    (tmp_path / "none.txt").write_bytes(b"")
    assert files.file_chunks(str(tmp_path / "none.txt"), 4) == [0]


def test_dataset_is_one_stream(spark, tmp_path):
    t = Q.book()
    docs = spark.createDataFrame([(i % 40, f"the cat {i} and") for i in range(60)] + [(7, None), (8, ""), (None, "x")], "doc_id int, text string").repartition(5)
    n = corpus.encode_dataset(docs, t, str(tmp_path / "s"))
    rows = spark.read.parquet(str(tmp_path / "s")).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(n))
    by = {}
    for r in docs.collect():
        by.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r.text or "")
    at, ids = 0, [r.token_id for r in rows]
    for k in sorted(by):
        size = sum(len(t.encode_text(x)) for x in by[k])
        assert sorted(t.decode_ids(ids[at : at + size])) == sorted("".join(by[k]))
        at += size
    assert at == n
    with pytest.raises(Exception):
        corpus.encode_dataset(docs, t, str(tmp_path / "x"), most=100)


def test_training_command(spark, tmp_path, capsys):
    (tmp_path / "c.txt").write_text("low low lower" + T.END + "lowest")
    training.main([str(tmp_path / "c.txt"), "260", str(tmp_path / "t")])
    vocab, m = files.load_tokenizer(spark, str(tmp_path / "t"))
    assert len(vocab) == 260 and len(m) == 3 and "260 entries" in capsys.readouterr().out


def test_states_are_strict():
    s = Q.tiny_state()
    assert set(nn.lm_state(s, 2)) == set(s)
    other = {k.replace("layers.", "transformer_blocks.").replace("output_proj", "o_proj"): v for k, v in s.items()}
    assert all((nn.lm_state(other, 2)[k] == v).all() for k, v in s.items())
    for bad in ({k: v for k, v in s.items() if k != "lm_head.weight"}, s | {"extra.weight": np.zeros(1)}, s | {"layers.0.ffn.w1.weight": np.zeros((3, 3))}, s | {"layers.0.attn.o_proj.weight": s["layers.0.attn.output_proj.weight"]}):
        with pytest.raises(ValueError):
            nn.lm_state(bad, 2)
    b = nn.block_state({k.removeprefix("layers.1."): v for k, v in s.items() if k.startswith("layers.1.")})
    assert set(b) == {"ln1", "ln2", "wq", "wk", "wv", "wo", "w1", "w2", "w3"} and b["w2"].shape == (16, 24)


def test_model_against_loops():
    """The language model against plain loops over numbers."""
    s, ids, heads, d = Q.tiny_state(layers=2), [3, 200, 7, 7], 2, 16
    x = [list(s["token_embeddings.weight"][i]) for i in ids]
    norm = lambda v, w: [a / math.sqrt(sum(q * q for q in v) / len(v) + 1e-5) * b for a, b in zip(v, w)]
    times = lambda w, v: [sum(a * b for a, b in zip(row, v)) for row in w]

    def turned(v, pos):
        out = list(v)
        for k in range(0, len(v), 2):
            a = pos * 10_000.0 ** (-k / len(v))
            out[k], out[k + 1] = v[k] * math.cos(a) - v[k + 1] * math.sin(a), v[k] * math.sin(a) + v[k + 1] * math.cos(a)
        return out

    for i in range(2):
        w = {n: s[f"layers.{i}.{n}"] for n in nn.LAYER}
        y = [norm(v, w["ln1.weight"]) for v in x]
        q, k, v = ([times(w[f"attn.{c}_proj.weight"], r) for r in y] for c in "qkv")
        size = d // heads
        for p in range(len(ids)):
            joined = []
            for h in range(heads):
                part = slice(h * size, h * size + size)
                scores = [math.exp(sum(a * b for a, b in zip(turned(q[p][part], p), turned(k[j][part], j))) / math.sqrt(size)) for j in range(p + 1)]
                joined += [sum(e * v[j][part][c] for j, e in enumerate(scores)) / sum(scores) for c in range(size)]
            x[p] = [a + b for a, b in zip(x[p], times(w["attn.output_proj.weight"], joined))]
        for p in range(len(ids)):
            y = norm(x[p], w["ln2.weight"])
            g = [a / (1 + math.exp(-a)) * b for a, b in zip(times(w["ffn.w1.weight"], y), times(w["ffn.w3.weight"], y))]
            x[p] = [a + b for a, b in zip(x[p], times(w["ffn.w2.weight"], g))]
    want = [times(s["lm_head.weight"], norm(v, s["ln_final.weight"])) for v in x]
    assert np.allclose(nn.lm_forward(np.array(ids), s, 2, heads, 10_000.0), want, atol=1e-9)


def test_attention_in_blocks(spark):
    """Whatever the size of a block, with null groups, masked rows and large scores."""
    rng = np.random.default_rng(2)
    n, d = 23, 4
    q, k, v = (rng.normal(size=(2, n, d)) * s for s in (40, 1, 1))
    rows = [(None if b else 5, i, q[b, i].tolist(), k[b, i].tolist(), v[b, i].tolist()) for b in range(2) for i in range(n)]
    df = spark.createDataFrame(rows, "b int, pos long, q array<double>, k array<double>, v array<double>")
    qs, ks = df.select("b", F.col("pos").alias("q_pos"), "q"), df.select("b", F.col("pos").alias("k_pos"), "k", "v")
    odd = lambda i, j: (i != 4) & ((i + j) % 3 != 0)
    for keep, before in ((nn.causal, False), (nn.causal, True), (odd, False)):
        for keys in (1, 5, 128):
            for r in nn.attention(qs, ks, keep, d, before, keys).collect():
                b, i = 0 if r.b == 5 else 1, r.q_pos
                on = np.array([bool(keep(i, j)) for j in range(n)]) if keep is odd else np.arange(n) <= i
                s = np.where(on, q[b, i] @ k[b].T / 2, -1.7976931348623157e308)
                e = np.exp(s - s.max())
                assert np.allclose(r.o, e @ v[b] / e.sum(), atol=1e-9)


def test_batches_are_uniform(spark):
    stream = spark.createDataFrame([(i, i) for i in range(100)], "pos long, token_id long")
    seen = np.zeros(93)
    for seed in range(4):
        for r in train.get_batch(stream, 8000, 7, seed).select("start").collect():
            seen[r.start] += 1
    mean = 32_000 / 93
    assert (np.abs(seen - mean) < 5 * math.sqrt(mean * (1 - 1 / 93))).all()
    with pytest.raises(ValueError):
        train.get_batch(stream, 1, 100)


def test_adamw_over_many_steps(spark):
    """300 steps on a quadratic, against plain numbers; a plan for each ten."""
    w, m, v = np.array([3.0, -2.0]), np.zeros(2), np.zeros(2)
    rows = spark.createDataFrame([(0, 3.0, 0.0, 0.0), (1, -2.0, 0.0, 0.0)], "i int, w double, m double, v double")
    for t in range(1, 301):
        g = 2 * (w - np.array([1.0, 0.5]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w * (1 - 1e-2 * 0.01) - 1e-2 * math.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8 * math.sqrt(1 - 0.999**t))
    for t in range(1, 301):
        if t % 10 == 1:
            rows = spark.createDataFrame(rows.collect(), "i int, w double, m double, v double")
        rows = rows.select("i", "w", "m", "v", (2 * (F.col("w") - F.when(F.col("i") == 0, 1.0).otherwise(0.5))).alias("g"))
        rows = train.adamw_step(rows, t, lr=1e-2).select("i", "w", "m", "v")
    got = {r.i: r for r in rows.collect()}
    assert np.allclose([got[0].w, got[1].w], w, atol=1e-9) and np.allclose([got[0].v, got[1].v], v)


def test_chunks_of_a_table(spark):
    r = random.Random(9)
    texts = ["".join(r.choices(["ab", "é", T.END, T.END[:4]], k=r.randint(0, 30))) for _ in range(50)]
    df = spark.createDataFrame([*enumerate(texts), (60, None)], "doc_id int, text string").repartition(4)
    whole = T.END.join(texts)
    one = spark.createDataFrame([(whole,)], "text string")
    for chunks in (1, 2, 9, 40):
        want = {0, len(whole)}
        for i in range(1, chunks):
            at = whole.find(T.END, i * (len(whole) // chunks))
            want.add(len(whole) if at < 0 else at)
        assert corpus.table_chunks(df, chunks) == sorted(want) == one.select(corpus.chunk_boundaries(F.col("text"), chunks)).first()[0]
    assert corpus.table_chunks(df.limit(0), 3) == [0]


def test_cuts_keep_pre_tokens():
    r = random.Random(10)
    for _ in range(200):
        t = "".join(r.choices(["a", "bc1", " ", "  ", "\n", "'s", "é", "!", " x", "\u00a0"], k=60))
        for most in (1, 7):
            parts = list(T.cut(t, most))
            assert "".join(parts) == t and [p for x in parts for p in regex.findall(T.PATTERN, x)] == regex.findall(T.PATTERN, t)
