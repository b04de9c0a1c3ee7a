"""Columns of any name, sizes of tables, one scan, prefix sums."""
import math
import re
import time

import pytest
from pyspark.sql import functions as F

from loomtext.functions import nn, train
from loomtext.operators import corpus
from loomtext.operators.tokenizer import Tokenizer
from loomtext.plans import queries as Q
from loomtext.sources import files

SF = "/root/testdata/sf0.01"
ODD = ["_block", "_in", "_head", "_sum", "_top", "_by0", "_norm", "m2", "v2", "row", "key", "block", "in", "head", "sum", "top", "norm", "group", "x", "a.b", "n"]


def odd(df):
    return df.select("*", *(F.lit(f"mine {c}").alias(c) for c in ODD if c not in df.columns))


def untouched(got):
    own = [c for c in ODD if c in got.columns]
    assert len(own) >= len(ODD) - 3
    for r in got.collect():
        assert all(r[c] == f"mine {c}" for c in own if c not in ("n", "x", "g"))


def test_operators_keep_columns_of_any_name(spark):
    sizes = odd(spark.createDataFrame([(i, i % 7) for i in range(50)], "doc_id long, n_tokens long"))
    got = corpus.stream_offsets(sizes)
    assert got.columns == [*sizes.columns, "start"]
    untouched(got)
    rows = {r.doc_id: (r.n_tokens, r.start) for r in got.collect()}
    assert all(rows[i][1] == sum(rows[j][0] for j in range(i)) for i in rows)
    rows = odd(spark.createDataFrame([(i, i % 3, float(i)) for i in range(12)], "i int, b int, value double"))
    soft = nn.softmax_over(rows, "value", "b")
    assert soft.columns == rows.columns
    untouched(soft)
    by = {}
    for r in soft.collect():
        by[r.b] = by.get(r.b, 0) + r.value
    assert all(math.isclose(v, 1) for v in by.values()) and len(by) == 3
    assert math.isclose(sum(r.value for r in nn.softmax_over(rows, "value").collect()), 1)
    grads = odd(spark.createDataFrame([(i, float(i)) for i in range(5)] + [(9, None)], "i int, g double"))
    clipped = train.clip_gradients(grads, 1.0)
    untouched(clipped)
    assert math.isclose(sum(r.g**2 for r in clipped.collect() if r.g is not None), 1, rel_tol=1e-5) and clipped.columns == grads.columns
    state = odd(spark.createDataFrame([(1.0, 0.5, 0.0, 0.0), (2.0, None, 0.25, 0.5)], "w double, g double, m double, v double"))
    step = train.adamw_step(state, 1)
    untouched(step)
    a, b = step.orderBy("w").collect()
    assert step.columns == state.columns and math.isclose(a.m, 0.05) and math.isclose(a.v, 0.00025) and (b.w, b.m, b.v) == (2.0, 0.25, 0.5)
    assert math.isclose(a.w, 1 - 1e-5 - 1e-3 * math.sqrt(1 - 0.999) / 0.1 * 0.05 / (math.sqrt(0.00025) + 1e-8 * math.sqrt(0.001)))


def test_small_tables_only_are_dealt_out(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    path = str(tmp_path / "t")
    assert files.read_table(spark, path).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(files, "SMALL", 100)
    assert files.read_table(spark, path).rdd.getNumPartitions() == 1 and files.size_of(spark.read.parquet(path)) > 100


def test_relational_encoding_reads_the_texts_once(spark):
    docs, tok = spark.read.parquet(f"{SF}/documents.parquet"), Q.book()
    whole = {r.doc_id: r.ids for r in tok.encode(docs).collect()}
    for most in (96 << 20, 0):
        got = tok.encode_relational(docs, most=most, frequent=50)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("(?U)") == 1 and len(re.findall(r"Relation \[doc_id", plan)) == 1
        order = F.array_sort(F.collect_list(F.struct("seg", "tok", "part", "token_id")))
        by = {r.doc_id: r.ids for r in got.groupBy("doc_id").agg(F.transform(order, lambda t: t["token_id"]).alias("ids")).collect()}
        assert by == {k: v for k, v in whole.items() if v}


def _ids(rows):
    return {r.doc_id: r.ids for r in rows.collect()}


def test_encoding_by_columns_equals_encoding_in_python(spark):
    end = "<|endoftext|>"
    odd = ["", " ", "\x00", "\x00\x00 a\x00", "ÿþ ÿ þ0þ1", "\ufffd\ue000\uffff", "😀 the\u2003then\u0085", "th" + end + "e", end * 2 + end + "1" + end + " the", "aaaa  and\n\n the", "e" + end + "0", None]
    specials = [end, end * 2, *(f"[{i}]" for i in range(10))]  # the marks of the first are the beginning of those of the last
    odd.append("".join(specials[::-1]) + "0 [1]1[12]")
    docs = spark.createDataFrame([*enumerate(odd)], "doc_id int, text string")
    every = [bytes([i]) for i in range(256)]
    lists = [Q.MERGES, [], [(b"a", b"a"), (b"aa", b"aa")], [(b"\xff", b"a"), (b"a", b"\xff"), (b"\xfe", b"0"), (b"no", b"t"), (b" ", b"t"), (b"\x00", b"\x00"), (b"\xc3", b"\xbf")], [(b"ab", b"c"), (b"a", b"b"), (b"a", b"n")]]
    for merges in lists:
        for special in (specials, []):
            tok = Tokenizer(dict(enumerate([*every[::-1], *{a + b: 0 for a, b in merges}])), merges, special)
            want = _ids(tok.encode(docs))
            assert _ids(tok.encode_columns(docs)) == want and _ids(tok.encode_joined(docs, size=40)) == want
    ascii_only = Tokenizer({i: bytes([i]) for i in range(128)}, [])
    some = docs.where("doc_id in (0, 1, 6, 9, 11)")
    want = _ids(ascii_only.encode(some, unknown="null"))
    assert want[6] is None and want[9]
    for f in (ascii_only.encode_columns, ascii_only.encode_joined):
        assert _ids(f(some, unknown="null")) == want
        with pytest.raises(Exception, match="symbol not in the vocabulary"):
            f(some).collect()
        with pytest.raises(ValueError):
            f(some, unknown="skip")


def test_no_row_a_pretoken_is_shuffled_for_the_ids_of_texts(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "the then" * 50), (2, ""), (3, None), (None, "and")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = Q.encode_docs_relational(spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Join|Aggregate|Generate|InArrow|hashpartitioning", plan)
    rows, want = {r.doc_id: (r.n_tokens, r.digest) for r in got.collect()}, {r.doc_id: (r.n_tokens, r.digest) for r in Q.encode_docs(spark, folder).collect()}
    assert rows == {**want, None: want[2]} and rows[2][0] == rows[3][0] == 0 < rows[1][0]
    docs = spark.createDataFrame([(i, "the then and") for i in range(20)], "doc_id long, text string")
    joined = Q.book().encode_joined(docs)
    assert joined.count() == 20
    exchanges = re.findall(r"Exchange (\w+)", joined._jdf.queryExecution().executedPlan().toString())
    assert set(exchanges) <= {"shufflepartitionidpassthrough"} | {"HashedRelationBroadcastMode"}


def test_prefix_sums_over_segments(spark):
    rows = spark.createDataFrame([(g, i, (i * 7 + g) % 5) for g in (1, 2) for i in range(100 * g)], "g int, i int, v int")
    for segment in (1, 7, 4096):
        got = {(r.g, r.i): r.upto for r in corpus.prefix_sums(rows, "g", "i", "v", segment).collect()}
        assert got == {(g, i): sum((j * 7 + g) % 5 for j in range(i + 1)) for g in (1, 2) for i in range(100 * g)}


def test_a_million_delimiters_in_one_text(spark):
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.repeat(F.lit("ab|"), 1_000_000)).otherwise("tail|end").alias("text"))
    began = time.time()
    assert corpus.table_chunks(docs, 3, "|") == [0, 1000004, 2000006, 3000009]
    assert time.time() - began < 90


def test_chunks_of_tables_equal_those_of_the_joined_text(spark):
    texts = ["a|b||", "", None, "|", "ccc|dd", "e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    joined = "|".join(t for t in texts if t is not None)
    for n in (1, 2, 3, 7):
        (want,) = spark.range(1).select(corpus.chunk_boundaries(F.lit(joined), n, "|")).first()
        assert corpus.table_chunks(docs, n, "|") == want


def test_decode_in_bounded_batches(spark):
    tok = Tokenizer({i: bytes([i]) for i in range(256)}, [])
    rows = spark.createDataFrame([(1, [65] * 300_000), (2, None), (3, []), (4, [66] * 300_000)], "doc_id int, ids array<int>").coalesce(1)
    assert {r.doc_id: r.text for r in tok.decode(rows).collect()} == {1: "A" * 300_000, 2: None, 3: "", 4: "B" * 300_000}
    with pytest.raises(Exception):
        tok.decode(spark.createDataFrame([(1, [999])], "doc_id int, ids array<int>")).collect()
