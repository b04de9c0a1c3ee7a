"""Heavy hitters, vocabularies by group, the table function."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtext.functions import sql
from loomtext.operators import frequent, grouped, training
from loomtext.plans import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("size", [4, 16, 64, 100_000])
def test_top_pretokens_are_exact_for_any_table_size(spark, size):
    rng = random.Random(size)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(60)) for _ in range(200)] + [None, "", "tie tie"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = Counter()
    import regex

    from loomtext.functions.text import PATTERN

    for t in texts:
        counts.update(regex.findall(PATTERN, t or ""))
    want = sorted(counts.items(), key=lambda x: (x[1], x[0].encode()), reverse=True)
    for k in (1, 7, 10_000):
        got = [(r.pretoken, r.n) for r in frequent.top_pretokens(docs, k, size=size).collect()]
        assert sorted(got, key=lambda x: (x[1], x[0].encode()), reverse=True) == want[:k]
    assert frequent.top_pretokens(docs.where("false"), 3).collect() == []


def test_a_summary_is_low_by_what_it_took_at_most():
    rng = random.Random(1)
    held, taken, true = Counter(), 0, Counter()
    for _ in range(20_000):
        w = int(rng.paretovariate(0.5)) % 3000
        held[w] += 1
        true[w] += 1
        if len(held) > 50:
            taken += frequent.shrink(held, 50)
    assert taken and all(true[w] - taken <= held[w] <= true[w] for w in true)


def test_vocabularies_by_group_equal_separate_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    for most in (grouped.MOST_BYTES, 8_000):  # the second: some groups by the distributed trainer
        rows = grouped.train(docs, "lang", 262, ["<|endoftext|>"], most=most).collect()
        by = {}
        for r in rows:
            by.setdefault(r.grp, {})[r.token_id] = bytes(r.token)
        for lang in {r.lang for r in docs.select("lang").distinct().collect()}:
            vocab, _ = training.train_bpe(docs.where(F.col("lang").eqNullSafe(F.lit(lang))), 262, ["<|endoftext|>"])
            assert by.pop(lang) == vocab
        assert not by


def test_large_groups_are_trained_on_in_rounds(spark, monkeypatch):
    docs, sizes, real = spark.createDataFrame([("a", "low lower lowest"), ("b", "x y"), ("b", "the then there other")], "lang string, text string"), [], grouped.rounds.train
    monkeypatch.setattr(grouped.rounds, "train", lambda counts, n: sizes.append(counts.count()) or real(counts, n))
    rows = grouped.train(docs, "lang", 260, most=20).collect()
    want, _ = training.train_bpe(docs.where("lang = 'b'"), 260)
    assert sizes == [6] and {r.token_id: bytes(r.token) for r in rows if r.grp == "b"} == want


def test_a_row_a_pretoken_by_joins(spark):
    docs = spark.createDataFrame([(1, "the then<|endoftext|> and"), (2, None)], "doc_id int, text string")
    got = Q.book().met_relational(docs).collect()
    assert [i for r in sorted(got, key=lambda r: (r.seg, r.tok)) for i in [p.token_id for p in r.parts]] == Q.book().encode_text("the then<|endoftext|> and") and len(got) == 4


def test_table_function(spark):
    tok = Q.book()
    sql.register(spark, tok, "tf_")
    docs = spark.createDataFrame([("a", "the then<|endoftext|> and", 1), ("b", None, 2), ("c", "", 3), ("d", "x" * 3000, 4)], "name string, body string, n int")
    got = spark.sql("SELECT * FROM tf_encode_table(TABLE({docs}) PARTITION BY (n), 'name', 'body')", docs=docs)
    assert got.schema.simpleString() == "struct<name:string,pos:bigint,token_id:int>"
    by = {}
    for r in got.collect():
        by.setdefault(r.name, {})[r.pos] = r.token_id
    assert {k: [v[i] for i in range(len(v))] for k, v in by.items()} == {r.name: tok.encode_text(r.body) for r in docs.collect() if r.body}
    texts = spark.sql("SELECT * FROM tf_encode_texts(TABLE({docs}), 'name', 'body')", docs=docs)
    assert texts.schema.simpleString() == "struct<name:string,ids:array<int>>"
    assert {r.name: r.ids for r in texts.collect()} == {r.name: None if r.body is None else tok.encode_text(r.body) for r in docs.collect()}
    numbers = spark.sql("SELECT * FROM tf_encode_table(TABLE({docs}), 'n', 'name')", docs=docs)
    assert dict(numbers.dtypes)["n"] == "int"
    for bad in ("'none', 'body'", "'name', 'n'"):
        with pytest.raises(Exception, match="no column|isn't text"):
            spark.sql(f"SELECT * FROM tf_encode_table(TABLE({{docs}}), {bad})", docs=docs).collect()


def test_queries_agree(spark):
    for new, old in (("top_pretokens_bounded", "top_pretokens"), ("encode_docs_table_function", "encode_docs")):
        a, b = (sorted(map(str, Q.REGISTRY[x][0](spark, SF).collect())) for x in (new, old))
        assert a == b and a


def test_lazy_encoding_holds_little(spark):
    """The ids of a long text are made one by one, in little memory beyond the text's own."""
    import tracemalloc

    text = "the quick brown fox, " * 100_000
    tok = Q.book()
    want = len(tok.encode_text(text))
    tracemalloc.start()
    n = sum(1 for _ in tok.encode_iterable([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == want and peak < 24 << 20
