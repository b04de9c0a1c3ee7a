"""The distributed trainer with its index against the exact trainer."""
import random

import pytest

from loomtext.operators import indexed, merges, training
from loomtext.plans import queries as Q

SF = "/root/testdata/sf0.01"


def counted(spark, counts):
    return spark.createDataFrame(list(counts.items()), "pretoken string, n long").repartition(3)


@pytest.mark.parametrize("few, logged", [(99.0, 0.0), (99.0, 100.0), (0.3, 0.5)])
def test_merges_equal_the_exact_trainer(spark, monkeypatch, few, logged):
    monkeypatch.setattr(indexed, "LOGGED", logged)  # written anew by each job, by none, now and then
    rng = random.Random(int(logged))
    counts = {"".join(rng.choice("aabcé ") for _ in range(rng.randint(1, 12))): rng.randint(1, 9) for _ in range(300)}
    counts |= {"a" * 40: 3, "ab" * 60: 2, "aaa": 5, "x": 9}
    got, jobs = indexed.train(counted(spark, counts), 12, few)
    assert got == merges.train({k.encode(): v for k, v in counts.items()}, 12)
    if few == 99.0:
        assert sum(len(m) for m, _ in jobs) == 12


def test_a_job_rewrites_the_words_that_hold_its_pairs_only(spark):
    counts = {f"w{i:03d}": 1 for i in range(200)} | {"zq": 1_000, "zqzq": 2, "ky": 400, "kyx": 1}
    got, jobs = indexed.train(counted(spark, counts), 2, 1.0)
    assert got == [(b"z", b"q"), (b"k", b"y")] and sum(n for _, n in jobs) == 4
    tables = indexed.Tables(training.words(counted(spark, counts)).selectExpr("monotonically_increasing_id() AS wid", "n", "word"), 16)
    plan = tables.holders([("7A", "71")])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pair" in plan or "PartitionFilters: [(pair" in plan  # only the pair's bucket of the index is read
    assert tables.holders([("7A", "71")]).count() == 2


def test_few_pairs_and_nothing(spark):
    assert indexed.train(counted(spark, {"ab": 1}), 9, 1.0)[0] == [(b"a", b"b")]
    assert indexed.train(counted(spark, {"a": 1}), 9, 1.0)[0] == []
    assert indexed.train(counted(spark, {"ab": 1}).where("false"), 9)[0] == []
    assert indexed.train(counted(spark, {"ab": 1}), 0)[0] == []


def test_vocabulary_equals_the_drivers(spark):
    """(bpe_vocab_500_indexed makes 243 merges and has its SQL.)"""
    docs = Q.read(spark, "/root/testdata/sf0.001", "documents")
    got = training.train_bpe(docs, 340, ["<|endoftext|>"], "indexed")
    assert got == training.train_bpe(docs, 340, ["<|endoftext|>"]) and len(got[1]) == 83
    with pytest.raises(ValueError):
        training.train_merges(training.pretoken_counts(docs), 3, "other")
