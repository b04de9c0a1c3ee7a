"""The trainer in rounds against the exact trainer, with extracts of any size."""
import random

import pytest

from loomtext.operators import merges, rounds, training


def counted(spark, counts):
    return spark.createDataFrame(list(counts.items()), "pretoken string, n long").repartition(3)


@pytest.mark.parametrize("letters, most, look", [("aabc", 1 << 20, 1 << 15), ("aabc é", 200, 1 << 15), ("ab", 60, 12), ("aabcé", 1 << 20, 5)])
def test_merges_equal_the_exact_trainer(spark, letters, most, look):
    r = random.Random(most)
    counts = {"".join(r.choice(letters) for _ in range(r.randint(1, 14))): r.randint(1, 9) for _ in range(300)}
    counts |= {"a" * 40: 3, "ab" * 60: 2, "aaa": 5, "x": 9}
    got, each, words, _ = rounds.train(counted(spark, counts), 25, most, look)
    assert got == merges.train({k.encode(): v for k, v in counts.items()}, 25) and sum(each) == 25
    if most == 1 << 20 and look > 5:
        assert len(each) < 5


def test_a_symbol_made_in_two_ways_ends_a_round(spark):
    counts = {"abc": 50, "zab": 40, "bcy": 45, "abcq": 9, "xbcq": 8, "abq": 7, "bcbc": 6, "abcabc": 5}
    for most in (1 << 20, 12):
        assert rounds.train(counted(spark, counts), 30, most)[0] == merges.train({k.encode(): v for k, v in counts.items()}, 30)


def test_no_words_and_no_pairs(spark):
    assert rounds.train(counted(spark, {"a": 1}), 9)[0] == []
    assert rounds.train(counted(spark, {"ab": 1}).where("false"), 9)[0] == []
    assert rounds.train(counted(spark, {"ab": 1, "cd": 1}), 9, look=1)[0] == [(b"c", b"d"), (b"a", b"b")]


def test_the_driver_holds_an_extract_only(spark, monkeypatch):
    """Words beyond most_bytes don't reach the driver's trainer; what does is MOST symbols at most."""
    r = random.Random(2)
    counts = {"".join(r.choices("abcdxyz", k=r.randint(1, 8))): r.randint(1, 30) for _ in range(400)}
    want, sizes, grown = merges.train({k.encode(): v for k, v in counts.items()}, 30), [], merges.grown
    monkeypatch.setattr(merges, "train", lambda *a: pytest.fail("all words went to the driver"))
    monkeypatch.setattr(merges, "grown", lambda data, *a, **b: sizes.append(len(data)) or grown(data, *a, **b))
    monkeypatch.setattr(rounds, "MOST", 300)
    monkeypatch.setattr(rounds.train, "__defaults__", (300, *rounds.train.__defaults__[1:]))
    with pytest.warns(UserWarning):
        assert training.train_merges(counted(spark, counts), 30, most_bytes=10) == want
    assert 0 < max(sizes) <= 300 < sum(map(len, counts))
