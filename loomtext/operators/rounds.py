"""BPE training on words that stay distributed, in few rounds, with a bounded extract of them on the driver.

A round counts all pairs and takes the most frequent ones, all those with a count of `least` or more. Words are cut wherever two neighbours are none of these
pairs; what is left, distinct runs of symbols with their counts, is the extract. Each place where a pair will stand later is a place where one stands now, at the
border of its two symbols, and so are the places inside them. So, as long as no symbol is made in two ways, a pair with a count of `least` or more, now or
after any merges, lies wholly in the extract, with its full count; and all others stay below. The merges that the exact trainer (merges.grown) finds in the extract,
down to `least`, are therefore the merges of all words, ties included. A merge whose symbol exists already ends the round, as it may add pairs up.
The words are then rewritten by their tasks, and the next round takes pairs of lower counts.

The extract is held to `most` symbols: where it is larger, half of the pairs are kept, and it is cut further. Words are arrays of symbol numbers of 32 bits.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators import merges as M
from loomtext.sources import files

#: Symbols of an extract, which take some 60 bytes of the driver's memory each, and pairs that a round looks at.
MOST, LOOK = 1 << 20, 1 << 15
#: Symbols that a task takes at once.
BLOCK = 1 << 21
_WORDS = "word binary, n long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, words' lengths, words' counts) of about BLOCK symbols."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            data, length = _flat(b.column(0))
            held.append((data.view("<i4"), length // 4, b.column(1).to_numpy()))
            size += len(held[-1][0])
        if size >= BLOCK:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column without nulls, and the values' lengths."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], np.diff(at).astype(np.int64)


def _words(symbols: np.ndarray, length: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    at = np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(symbols, "<i4"))])
    return pa.record_batch([column, pa.array(n, pa.int64())], names=["word", "n"])


def _codes(symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair that begins at each symbol but the last, as one number, and whether both are of one word."""
    return symbols[:-1].astype(np.int64) << 32 | symbols[1:], word[:-1] == word[1:]


def _found(sought: np.ndarray, codes: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each code is among the sorted ones, and its place there."""
    at = np.minimum(np.searchsorted(sought, codes), len(sought) - 1)
    return valid & (sought[at] == codes), at


def spelled(counts: DataFrame) -> DataFrame:
    """(word, n) of counted pre-tokens (pretoken, n): a symbol for each byte. Words of one byte are left out, as they have no pair."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                data, length = _flat(b.column(0))
                yield _words(data.astype("<i4"), length, b.column(1).to_numpy())

    return counts.where("octet_length(pretoken) > 1").select("pretoken", F.col("n").cast("long")).mapInArrow(run, _WORDS)


def pair_counts(words: DataFrame) -> DataFrame:
    """(code, c, places): pairs with their counts, and the number of their places in distinct words."""

    def run(batches):
        for symbols, length, n in _blocks(batches):
            word = np.repeat(np.arange(len(length)), length)
            codes, valid = _codes(symbols, word)
            code, back = np.unique(codes[valid], return_inverse=True)
            c = np.zeros(len(code), np.int64)
            np.add.at(c, back, n[word[:-1][valid]])
            yield pa.record_batch([pa.array(code), pa.array(c), pa.array(np.bincount(back, minlength=len(code)).astype(np.int64))], names=["code", "c", "places"])

    return words.mapInArrow(run, "code long, c long, places long").groupBy("code").agg(F.sum("c").alias("c"), F.sum("places").alias("places"))


def extract(words: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(word, n): the distinct runs of symbols in which all neighbours are among the pairs (codes, sorted), with their counts."""
    shared = words.sparkSession.sparkContext.broadcast(pairs)  # LOOK at most

    def run(batches):
        for symbols, length, n in _blocks(batches):
            word = np.repeat(np.arange(len(length)), length)
            hit, _ = _found(shared.value, *_codes(symbols, word))
            after, before = np.append(hit, False), np.append(False, hit)
            kept = after | before
            first = np.flatnonzero((after & ~before)[kept])
            if not len(first):
                continue
            size = np.diff(np.append(first, kept.sum()))
            got = pa.Table.from_batches([_words(symbols[kept], size, n[word[kept][first]])])
            yield from got.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks().to_batches()

    return words.mapInArrow(run, _WORDS).groupBy("word").agg(F.sum("n").alias("n"))


def rewritten(words: DataFrame, steps: list[list[tuple[int, int, int]]]) -> DataFrame:
    """words after merges (left, right, new symbol), in steps. Those of one step are in order (merges.in_order), so that in each word the lowest one that it holds
    is made until it holds none. Words of one symbol are left out."""
    shared = words.sparkSession.sparkContext.broadcast(steps)  # bounded by the vocabulary

    def run(batches):
        ready = []
        for step in shared.value:
            code = np.array([a << 32 | b for a, b, _ in step], np.int64)
            order = np.argsort(code)
            ready.append((code[order], order, np.array([x for *_, x in step], np.int32)))
        for block in _blocks(batches):
            parts = [block]
            for step in ready:
                parts = [x for p in parts for x in _merged(*p, *step)]
            for symbols, length, n in parts:
                yield _words(symbols[np.repeat(length > 1, length)], length[length > 1], n[length > 1])

    return words.mapInArrow(run, _WORDS)


def _merged(symbols: np.ndarray, length: np.ndarray, n: np.ndarray, sought: np.ndarray, rank: np.ndarray, new: np.ndarray) -> list[tuple]:
    """Words after one step, those that are done first."""
    out, none = [], len(rank)
    while len(length):
        word = np.repeat(np.arange(len(length)), length)
        hit, at = _found(sought, *_codes(symbols, word))
        ranks = np.append(np.where(hit, rank[at], none), none)
        lowest = np.minimum.reduceat(ranks, np.cumsum(length) - length)
        going = lowest < none
        mine = going[word]
        out.append((symbols[~mine], length[~going], n[~going]))
        symbols, word, ranks, low = symbols[mine], word[mine], ranks[mine], lowest[word[mine]]
        length, n = length[going], n[going]
        if not len(length):
            break
        i = np.flatnonzero(ranks == low)
        begins = np.append(True, np.diff(i) > 1)  # every second one of a run
        k = np.arange(len(i))
        i = i[(k - np.maximum.accumulate(np.where(begins, k, 0))) % 2 == 0]
        symbols[i] = new[low[i]]
        place = np.repeat(np.arange(len(length)), length)
        length = length - np.bincount(place[i], minlength=len(length))
        symbols = np.delete(symbols, i + 1)
    return out


class Words:
    """A stored table of words, which replaces the one before it."""

    def __init__(self, rows: DataFrame):
        self.spark, self.folder = rows.sparkSession, None
        self.put(rows)

    def put(self, rows: DataFrame) -> None:
        folder = files.scratch(self.spark, "round")
        rows.write.option("compression", "zstd").parquet(folder)
        if self.folder:
            files.remove(self.spark, self.folder)
        self.folder, self.rows = folder, self.spark.read.schema(_WORDS).parquet(folder)

    def symbols(self) -> int:
        return self.rows.agg(F.sum(F.octet_length("word"))).first()[0] // 4 if self.rows.take(1) else 0


def _largest(pairs: DataFrame, names: list[bytes], c: int) -> int:
    """Of the pairs with count c the code of the greatest in byte order; only used where more than LOOK tie."""
    known = F.broadcast(pairs.sparkSession.createDataFrame(list(enumerate(names)), "id int, name binary"))
    rows = pairs.where(F.col("c") == c).select("code", F.shiftright("code", 32).cast("int").alias("l"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("r"))
    rows = rows.join(known.toDF("l", "left"), "l").join(known.toDF("r", "right"), "r")
    return rows.orderBy(F.desc("left"), F.desc("right")).select("code").first()[0]


def train(counts: DataFrame, n: int, most: int = MOST, look: int = LOOK, enough: Callable[[int], bool] | None = None) -> tuple[list[tuple[bytes, bytes]], list[int], Words, list[bytes]]:
    """Up to n merges of counted pre-tokens; of each round the number of its merges; the words as they are then, and the names of their symbols.

    enough: a function of the number of distinct words' places that hold the next pair; training ends when it is true.
    """
    names = [bytes([i]) for i in range(256)]
    out: list[tuple[bytes, bytes]] = []
    rounds: list[int] = []
    words, take = Words(spelled(counts)), look
    while len(out) < n:
        pairs = pair_counts(words.rows)
        top = pairs.orderBy(F.desc("c")).limit(look + 1).toArrow()
        code, c, places = (top.column(i).to_numpy() for i in range(3))
        if not len(code) or enough and enough(int(places[0])):
            break
        if not rounds:  # an extract has two symbols for each of its pairs' places at most, and far fewer as it holds each run once
            take = max(64, int(np.searchsorted(np.cumsum(places), 8 * most)))
        got, take = _round(words.rows, pairs, code, c, names, n - len(out), most, look, take)
        number = {s: i for i, s in enumerate(names)}
        step: list[tuple[int, int, int]] = []
        steps = [step]
        for a, b in got:
            if a + b in number:  # the last one
                step = []
                steps.append(step)
            else:
                number[a + b] = len(names)
                names.append(a + b)
            step.append((number[a], number[b], number[a + b]))
        out += got
        rounds.append(len(got))
        if len(out) < n or enough:
            words.put(rewritten(words.rows, [s for s in steps if s]))
    return out, rounds, words, names


def _round(words: DataFrame, pairs: DataFrame, code: np.ndarray, c: np.ndarray, names: list[bytes], n: int, most: int, look: int, take: int) -> tuple[list[tuple[bytes, bytes]], int]:
    """The merges of a round, one at least, and how many pairs the next one may begin with."""
    if len(code) > look and c[0] == c[-1]:
        x = _largest(pairs, names, int(c[0]))
        return [(names[x >> 32], names[x & 0xFFFFFFFF])], take
    least = 1 if len(code) <= look else int(c[-1]) + 1
    rows = held = None
    while True:
        if take < (c >= least).sum():
            least = max(least, int(c[take - 1]))  # with all that tie with the last one
            if (c >= least).sum() > take and c[0] > least:
                least += 1
        chosen = code[c >= least]
        if len(chosen) == 1:
            break
        held = Words(extract(words if rows is None else rows, np.sort(chosen))) if held is None else held
        if rows is not None:
            held.put(extract(rows, np.sort(chosen)))
        rows = held.rows
        if held.symbols() <= most:
            break
        if c[0] == least:  # nothing to halve: all tie
            best = max(chosen.tolist(), key=lambda x: (names[x >> 32], names[x & 0xFFFFFFFF]))
            return [(names[best >> 32], names[best & 0xFFFFFFFF])], look
        take = max(1, len(chosen) // 2)
    if len(chosen) == 1:
        x = int(chosen[0])
        return [(names[x >> 32], names[x & 0xFFFFFFFF])], 64
    got = rows.toArrow().combine_chunks()
    files.remove(words.sparkSession, held.folder)
    data, length = _flat(got.column(0).combine_chunks() if isinstance(got.column(0), pa.ChunkedArray) else got.column(0))
    found = M.grown(data.view("<i4"), length // 4, got.column(1).to_numpy(), names, n, least, once=True)
    return found, min(look, 2 * len(chosen))
