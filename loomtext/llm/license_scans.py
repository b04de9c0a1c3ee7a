"""License scans: ordered signature rules over words, with overlaps resolved.

A text becomes its words, A-Z in lower case, with one space between them. A rule is tried only if the text has one of its keywords as a word,
so nearly all of the rules (license_rules, some 860) are skipped on nearly all texts. What they find is resolved by priority and containment:

* a detection that shares a word with one of a higher priority goes;
* of detections of one priority, one that lies inside another goes, and of equal spans the rule that is stated first stays;
* rules without a label take others away and are not reported;
* places of the base phrases are all counted, and their labels stay, whatever covers them.

score: 1 minus the product of (1 - strength) over the labels found, each by its strongest detection, so 0 without any and at most 1.

Each text is scanned by itself, in Arrow batches bounded in bytes; nothing is shuffled. A text takes a few times its own size in memory, for
the words are never put in a list as a whole.

Edge cases: null and empty texts have no words and score 0; repeated rows and null ids are scanned like others; other columns, of any name and type,
go with their rows, and one called `detections` or `n_words` is replaced; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm import license_rules
from loomtext.llm.common import by_bytes, map_rows, of_row

#: Everything but words becomes a space: bytes 00-2F, 3A-60 (after A-Z has become a-z) and 7B-7F.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
#: Bytes in which keywords are sought at a time.
_SLICE = 1 << 20

_SPAN = pa.struct([("rule", pa.string()), ("label", pa.string()), ("priority", pa.int32()), ("strength", pa.float64()), ("first", pa.int64()), ("last", pa.int64()), ("base", pa.bool_()), ("kept", pa.bool_())])
_SQL = "array<struct<rule:string,label:string,priority:int,strength:double,first:bigint,last:bigint,base:boolean,kept:boolean>>"


def spaced(text: str | None) -> bytes:
    """The words of a text, with one space before and after each; a single space for none."""
    got = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    while b"  " in got:  # halves every run, so few rounds do
        got = got.replace(b"    ", b" ").replace(b"  ", b" ")
    return b" " + got.strip(b" ") + b" " if got.strip(b" ") else b" "


class Scanner:
    """Rules, found by their keywords; each is compiled when it is first tried."""

    def __init__(self, rules: list[license_rules.Rule]):
        self.rules = rules
        self.by_word: dict[bytes, list[int]] = {}
        for i, r in enumerate(rules):
            for k in r.keywords:
                self.by_word.setdefault(k.encode(), []).append(i)
        self.words = frozenset(self.by_word)

    def gated(self, text: bytes) -> list[int]:
        """The rules of which a keyword is a word of the text."""
        present: set[bytes] = set()
        at = 0
        while at < len(text):
            end = text.find(b" ", at + _SLICE)
            end = len(text) if end < 0 else end
            present |= self.words.intersection(text[at:end].split(b" "))
            at = end
        return sorted({i for w in present for i in self.by_word[w]})

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        """Number of words; detections in order of place, with whether each is kept."""
        words = spaced(text)
        spans = [(m.start(), m.end(), i) for i in self.gated(words) for m in license_rules.compiled(self.rules[i].pattern).finditer(words)]
        if not spans:
            return words.count(b" ") - 1, []
        spans.sort()
        numbers, at, n = [], 0, 0
        for start, end, _ in spans:  # words before a place, counted on from the place before
            n += words.count(b" ", at, start)
            at = start
            numbers.append((n, n + words.count(b" ", start, end) - 1))
        rules = [self.rules[i] for *_, i in spans]
        kept = resolve(np.array([a for a, _ in numbers]), np.array([b for _, b in numbers]), np.array([r.priority for r in rules]), np.array([i for *_, i in spans]))
        return words.count(b" ") - 1, [
            {"rule": r.name, "label": r.label, "priority": r.priority, "strength": r.strength, "first": a, "last": b, "base": r.base, "kept": bool(k)}
            for r, (a, b), k in zip(rules, numbers, kept, strict=True)
        ]


def resolve(first: np.ndarray, last: np.ndarray, priority: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which of the spans [first, last] stay. order: the rules' order. n log n steps for each priority."""
    keep = np.ones(len(first), dtype=bool)
    for p in np.unique(priority):
        own = np.flatnonzero(priority == p)
        above = priority < p
        if above.any():  # shares a word with a span of a higher priority: one that begins at or before its end and ends at or after its start
            i = np.flatnonzero(above)
            i = i[np.argsort(first[i], kind="stable")]
            reach = np.maximum.accumulate(last[i])
            met = np.searchsorted(first[i], last[own], "right") - 1
            keep[own] &= ~((met >= 0) & (reach[np.maximum(met, 0)] >= first[own]))
        i = own[np.lexsort((order[own], -last[own], first[own]))]  # a span can only lie inside one before it
        reach = np.concatenate([[-1], np.maximum.accumulate(last[i])[:-1]])
        keep[i] &= last[i] > reach
    return keep


def scan(docs: DataFrame, rules: list[license_rules.Rule] | None = None, text: str = "text") -> DataFrame:
    """docs with n_words and detections: (rule, label, priority, strength, first, last, base, kept), first and last being words counted from 0."""
    rules = license_rules.rules() if rules is None else rules

    def run(batches):
        scanner = Scanner(rules)
        for b in by_bytes(batches, of_row(text)):
            row = b.column("row")
            got = [scanner.scan(t) for t in row.field(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([row, pa.array([n for n, _ in got], pa.int64()), pa.array([d for _, d in got], pa.list_(_SPAN))], names=["row", "n_words", "detections"])

    return map_rows(docs, run, "n_words long", f"detections {_SQL}")


def labels(found: Column) -> Column:
    """The distinct labels of detections, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")


def score(found: Column) -> Column:
    """1 - product of (1 - strength) over labels, each by its strongest detection."""
    names = F.array_distinct(F.transform(found, lambda d: d["label"]))
    best = F.transform(names, lambda n: F.array_max(F.transform(F.filter(found, lambda d: d["label"] == n), lambda d: d["strength"])))
    return 1 - F.aggregate(best, F.lit(1.0), lambda a, s: a * (1 - s))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_kept."""
    rows = scan(docs.select("doc_id", "text"))
    base = F.filter("detections", lambda d: d["base"])
    kept = F.filter("detections", lambda d: (d["kept"] | d["base"]) & (d["label"] != ""))
    rows = rows.select("doc_id", "n_words", base.alias("base"), kept.alias("kept"))
    start = F.transform("base", lambda d: d["first"])
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("kept")).alias("labels"), score(F.col("kept")).alias("score"), F.size("kept").alias("n_kept"),
    )
