"""License scans against a program that tries every rule and compares every pair of detections."""
import functools
import random
import re

import pytest

from loomtext.llm import license_rules, license_scans, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


pattern = functools.cache(lambda p: re.compile(f" (?:{p})(?= )"))


def plain(text, rules):
    """Words as a list, every rule at every place, every pair of detections."""
    words = WORD.findall(lower(text))
    joined = "".join(f" {w}" for w in words) + " "
    found = []
    for i, r in enumerate(rules):
        for m in pattern(r.pattern).finditer(joined):
            first = joined[: m.start()].count(" ")
            found.append((first, first + m.group().count(" ") - 1, i, r))
    keep = []
    for a, b, i, r in found:
        higher = any(y.priority < r.priority and c <= b and d >= a for c, d, _, y in found)
        inside = any(y.priority == r.priority and c <= a and d >= b and (c, d, j) != (a, b, i) and ((c, d) != (a, b) or j < i) for c, d, j, y in found)
        keep.append((a, b, r.name, not higher and not inside))
    return len(words), sorted(keep)


def test_scanner_equals_the_plain_program():
    rules = license_rules.rules()
    scanner = license_scans.Scanner(rules)
    rng = random.Random(5)
    bits = ["Licensed under the", "Apache License, Version 2.0", "MIT license plates", "not", "is", "GPL-2.0-or-later", "all rights reserved", "CC BY-SA 4.0", "cc by", "GNU General Public License, version 3",
            "or any later version", "é", "word", "…", "SPDX-License-Identifier:", "in the public domain", "BSD style license", "ÀB", "LGPLv2.1", "copyright 2004", "creative commons attribution sharealike 3.0"]
    for _ in range(60):
        text = " ".join(rng.choice(bits) for _ in range(rng.randrange(0, 14)))
        n, got = scanner.scan(text)
        assert (n, sorted((d["first"], d["last"], d["rule"], d["kept"]) for d in got)) == plain(text, rules), text
    assert len(rules) > 300


def example(tree, rng) -> str:
    """A text that a parsed expression matches."""
    out = []
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out.append(chr(arg))
        elif op == "NOT_LITERAL":
            out.append("x")
        elif op == "IN":
            lo = next((v for k, v in arg if str(k) in ("LITERAL", "RANGE")), None)
            out.append("x" if str(arg[0][0]) == "NEGATE" else chr(lo if isinstance(lo, int) else lo[0]))
        elif op == "SUBPATTERN":
            out.append(example(arg[-1], rng))
        elif op == "BRANCH":
            out.append(example(rng.choice(arg[1]), rng))
        elif op == "MAX_REPEAT":
            out.append("".join(example(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[0] + 1, arg[1])))))
        else:
            raise AssertionError(op)
    return "".join(out)


def test_no_rule_is_lost_through_its_keywords():
    rules = license_rules.rules()
    scanner = license_scans.Scanner(rules)
    rng = random.Random(1)
    for i, r in enumerate(rules):
        for _ in range(12):
            text = example(re._parser.parse(r.pattern), rng)
            assert license_rules.compiled(r.pattern).search(license_scans.spaced(text)), (r.name, text)
            assert i in scanner.gated(license_scans.spaced(text)), (r.name, text)


def test_names_and_spans():
    scanner = license_scans.Scanner(license_rules.rules())
    kept = lambda t: [(d["label"], d["first"], d["last"]) for d in scanner.scan(t)[1] if d["kept"]]
    assert kept("Licensed under the Apache License, Version 2.0.") == [("apache-2.0", 0, 7)]
    assert kept("under the GNU General Public License version 2 of the License, or (at your option) any later version.")[0][0] == "gpl-2.0"
    assert kept("Licensed under the GNU General Public License version 2 or any later version") == [("gpl-2.0-or-later", 0, 12)]
    assert kept("It was not released under the MIT license") == [("", 1, 7)]
    assert kept("MIT license plates") == [("", 0, 2)]


def test_edges(spark):
    long = "word, " * 300_000 + "All Rights Reserved; cc by\tcc  by"
    rows = [(1, None), (2, ""), (3, "CC-BY"), (3, "CC-BY"), (None, "general public licenseé"), (4, long), (5, "!!! ***")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, `row` string, n_words int")
    got = license_scans.report(docs).collect()
    by = {(r.doc_id): r for r in got}
    assert len(got) == 7
    assert (by[1].n_words, by[1].n_base, by[1].first_word, by[1].base_labels, by[1].labels, by[1].score) == (0, 0, None, "", "", 0.0)
    assert by[2].n_words == by[5].n_words == 0
    assert (by[3].n_words, by[3].n_base, by[3].labels) == (2, 1, "cc-by")
    assert by[None].n_base == 0
    assert (by[4].n_words, by[4].n_base, by[4].first_word, by[4].last_word, by[4].base_labels) == (300_007, 3, 300_000, 300_005, "cc-by,reserved")
    whole = license_scans.scan(docs)
    assert whole.columns == ["doc_id", "text", "row", "n_words", "detections"]
    assert license_scans.report(docs.where("false")).collect() == []


def test_query_equals_the_plain_program(spark):
    rules = license_rules.rules()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_license_scans(spark, SF).collect()}
    assert got.keys() == docs.keys()
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    some = 0
    for i, text in docs.items():
        words = WORD.findall(lower(text))
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        if places:
            some += 1
            by_name = {x.name: x for x in rules}
            kept = [by_name[n] for _, _, n, k in plain(text, rules)[1] if k or by_name[n].base]
            assert r.labels == ",".join(sorted({x.label for x in kept} - {""}))
            left = 1.0
            for label in {x.label for x in kept} - {""}:
                left *= 1 - max(x.strength for x in kept if x.label == label)
            assert r.score == pytest.approx(1 - left)
    assert some > 5
