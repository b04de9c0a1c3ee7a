"""The ten operators on edge cases and against brute force."""
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import bpe, common, hashing, jaccard, mixing, neardup, quality, queries, token_counts, topk, toxicity, training_order, warc

PATH = queries.vocabulary_path()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _copies int"  # two clashing names


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(n))


def rows():
    base = [words(60, i) for i in range(8)]
    near = base[0].split()
    near[10] = "changed"
    texts = [None, "", "   \n\t ", "one", "one two three", *base, " ".join(near), base[1], base[1], base[2].upper(), "🙂 héllo <|endoftext|> ñ\x1c x", words(20_000, 99), "a" * 30_000]
    out = [(i, t, "en" if i % 2 else None, [None, "b", "a"][i % 3], None if i % 5 == 0 else len(t or ""), "x", 1) for i, t in enumerate(texts)]
    return [*out, out[6], (None, "no id", None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    r = [(i, i % 2, int(i % 3 == 0)) for i in range(24)]
    return spark.createDataFrame([*r, (None, 1, 1), (3, None, None), (4, 7, 7)], "doc_id long, quality int, toxic int")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_hashing_is_stable_and_by_word():
    h, at, size = hashing.words(["The cat", None, "cat", "x y  É"], "space")
    assert h[1] == h[2] and at.tolist() == [0, 2, 2, 3, 5] and size.tolist() == [3, 3, 3, 4, 2]
    g, gat = hashing.shingles(*hashing.words(["a b c d e f", "b c d e f", "b c", ""])[:2])
    assert gat.tolist() == [0, 2, 3, 4, 4] and g[1] == g[2]


def test_connected_components(spark):
    r = random.Random(1)
    e = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)] + [(5, 5), (None, 3)]
    got = {x[0]: x[1] for x in common.connected_components(spark.createDataFrame(e, "u long, v long")).collect()}
    low = {}
    for a, b in e:
        if a is not None and a != b:
            low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(100):
        for a, b in e:
            if a is not None and a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1, 5
def test_quality_edges(spark, docs, labels):
    m = quality.train(docs, labels)
    got = quality.score(docs, m).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len({r.score for r in got if r.doc_id == 6}) == 1
    kept = quality.filter_quality(docs, m)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score(empty(spark), m).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert len({r.score for r in quality.score(docs, none).collect()}) == 1


def test_quality_identity_and_accuracy():
    r = random.Random(3)
    data = []
    for i in range(600):
        w = [("the" if r.random() < 0.3 else "w" + str(r.randint(0, 40))) + ("!!" if i % 3 == 0 else "") for _ in range(40)]
        data.append((" ".join(w), None, int(i % 3 > 0)))
    m = quality.fit(data[:400])
    s = m.score([d[0] for d in data[400:]], [None] * 200)
    assert ((s >= 0.3) == np.array([d[2] for d in data[400:]])).mean() > 0.97
    doc, feature, value = m.inputs([data[0][0]], [None])
    pairs = sum(m.v[feature[i]] @ m.v[feature[j]] * value[i] * value[j] for i in range(len(feature)) for j in range(i))
    assert math.isclose(m.w0 + m.w[feature] @ value + pairs, m.logits(doc, feature, value, 1)[0][0], abs_tol=1e-9)


def test_toxicity(spark, docs, labels):
    r = random.Random(4)
    data = []
    for i in range(900):
        w = ["w" + str(r.randint(0, 300)) for _ in range(r.choice([10, 40, 400]))]
        if i % 8 == 0:
            for _ in range(r.randint(1, 5)):
                w[r.randrange(len(w))] = r.choice(["nasty", "Rotten,", "vilest" + str(r.randint(0, 99))])
        data.append((" ".join(w), int(i % 8 == 0)))
    m = toxicity.fit(data[:600])
    p = m.probabilities([d[0] for d in data[600:]])
    y = np.array([d[1] for d in data[600:]])
    assert (np.diff(p, axis=1) <= 0).all() and ((p[:, 0] >= m.threshold) == y).mean() > 0.98
    m = toxicity.train(docs, labels)
    got = toxicity.score(docs, m).collect()
    assert len(got) == len(rows()) and all(0 <= x.severity <= 3 for x in got)
    assert toxicity.filter_clean(docs, m).columns == docs.columns and toxicity.score(empty(spark), m).count() == 0


# 2
def test_warc(spark, tmp_path):
    page = '<html lang="en"><head><title>T &amp; t</title><style>p{}</style></head><body><p>One<br>two <b>three</b> &lt;x&gt;</p><a href="/a?b=1&amp;c">l</a><script>var p="</p>"</script><!-- no -->end'
    pages = spark.createDataFrame([(1, "http://e.com/x", page, 5), (2, None, None, 5), (3, "http://e.com", "", 5), (3, "http://e.com", "", 5), (4, "http://[bad", '<a href="//[">x', 5)], "page_id long, url string, html string, block int")
    resp = warc.responses_of(pages)
    got = warc.derivatives(resp, keep=("page_id",)).collect()
    assert len(got) == 10
    source = {r.page_id: r for r in resp.collect()}
    for r in got:
        assert r.refers_to == source[r.page_id].record_id and r.source_headers == source[r.page_id].http_headers
        assert r.block_digest == warc.digest(r.block.encode()) and r.source_digest == warc.digest((source[r.page_id].payload or "").encode())
    conv = next(r for r in got if r.page_id == 1 and r.warc_type == "conversion")
    assert conv.block == "One\ntwo three <x>\nl end"  # a removed element separates
    meta = next(r for r in got if r.page_id == 1 and r.warc_type == "metadata").block
    assert "title: T & t" in meta and "outlink: http://e.com/a?b=1&c" in meta and "http-status: HTTP/1.1 200 OK" in meta
    (head, block), = warc.parse(warc.serialize(conv.asDict()))
    assert head["warc-refers-to"] == conv.refers_to and block == conv.block.encode()
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 27\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nhi\r\n\r\nWARC/1.1\r\nWARC-Type: resp"
    (tmp_path / "x.warc").write_bytes(raw)
    r, = warc.read_responses(spark, str(tmp_path / "x.warc")).collect()
    assert (r.record_id, r.http_headers, r.payload) == ("<a>", "HTTP/1.1 200 OK\r\nA: b", "hi")
    assert warc.derivatives(resp.limit(0)).count() == 0


def test_warc_unclosed_elements_keep_their_text():
    for page, want in [
        ("<!DOCTYPE html><html><head><title>T</title><body><p>whole body</p></body></html>", "whole body"),
        ("<head><meta charset=utf-8><title>T</title><p>no body tag", "no body tag"),
        ("<head><title>T</title><svg><title>icon</title></svg>x</head>", "icon\nx"),
        ("<head><title>T</title><style>p{}</style></head><body>b", "b"),
        ("<head><noscript><link></head><body>b<noscript>n</noscript>c", "b c"),
        ("a<noscript>b<p>c", "ab\nc"),
        ("a<template>b<template>n</template>c", "ab c"),
        ("a<template>b<template>n</template>c</template>d", "a d"),
        ("a<style-guide>b</style-guide><head-line>c</head-line>", "abc"),
        ("a<!-->b<script>1</script x>c", "a b c"),
        ("a<script>b", "a"),
    ]:
        assert warc.plain_text(page) == want, page


def test_warc_files_keep_bytes_headers_and_digests(spark, tmp_path):
    import gzip
    import zlib

    import pyarrow as pa

    latin, page = "<p>caf\u00e9".encode("latin-1"), "<p>gr\u00fc\u00df".encode()
    chunked = b"3\r\n<p>\r\n2;x=y\r\nhi\r\n0\r\n\r\n"
    br = pa.compress(page, "brotli", asbytes=True)
    html = "Content-Type: text/html"
    cases = {  # name: HTTP headers, body as stored, digested bytes, text
        "latin": (html + "; charset=ISO-8859-1", latin, latin, "caf\u00e9"),
        "meta": (html, b"<meta charset=windows-1251>\xcf", b"<meta charset=windows-1251>\xcf", "\u041f"),
        "none": (html, latin, latin, "caf\u00e9"),
        "gzip": (html + "\r\nContent-Encoding: gzip", *[gzip.compress(page[:4]) + gzip.compress(page[4:])] * 2, "gr\u00fc\u00df"),
        "deflate": (html + "\r\nContent-Encoding: deflate", *[zlib.compress(page)[2:-4]] * 2, "gr\u00fc\u00df"),
        "br": (html + "\r\nContent-Encoding: br", br, br, "gr\u00fc\u00df"),
        "removed": (html + "\r\nContent-Encoding: gzip", page, page, "gr\u00fc\u00df"),
        "chunked": (html + "\r\nTransfer-Encoding: chunked", chunked, b"<p>hi", "hi"),
        "plain": ("Content-Type: text/plain", b"a <b and c> d\r\n", b"a <b and c> d\r\n", "a <b and c> d\r\n"),
        "xml": ("Content-Type: application/rss+xml", b"<d><![CDATA[x < y]]></d>", b"<d><![CDATA[x < y]]></d>", "x < y"),
        "png": ("Content-Type: image/png", b"\x89PNG\0\xff", b"\x89PNG\0\xff", None),
        "untyped": ("Server: x", b"\x89PNG\0\xff", b"\x89PNG\0\xff", None),
        "lost": (html + "\r\nContent-Encoding: br", b"\xff\xfe\xfd", b"\xff\xfe\xfd", None),
    }
    raw, own = b"", {}
    for name, (head, body, digested, _) in cases.items():
        block = f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body
        own[name] = f"WARC-Type: response\r\nWARC-Record-ID: <{name}>\r\nWARC-Payload-Digest: {warc.digest(digested)}\r\nWARC-Block-Digest: {warc.digest(block)}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}"
        raw += b"WARC/1.1\r\n" + own[name].encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    dns = "WARC-Type: response\r\nWARC-Record-ID: <dns>\r\nContent-Type: text/dns\r\nContent-Length: 5"
    raw += f"WARC/1.1\r\n{dns}\r\n\r\na. <b\r\n\r\n".encode()
    cases["dns"], own["dns"] = ("", b"a. <b", b"a. <b", "a. <b"), dns
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(raw))
    resp = warc.read_responses(spark, str(tmp_path / "x.warc.gz"))
    assert {r.record_id[1:-1]: (r.warc_headers, bytes(r.body)) for r in resp.collect()} == {n: (own[n], c[1]) for n, c in cases.items()}
    got = warc.derivatives(resp).collect()
    assert all(r.source_digest == warc.digest(cases[r.refers_to[1:-1]][2]) and r.source_warc_headers == own[r.refers_to[1:-1]] for r in got)
    assert {r.refers_to[1:-1]: r.block for r in got if r.warc_type == "conversion"} == {n: c[3] for n, c in cases.items() if c[3] is not None}
    meta = {r.refers_to[1:-1]: r.block for r in got if r.warc_type == "metadata"}
    assert set(meta) == set(cases) and all(f"warc-header: {x}\r\n" in meta[n] for n in cases for x in own[n].split("\r\n"))


# 3
def shingle_set(t):
    w = [x for x in "".join(c if c not in "\t\n\v\f\r" else " " for c in (t or "").lower()).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(data):
    sets = {}
    for i, t in data:
        if i is not None:
            sets[i] = shingle_set(t)
    ids = sorted(sets)
    links = {i: [j for j in ids if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in ids}
    comp = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            comp[i] = min([comp[i], *(comp[j] for j in links[i])])
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in ids}


@pytest.mark.parametrize("tile", [jaccard.TILE, 500])
def test_jaccard(spark, docs, tile):
    got = jaccard.near_duplicates(docs, tile=tile).collect()
    assert {r.doc_id: (r.n_links, r.component_id, r.kept) for r in got if r.doc_id is not None} == brute([r[:2] for r in rows()])
    assert sum(r.doc_id is None and r.kept for r in got) == 2 and len(got) == len({r[0] for r in rows()}) + 1


def test_jaccard_groups_and_rest(spark, docs):
    r = random.Random(5)
    base = words(150, 1).split()
    data = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(150)] = "z" + str(r.randint(0, 9999))
        data.append((i, " ".join(w)))
    data += [(1000 + i, words(40, 1000 + i % 30)) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id int, text string")
    got = jaccard.near_duplicates(df, tile=4000)
    assert {r.doc_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == brute(data)
    assert jaccard.near_duplicates(empty(spark)).count() == 0
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [i for i, v in sorted(brute([r[:2] for r in rows()]).items()) if v[2]]
    assert (jaccard.depth(), jaccard.depth(recall=0.999), jaccard.depth(recall=jaccard.RECALL_INSIDE)) == (5, 6, 3)


def test_deduplicate_compares_rows(spark, tmp_path):
    a, b, c, d = (words(60, 200 + i) for i in range(4))
    near = " ".join([*a.split()[:-1], "changed"])
    data = [(1, a, "x"), (2, b, "x"), (2, c, "x"), (2, near, "x"), (2, c, "x"), (3, b, "x"), (None, d, "x"), (None, d, "y"), (None, near, "x"), (None, None, "x"), (None, None, "x"), (4, "", "x"), (4, "", "x"), (4, a, "x")]
    spark.createDataFrame(data, "doc_id int, text string, source string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = jaccard.deduplicate(spark.read.parquet(str(tmp_path / "d")))
    want = [(1, a, "x"), (2, b, "x"), (2, c, "x"), (None, d, "x"), (None, None, "x"), (None, None, "x"), (4, "", "x")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


# 4, 9
def test_bpe_and_counts_match_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    want = {}
    for r in rows():
        e = t.encode(r[1] or "", add_special_tokens=False)
        back = t.decode(e.ids, skip_special_tokens=False)
        want[r[0], r[1]] = (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect() if r.doc_id is not None) == sorted((False, r[0], *want[r[0], r[1]]) for r in rows() if r[0] is not None)
    for r in token_counts.count_tokens(docs, PATH).collect():
        assert r.over_limit == (r.n_tokens > 512)
        if r.doc_id is not None:
            assert (r.n_tokens, r.n_bytes) == (want[r.doc_id, rows()[r.doc_id][1]][0], len((rows()[r.doc_id][1] or "").encode()))
    enc = bpe.encode(docs.withColumn("ids", F.lit("clash")), PATH)
    dec = bpe.decode(enc, PATH)
    assert all(r.decoded == (r.text or "") for r in dec.collect())
    assert bpe.round_trip(empty(spark), PATH).count() == 0 == token_counts.count_tokens(empty(spark), PATH).count()


def test_counts_other_files():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [r[1] for r in rows()]
    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert token_counts.Counter(P.path("piece_bpe_32k.model")).lengths(texts).tolist() == [len(m.encode(t or "")) for t in texts]
    w = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    w.no_truncation()
    assert token_counts.Counter(P.path("word_bpe_49k.json")).lengths(texts).tolist() == [len(w.encode(t or "", add_special_tokens=False).ids) for t in texts]


# 6
@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_bijection(n):
    s = training_order.permute(np.arange(n), n)
    assert sorted(s) == list(range(n))
    if n > 100:
        assert (s != training_order.permute(np.arange(n), n, key=9)).any() and abs(np.corrcoef(s, np.arange(n))[0, 1]) < 0.2


def plain_slot(i, n, key=training_order.KEY):
    """The permutation in Python's integers."""
    def mixed(h):
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD % 2**64
        h ^= h >> 33
        h = h * 0xC4CEB9FE1A85EC53 % 2**64
        return h ^ h >> 33

    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    while True:
        left, right = i >> half, i & (1 << half) - 1
        for r in range(6):
            left, right = right, left ^ mixed((right + mixed((r + 1) * (2 * key + 1) % 2**64)) % 2**64) & (1 << half) - 1
        i = left << half | right
        if i < n:
            return i


@pytest.mark.parametrize("files,parts", [(2, 4), (3, 1), (7, 5)])
def test_training_order(spark, tmp_path, files, parts):
    """Each slot's record against another program, whatever the files and partitions."""
    length, shard = 64, 50
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows(), SCHEMA).repartition(files).write.parquet(path)
    docs = spark.read.parquet(path)
    folder = f"file://{tmp_path}/shards"
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    df = training_order.materialize_order(docs, PATH, folder, length=length, shard=shard)
    got = sorted(df.collect())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    from tokenizers import Tokenizer

    t, stream, owner = Tokenizer.from_file(PATH), [], []
    for r in docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h")).orderBy("h").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [50256]
        stream += ids
        owner += [r.doc_id] * len(ids)
    n = -(-len(stream) // length)
    assert len(got) == n and [r.slot for r in got] == list(range(n)) and all(r.shard == r.slot // shard and r.byte_offset == r.slot % shard * 2 * length for r in got)
    data = training_order.read_from(folder, 0, n, n, length, shard)
    for i in range(n):
        s = plain_slot(i, n)
        part = stream[i * length : (i + 1) * length]
        assert data[s].tolist() == part + [50256] * (length - len(part)) and set(got[s].doc_ids) == set(owner[i * length : (i + 1) * length])
        assert got[s].record_sha256 == hashlib.sha256(data[s].tobytes()).hexdigest()
    assert (training_order.read_from(folder, 45, n, 10, length, shard) == data[45:55]).all()
    (tmp_path / "shards" / "_shard-00000000.bin.99").write_bytes(b"left by a failed attempt")
    assert training_order.finish(spark, folder, spark.createDataFrame(got, df.schema), length, shard) == {"sequences": n, "length": length, "shard": shard, "width": 2}
    assert sorted(x.name for x in (tmp_path / "shards").iterdir() if not x.name.startswith(".")) == ["manifest.json"] + [f"shard-{k:08d}.bin" for k in range(-(-n // shard))]


def test_training_order_edges(spark, docs, tmp_path, monkeypatch):
    assert training_order.materialize_order(empty(spark), PATH, f"file://{tmp_path}/none").count() == 0
    one = docs.where("doc_id = 3").selectExpr("'a' doc_id", "text")
    assert [r.doc_ids for r in training_order.materialize_order(one, PATH, f"file://{tmp_path}/one", length=64).collect()] == [["a"]]
    a = training_order.materialize_order(docs, PATH, f"file://{tmp_path}/a", length=8)
    monkeypatch.setattr(training_order, "BUFFER", 40)
    b = training_order.materialize_order(docs, PATH, f"file://{tmp_path}/b", length=8)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    c = training_order._written(docs, PATH, f"file://{tmp_path}/c", 8, training_order.SHARD, training_order.KEY, 50256, "<u2")
    assert len(c.collect()) == b.count()
    assert "ReusedExchange" in c._jdf.queryExecution().executedPlan().toString()  # the texts are encoded once


# 7
@pytest.mark.parametrize("tile", [neardup.TILE, 40])
def test_neardup(spark, tile):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:40] + rng.normal(size=(40, 16)) * 0.25, np.repeat(base[:1], 30, axis=0), base[:5] * 3])
    data = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    bad = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] * 16, 1), (504, data[0][1], None), (505, [1.0], 0), (506, [2.0], 0), (507, [], 0)]
    df = spark.createDataFrame([*data, *bad, data[3], (None, data[0][1], 0)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None, :] % 2)
    comp = np.arange(len(x))
    for _ in range(50):
        comp = np.array([comp[near[i]].min() for i in range(len(x))])
    want = {i: (int(near[i].sum()) - 1, int(comp[i]), comp[i] == i) for i in range(len(x))}
    want |= {b[0]: (0, b[0], True) for b in bad} | {505: (1, 505, True), 506: (1, 505, False)}
    got = neardup.near_duplicates(df, tile=tile).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == want and len(got) == len(want) + 1
    assert neardup.near_duplicates(df.limit(0)).count() == 0


# 8
def test_mixing(spark, docs):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows()) and sorted(got, key=str) == sorted(mixing.mix_report(docs.repartition(5)).collect(), key=str)
    size = {}
    for r in rows():
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").split())
    assert {r.source_size for r in got} <= set(size.values()) and all(0 <= r.taken <= 2 * r.size for r in got)
    order = sorted((s for s in size if s is not None)) + [None]
    target, open_, left = {}, list(order), 1.5 * sum(size.values())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * size[s]]
        for s in full or open_:
            target[s] = 2.0 * size[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    assert {round(r.target, 6) for r in got} == {round(v, 6) for v in target.values()}
    many = spark.createDataFrame([(i, "w " * (1 + i % 50), "hot" if i % 3 else f"s{i % 7}") for i in range(4000)], "doc_id long, text string, source string")
    taken = mixing.mix_report(many).groupBy("target", "source_size").agg(F.sum("taken").alias("t"), F.max("size").alias("m"))
    assert all(abs(r.t - r.target) <= r.m + 1e-6 for r in taken.collect())
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mix(empty(spark)).count() == 0 == mixing.mix_report(empty(spark)).count()


# 10
def test_topk(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(230, 12))
    x[5] = x[100] = x[20]
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame([*data, data[9], (900, None, 0), (950, [float("inf")] * 12, 0), (951, [None] * 12, 0), (None, data[1][1], 0), (1000, [], 0)], "vec_id long, embedding array<double>, rank int")
    q = np.floor(256 * x).astype(int)
    ids = list(range(230)) + [1000]
    q = np.concatenate([q, np.zeros((1, 12), dtype=int)])
    want = []
    for k, i in enumerate(ids):
        if i % 50 == 0:
            best = sorted((-int(q[k] @ q[j]), ids[j]) for j in range(len(ids)) if j != k)[:5]
            want += [(i, n + 1, v, -s) for n, (s, v) in enumerate(best)]
    for blocks in ({}, {"queries": 2, "candidates": 64}):
        got = topk.search(df, F.col("vec_id") % 50 == 0, **blocks).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.search(df.limit(0), F.lit(True)).count() == 0
    wide = spark.createDataFrame([(0, [1e306, 1.0]), (1, [1e306, 0.0]), (2, [-1e306, 5.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(wide, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2**63 - 1), (3, 512 * 256), (2, -(2**63))]
    with pytest.raises(TypeError):
        topk.search(wide.withColumn("vec_id", F.lit("x")), F.lit(True))
    big = np.array([[3, 0], [2**40, 1]], dtype=np.int64)
    assert topk.accumulate(big, big).tolist() == [[9, 3 * 2**40], [3 * 2**40, 2**63 - 1]]


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = queries.table(spark, d, "documents")
    seen = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = common.materialize(stage(spark, docs, d), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r == seen[r.doc_id] for r in docs.collect())
        if name == "near_duplicates":
            assert docs.count() == docs.select("doc_id").distinct().count()
            assert all(v[2] for v in brute([(r.doc_id, r.text) for r in docs.collect()]).values())
    out = corpus_pipeline.run(spark, d)
    want = sorted((r.doc_id, len(bpe.codec(PATH).encode(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in out.collect()) == want


def test_words_are_hashed_alike_in_pieces(monkeypatch):
    r = random.Random(11)
    texts = ["".join(r.choices("ab é\n", k=r.randint(0, 300))) for _ in range(40)] + [None, "x" * 5000, " ".join(["y" * 700] * 5), ""]
    want = {kind: hashing.words(texts, kind, prefixes=(4, 6)) for kind in ("space", "alnum")}
    monkeypatch.setattr(hashing, "PIECE", 64)
    for kind, (h, at, size, cut) in want.items():
        h2, at2, size2, cut2 = hashing.words(texts, kind, prefixes=(4, 6))
        assert (h == h2).all() and (at == at2).all() and (size == size2).all()
        assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(cut, cut2, strict=True))


def test_prefixes_are_shortened_text_by_text():
    free = np.ones((1, jaccard.TREES, 3), dtype=int)
    crowded = free.copy()
    crowded[0, :6, 1:] = 5000  # from the second level on, six trees are crowded
    a, b = jaccard.shorten(np.concatenate([free, crowded]))
    miss = lambda d: np.prod(1 - jaccard.THRESHOLD ** d.astype(float))
    assert 1 - miss(a) >= jaccard.RECALL and 1 - miss(b) >= jaccard.RECALL
    assert sorted(a) == [5] * 21 + [6] * 3 and (b[:6] == 6).all() and set(b[6:]) == {4, 5}
    assert (jaccard.shorten(free, recall=0.999) == 6).all() and (jaccard.shorten(free, recall=1 - 1e-15) == 4).all()


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_forest_nodes_reach_across_tasks(spark, parts):
    """Sizes, leads and depths against a plain count of prefixes, wherever the sorted labels are cut."""
    rng = np.random.default_rng(3)
    low, n = jaccard.shortest(), 300
    top = rng.integers(0, 6, (n, jaccard.TREES))  # few nodes, some with most of the classes
    top[:200, :8] = 3
    lab = top.astype(np.int64)
    for k in range(1, jaccard.LEVELS):
        lab = lab << jaccard.BITS | (rng.integers(0, 2, lab.shape) if k > 3 else 0)
    ids = rng.permutation(n) * 7
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, lab, strict=True)], "cls long, labels array<long>")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {(r.cls, r.tree): r for r in jaccard.forest(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    size = np.empty((n, jaccard.TREES, jaccard.LEVELS - low + 1), dtype=int)
    lead = size.copy()
    for k, d in enumerate(range(jaccard.LEVELS, low - 1, -1)):
        p = lab >> jaccard.BITS * (jaccard.LEVELS - d)
        for t in range(jaccard.TREES):
            same = p[:, t][:, None] == p[:, t][None, :]
            size[:, t, k], lead[:, t, k] = same.sum(axis=1), np.where(same, ids[None, :], 10**9).min(axis=1)
    depth = jaccard.shorten(size)
    want = {(int(ids[i]), t): (lead[i, t].tolist(), int(depth[i, t])) for i in range(n) for t in range(jaccard.TREES) if size[i, t, -1] > 1}
    assert {k: (list(r.leads), r.depth) for k, r in got.items()} == want
    assert len({tuple(x) for x in depth}) > 1


class Reader(__import__("html.parser").parser.HTMLParser):
    """Another program for pages whose elements are all closed: text, title, language and links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.skip, self.title, self.lang, self.links, self.head, self.in_title = "", 0, None, None, [], False, False

    def handle_starttag(self, tag, attrs):
        attrs = dict(reversed(attrs))
        self.head |= tag == "head"
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "title" and self.title is None:
            self.title, self.in_title = "", True
        if tag == "html" and self.lang is None:
            self.lang = attrs.get("lang")
        if tag == "a" and attrs.get("href") is not None:
            self.links.append(attrs["href"].strip())
        if tag in warc._BLOCKS and not (tag == "title" and self.head):
            self.text += "\n"

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1
            self.text += " "
        if tag == "head":
            self.head = False
        if tag == "title":
            self.in_title = False
            self.text += " "
        elif tag in warc._BLOCKS:
            self.text += "\n"

    def handle_comment(self, data):
        self.text += " "

    def handle_data(self, data):
        if self.in_title:
            self.title = " ".join((self.title + data).split())
        if not self.skip and not (self.in_title and self.head):
            self.text += data


def random_page(r):
    def inner(depth):
        out = []
        for _ in range(r.randint(1, 4)):
            k = r.randint(0, 9) if depth else 0
            if k < 3:
                out.append(r.choice(["text ", "a &amp; b", "é &lt;p&gt;", "1 > 0 ", "\n  x\t", "it's "]))
            elif k < 6:
                tag = r.choice(["p", "div", "b", "LI", "h2", "custom-tag", "section"])
                out.append(f"<{tag} class=\"x>y\" title='q'>{inner(depth - 1)}</{tag}>")
            elif k == 6:
                out.append(f"<a {r.choice(['', 'id=h '])}href={r.choice([chr(34) + 'u>v' + chr(34), chr(39) + '/p?a=1&amp;b=2' + chr(39), 'bare'])}>l</a>")
            elif k == 7:
                out.append(r.choice(["<!-- <p>no</p> -->", "<!---->", "<script>if (a < b) '</p>'</script>", "<style>p > b {}</style>"]))
            else:
                out.append(r.choice(["<br>", "<br/>", "<img alt='a > b'>", "<hr class=x>"]))
        return "".join(out)

    return f"<!DOCTYPE html><html lang=\"en\"><head><meta charset=utf-8><title>T {r.randint(0, 9)} &amp; t</title></head><body>{inner(4)}</body></html>"


def test_pages_read_like_another_parser():
    r = random.Random(21)
    for _ in range(300):
        page = random_page(r)
        p = Reader()
        p.feed(page)
        p.close()
        got = warc.scan(page)
        lines = "\n".join(x for line in p.text.split("\n") if (x := " ".join(line.split())))
        assert (got.text, got.title, got.language, got.links, got.charset) == (lines, p.title, p.lang, p.links, "utf-8"), page


@pytest.mark.parametrize("page", ["<a " * 700_000, "<a x=\"" * 300_001 + ">\"", "<!--" * 500_000, "<noscript><template>" * 100_000, "<title>" * 300_000 + ">", "<script" * 300_000 + ">", "<p " + "a" * 2_000_000 + ">", "<meta content='" * 150_000 + ">", "</" * 1_000_000 + "a>", "<script>" + "</script " * 300_000, "<title>" + "</title x" * 300_000 + ">" + "</title x" * 300_000])
def test_odd_pages_take_linear_time(page):
    import time

    began = time.process_time()
    warc.scan(page)
    assert time.process_time() - began < 5


def test_warc_streams_and_sink(spark, tmp_path, monkeypatch):
    import gzip

    raw = b""
    for i in range(40):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n" + b"WARC/1.1\r\n\r\n" * 3 + f"body {i} ".encode() * r_len(i)
        raw += f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nWARC-Target-URI: http://e/{i}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    pieces = [raw[i : i + 777] for i in range(0, len(raw), 777)]
    assert list(warc.records(raw)) == list(warc.records(iter(pieces))) == list(warc.records(gzip.compress(raw[:5000]) + gzip.compress(raw[5000:])))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(raw)
    (tmp_path / "in" / "b.warc.gz").write_bytes(gzip.compress(raw))
    monkeypatch.setattr(warc, "BATCH", 1000)
    resp = warc.read_responses(spark, str(tmp_path / "in"))
    assert resp.count() == 80
    made = warc.derivatives(resp)
    files = warc.write_warc(made, f"file://{tmp_path}/out").collect()
    assert sum(f.records for f in files) == 160 and all((tmp_path / "out" / f.file).stat().st_size == f.bytes for f in files) and len(list((tmp_path / "out").glob("*.gz"))) == len(files)
    back = [x for f in files for x in warc.parse((tmp_path / "out" / f.file).read_bytes())]
    assert sum(h["warc-type"] == "warcinfo" for h, _ in back) == len(files)
    want = sorted((r.record_id, r.refers_to, r.source_digest, r.source_headers, r.source_warc_headers.replace("\r\n", "\n"), r.block.encode()) for r in made.collect())
    assert sorted((h["warc-record-id"], h["warc-refers-to"], h["x-source-payload-digest"], h["x-source-http-header"].replace("\n", "\r\n"), h["x-source-warc-header"], b) for h, b in back if h["warc-type"] != "warcinfo") == want


def r_len(i):
    return 1 + i * 37 % 50


@pytest.mark.parametrize("tile,classes", [(4000, 3000), (10**6, 25)])
def test_large_components_by_representative(spark, monkeypatch, tile, classes):
    """Close families, a chain that leads away from its representative, copies and repeated rows, in tiles of few classes."""
    monkeypatch.setattr(jaccard, "CLASSES", classes)
    r = random.Random(31)
    data, base = [], words(140, 77).split()
    for i in range(120):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
            k = r.randrange(140)
            w[k : k + 1] = r.choice([[], ["z" + str(r.randint(0, 999))], [w[k], "y" + str(r.randint(0, 99))]])
        data.append((i, " ".join(w)))
    chain = words(160, 78).split()
    for i in range(60):  # each differs from the next a little, the ends share nothing
        chain[i * 2] = "link" + str(i)
        data.append((500 + i, " ".join(chain)))
    data += [(1000, data[3][1]), (1001, data[130][1]), (3, data[3][1]), (2000, words(50, 79))]
    df = spark.createDataFrame(data, "doc_id int, text string").repartition(3)
    zones = []
    real = jaccard._large
    monkeypatch.setattr(jaccard, "_large", lambda *a: zones.append(real(*a)) or zones[-1])
    got = jaccard.near_duplicates(df, tile=tile)
    assert {x.doc_id: (x.n_links, x.component_id, x.kept) for x in got.collect()} == brute(data)
    assert zones and zones[0][1].count() > 20  # some links are known without a pair
    if classes == 25:
        assert sorted(x.doc_id for x in jaccard.deduplicate(df, tile=tile).collect()) == sorted(i for i, v in brute(data).items() if v[2])
