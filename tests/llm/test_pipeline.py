"""The pipeline and all operators over odd tables, against plain programs."""
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import bpe, common, jaccard, learning, mixing, neardup, quality, queries, token_counts, topk, toxicity, training_order, warc
from tests.llm.test_operators import PATH, brute, rows, words

#: Names that the operators use for columns of their own, or once did.
CLASHES = "row size key tie at block copies no_source first n before id hash rep k1 k2 labels kept cls label y other _id _hash _copies _size part slot place ids held_out score predicted total source_size target word".split()


def mixed(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD % 2**64
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 % 2**64
    return h ^ h >> 33


P = 0x9E3779B97F4A7C15 | 1
BYTES = [mixed((i + 1) * P % 2**64) for i in range(256)]


def word_bucket(word: bytes) -> int:
    return mixed(sum(BYTES[b] * pow(P, k, 2**64) for k, b in enumerate(word)) % 2**64) >> 64 - learning.BITS


def split(text, keep):
    out, word = [], b""
    for b in (text or "").lower().encode() + b" ":
        if keep(b):
            word += bytes([b])
        elif word:
            out.append(word)
            word = b""
    return out


def plain_quality(m, text, n_chars):
    """The model's score by a double loop over features, with statistics of its own."""
    text = text or ""
    w = split(text, lambda b: b not in b" \t\n\v\f\r")
    found: dict[int, int] = {}
    for x in w:
        k = int(m.keep[word_bucket(x)])
        if k >= 0:
            found[k] = found.get(k, 0) + 1
    norm = math.sqrt(sum(c * c for c in found.values()))
    raw = text.encode()
    groups = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"-()", b"!?", b"#$%&*@^~+=", b"|_<>/\\[]{}`"]
    share = [sum(b in g for b in raw) for g in groups] + [sum(b >= 128 for b in raw)]
    share = [x / max(1, len(raw)) for x in [*share, len(raw) - sum(share)]]
    lines = [x for x in text.split("\n") if x]
    n = n_chars if n_chars is not None and n_chars >= 0 else len(text)
    size = [len(x) for x in w] or [0]
    mean = sum(size) / len(size)
    stats = share + [math.log1p(len(w)), mean, math.sqrt(sum((x - mean) ** 2 for x in size) / len(size)), sum(x <= 3 for x in size) / len(size) if w else 0, len(found) / max(1, len(w)), math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), math.log1p(len(text) / max(1, len(lines))), math.log1p(n)]
    first = len(m.w) - len(stats)
    x = {k: c / norm for k, c in found.items()}
    x |= {first + i: min(4, max(-4, (s - m.mean[i]) / m.scale[i])) / math.sqrt(len(stats)) for i, s in enumerate(stats)}
    keys = list(x)
    z = m.w0 + sum(m.w[k] * x[k] for k in keys)
    z += sum(float(m.v[a] @ m.v[b]) * x[a] * x[b] for i, a in enumerate(keys) for b in keys[:i])
    return 1 / (1 + math.exp(-min(35, max(-35, z))))


def plain_toxicity(m, text):
    found: dict[int, int] = {}
    for x in split(text, lambda b: b >= 128 or chr(b).isalnum()):
        for word in [x, *((x[:k], k) for k in toxicity.PREFIXES if len(x) > k)]:
            h = mixed(sum(BYTES[b] * pow(P, i, 2**64) for i, b in enumerate(x)) % 2**64) if word is x else mixed((sum(BYTES[b] * pow(P, i, 2**64) for i, b in enumerate(word[0])) + word[1]) % 2**64)
            k = int(m.keep[h >> 64 - learning.BITS])
            if k >= 0:
                found[k] = found.get(k, 0) + 1
    z = sum((1 + math.log(c)) * m.w[k] for k, c in found.items())
    return [1 / (1 + math.exp(-min(35, max(-35, z - c)))) for c in m.cuts]


def plain_mix(data):
    """(doc_id, size, source) rows -> copies, in the same order: every source by size and id, one offset."""
    size: dict = {}
    for _, s, source in data:
        size[source] = size.get(source, 0) + s
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, list(order), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * size[s]]
        target |= {s: 2.0 * size[s] for s in full} if full else {s: weight[s] * level for s in open_}
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    out, u = {}, mixing.offset()
    for source in order:
        rate = target[source] / size[source] if size[source] else 0.0
        mine = sorted((i for i, d in enumerate(data) if d[2] == source), key=lambda i: (data[i][1], data[i][0] is not None, data[i][0]))
        for r, i in enumerate(mine):
            out[i] = math.floor((r + 1) * rate + u) - math.floor(r * rate + u)
    return [out[i] for i in range(len(data))]


def sample_text(i):
    """Clean, bad and toxic texts, with copies and near copies."""
    w = words(30 + i % 9, i - 7 if i % 11 == 10 and i >= 7 else i).split()
    if i % 13 == 12:
        w[3] = "changed"
    if i % 4 == 1:
        w = [x + "!!$$" for x in w]
    if i % 6 == 2:
        w[::4] = ["nasty", "vilest", "rotten"] * len(w[::4]) if False else [("nasty", "vilest", "rotten")[k % 3] for k in range(len(w[::4]))]
    return " ".join(w)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, repeats, a long text, clashing columns and a map; labels with nulls and contradictions."""
    d = tmp_path_factory.mktemp("sf")
    data = [(i, sample_text(i), ["en", None][i % 2], [None, "b", "a", "c"][i % 4], len(sample_text(i))) for i in range(400)]
    data += [data[5], data[5], (7, "another text of the same id", "en", "a", None), (None, words(40, 900), None, "b", -1), (None, None, None, None, None), (401, "", "en", "a", 0), (402, None, "en", "c", None), (403, " \n\t", None, None, 3), (404, words(30_000, 3), "en", "b", 1), (405, "a" * 20_000, "en", "b", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    for i, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(7 if i % 2 else "x"))
    df = df.withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    df.repartition(5).write.parquet(f"{d}/documents.parquet")
    y = [(i, int(i % 4 != 1), int(i % 6 == 2)) for i in range(400) if i % 3] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (6, None, None), (9, 5, 5)]
    spark.createDataFrame(y, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_every_stage_against_a_plain_program(spark, folder, monkeypatch):
    docs = queries.table(spark, folder, "documents")
    labels = queries.table(spark, folder, "labels")
    assert len(corpus_pipeline.STAGES) == 5
    keyed = lambda df: sorted(((r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None) for r in df.collect()))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None)
    before = docs.collect()
    q, t = quality.train(docs, labels), toxicity.train(docs, labels)
    assert q.v.any() and (t.w > 0).any()
    scores = {(r.doc_id, r.score) for r in quality.score(docs, q).collect()}
    for r in before[:60]:
        assert min(abs(s - plain_quality(q, r.text, r.n_chars)) for i, s in scores if i == r.doc_id) < 1e-9
    severity = {(r.doc_id, r.severity, r.p_toxic) for r in toxicity.score(docs, t).collect()}
    for r in before[:200]:
        p = plain_toxicity(t, r.text)
        assert any(abs(s - sum(p)) < 1e-9 and abs(x - p[0]) < 1e-9 for i, s, x in severity if i == r.doc_id)

    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        docs, _ = common.materialize(out, name)
        assert all(r["a.b"] == 1 and r.m == {"k": 1} and all(r[c] == (7 if i % 2 else "x") for i, c in enumerate(CLASHES)) for r in docs.collect())
        kept[name] = docs
    short = [r for r in before if len(r.text or "") < 5000]
    want = [r for r in short if plain_quality(q, r.text, r.n_chars) >= quality.THRESHOLD]
    assert [k for k in keyed(kept["quality"]) if len(k[2]) < 5000] == sorted(map(key, want))
    left = [r for r in kept["quality"].collect() if len(r.text or "") >= 5000 or plain_toxicity(t, r.text)[0] < t.threshold]
    assert [k for k in keyed(kept["toxicity"]) if len(k[2]) < 5000] == sorted(k for k in map(key, left) if len(k[2]) < 5000)
    ids = [(i, r.text) for i, r in enumerate(sorted(kept["toxicity"].collect(), key=key))]
    groups = brute(ids)
    unique = {}
    for (i, text), r in zip(ids, sorted(kept["toxicity"].collect(), key=key), strict=True):
        if groups[i][2] and not ((text or "").split() == [] and r.doc_id is not None and (r.doc_id, text) in unique):
            unique[r.doc_id, text] = unique.get((r.doc_id, text), 0) + 1
    assert keyed(kept["near_duplicates"]) == sorted(k for (i, text), n in unique.items() for k in [(i is None, i or 0, text or "", text is None)] * n)
    last = sorted(kept["near_duplicates"].collect(), key=key)
    copies = plain_mix([(r.doc_id, len((r.text or "").split()), r.source) for r in last])
    assert keyed(kept["mixing"]) == sorted(k for r, n in zip(last, copies, strict=True) for k in [key(r)] * n)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    want = []
    for r in kept["mixing"].collect():
        e = library.encode(r.text or "", add_special_tokens=False)
        want.append((r.doc_id is None, r.doc_id or 0, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_pipeline_of_nothing(spark, folder, tmp_path):
    docs = queries.table(spark, folder, "documents")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    queries.table(spark, folder, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, folder).collect() == []


def test_stages_behind_the_first_do_without_the_documents_table(spark, folder, tmp_path):
    queries.table(spark, folder, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    docs = queries.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:  # the documents lie in another folder from the first stage on
        docs, _ = common.materialize(stage(spark, docs, str(tmp_path)), name)
    assert keys_of(docs) == keys_of(corpus_pipeline.run(spark, folder))


def keys_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.ids_sha256) for r in df.collect())


def test_operators_over_odd_tables(spark, folder, tmp_path):
    """Row counts and key columns of operators whose values other tests hold."""
    docs = queries.table(spark, folder, "documents")
    n, ids = docs.count(), docs.select("doc_id").distinct().count()
    assert jaccard.near_duplicates(docs).count() == ids + 1  # the two rows without an id are rows of their own
    assert bpe.round_trip(docs, PATH).count() == n == token_counts.count_tokens(docs, PATH).count() == mixing.mix_report(docs).count()
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert all(r.decoded == (r.text or "") for r in back.collect()) and set(back.columns) == {*docs.columns, "decoded"}
    owners = [i for r in training_order.materialize_order(docs, PATH, f"file://{tmp_path}/s", length=64).collect() for i in r.doc_ids]
    assert set(owners) == {r.doc_id for r in docs.select("doc_id").collect()}
    strings = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", "source")
    named = {r.doc_id: r for r in jaccard.near_duplicates(strings).collect()}
    numbers = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    assert all(named[f"d{i}"].n_links == r.n_links for i, r in numbers.items() if i is not None)
    same = {}
    for i, r in numbers.items():
        if i is not None:
            same.setdefault(r.component_id, set()).add(f"d{i}")
    other = {}
    for i, r in named.items():
        if i is not None:
            other.setdefault(r.component_id, set()).add(i)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, other.values())) and all(min(v) == k for k, v in other.items())
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0], i % 2) for i in range(30)] + [(3, None, 0), (None, [1.0, 2.0], 1), (31, [], 0), (32, [None, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    for c in ("vec", "cls", "mult", "tiles", "x", "a", "b", "q", "c", "rank", "is_query", "r", "z", "dim", "m.n"):
        vectors = vectors.withColumn(c, F.lit("v"))
    assert neardup.near_duplicates(vectors).count() == 33
    found = topk.search(vectors, F.coalesce(F.col("vec_id") % 10 == 0, F.lit(False)))
    assert found.columns == ["query_id", "rank", "vec_id", "score"] and found.count() == 15
    pages = spark.createDataFrame([(1, "http://a/", "<p>x"), (1, "http://a/", "<p>x"), (None, None, None), (2, "::", "<a href=' // '>" + "<" * 100_000)], "page_id long, url string, html string")
    for c in ("_own", "_raw", "_body", "body", "payload", "record_id", "date"):
        pages = pages.withColumn(c, F.lit("v"))
    assert warc.derivatives(warc.responses_of(pages), keep=("page_id",)).count() == 8


def test_samples_are_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 1000, 1) for i in range(300)] + [(1, "y", 1)] * 500, "doc_id long, text string, n_chars int").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1, 1)] * 20, "doc_id long, quality int")
    got = learning.labelled_sample(docs, labels, "quality", 30)
    assert len(got) == 30 == len({r[0] for r in got}) and got == learning.labelled_sample(docs.repartition(2), labels, "quality", 30)
    few = learning.labelled_sample(docs, labels, "quality", 30, most=10_500)
    assert len(few) == 10 and set(few) <= set(got)
    assert learning.labelled_sample(docs.limit(0), labels, "quality", 30) == []


def test_severity_rises_with_planted_severity():
    import random

    r = random.Random(8)
    ladder = {1: ["rude"], 2: ["rude", "nasty"], 3: ["rude", "nasty", "vile", "rotten"]}
    def text(grade):
        w = ["w" + str(r.randint(0, 400)) for _ in range(r.randint(20, 60))]
        for x in ladder.get(grade, []):
            w.insert(r.randrange(len(w)), x)
        return " ".join(w)

    data = [(text(g := r.choice([0, 0, 0, 0, 1, 2, 3])), int(g > 0)) for _ in range(3000)]
    m = toxicity.fit(data)
    severity = [np.mean(m.probabilities([text(g) for _ in range(200)]).sum(axis=1)) for g in range(4)]
    assert severity[0] < 0.2 and severity[0] + 0.5 < severity[1] < severity[2] - 0.2 and severity[2] < severity[3] - 0.2


def test_all_documents_match_the_library(spark):
    """op4 and op9 on every document of a table."""
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.exists(d):
        pytest.skip("test data absent")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, d, "documents").select("doc_id", "text").collect()}
    want = {}
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_bpe(spark, d).collect()} == want
    assert {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in queries.op9_token_counts(spark, d).collect()} == {i: (v[0], len(texts[i].encode()), v[0] > 512) for i, v in want.items()}


def test_recall_of_the_join(spark):
    """Pairs at and above the threshold over many random pairs: the share found."""
    import random

    r = random.Random(12)
    data, want, i = [], 0, 0
    for _ in range(700):
        base = ["".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(104)]
        k = r.choice([1, 1, 2])  # changed words far apart: five shingles each
        other = list(base)
        for j in range(k):
            other[20 + 40 * j] = "changed" + str(r.randint(0, 10**9))
        other += ["more" + str(x) for x in range(r.choice([0, 0, 11 - 5 * k + k]))]
        a, b = (({tuple(x[p : p + 5]) for p in range(len(x) - 4)}) for x in (base, other))
        want += len(a & b) >= 0.8 * len(a | b)
        data += [(i, " ".join(base)), (i + 1, " ".join(other))]
        i += 2
    got = jaccard.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).where("n_links > 0").count() // 2
    assert want > 600 and got >= 0.99 * want and got <= want
