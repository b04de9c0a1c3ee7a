"""The trie against dictionaries of prefixes."""
import hashlib
import random
import zlib

import duckdb
import pytest

from loomtext.llm import prefix_trie, queries

SF = "/root/testdata/sf0.01"


def rebuilt(rows):
    """Conversations as lists of (role, text), rebuilt."""
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def trie(convs):
    """(conv_id, depth) -> the other columns, by dictionaries."""
    members: dict = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        under = children.get(p, [])
        leaves[p] = sum(leaves[c] for c in under) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[c] for c in under)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p))))
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(under), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def same(frame, convs):
    rows = frame.collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    assert got == trie(convs)


def test_sql_equals_dictionaries():
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR)")
    rng = random.Random(11)
    rows = [(c, t if t else None, rng.choice(["a", None]), rng.choice(["x", "é", None])) for c in range(-7, 90) for t in range(rng.choice([1, 2, 9, 12]))] + [(None, 0, "a", "x")]
    for given in (rows, duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()):
        con.execute("DELETE FROM conversations")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", given)
        got = con.execute(prefix_trie.TRIE_SQL).fetchall()
        assert {r[:2]: r[2:] for r in got} == trie(rebuilt(given)) and len(got) == len({r[:2] for r in got})


def table(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "conv_id long, turn int, role string, text string, depth int")


def test_query_equals_dictionaries(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    same(queries.op11_prefix_trie(spark, SF), rebuilt(rows))


@pytest.mark.parametrize("local", [0, 12, 4096])
def test_random_conversations(spark, local):
    rng = random.Random(local)
    rows = []
    for c in range(-12, 60):
        for t in range(rng.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, t, rng.choice(["a", "b"]), rng.choice(["x", "é", "long text"])))
    for c in range(100, 130):  # copies, among them of base and own turns
        rows += [(c, t, "user", f"same {t}") for t in range(11)]
    rng.shuffle(rows)
    same(prefix_trie.prefix_trie(table(spark, rows), prefix_trie.grafted, local), rebuilt(rows))


@pytest.mark.parametrize("local", [0, 4096])
def test_plain_conversations_and_edges(spark, local):
    rows = [(1, 0, None, None), (1, None, "r", "first"), (2, 0, "", ""), (3, 0, "a", "bc"), (4, 0, "ab", "c"), (None, 0, "x", "y"), (5, 0, "a", "bc"), (5, 1, "a", "bc")]
    rows += [(c, t, "r", "é" * 50 if t < 8 else str(c)) for c in (50, 51) for t in range(9)]  # a long shared beginning
    rows += [(c, 0, "r", "copy") for c in range(200, 900)]
    convs: dict = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    same(prefix_trie.prefix_trie(table(spark, rows), local=local), convs)


def test_one_long_conversation_and_repeats(spark):
    rows = [(7, t, "r", f"{t}") for t in range(3000)] + [(8, 0, "r", "0")] * 3 + [(10, 0, "r", "0"), (11, 0, "x", "y")]
    same(prefix_trie.prefix_trie(table(spark, rows), prefix_trie.grafted), rebuilt(rows))
    turns = prefix_trie.numbered(prefix_trie.digested(table(spark, rows))).where("conv = 7").orderBy("pos").collect()
    assert [r.pos for r in turns] == list(range(1, 3001)) and turns[-1].upto == sum(r.size for r in turns)


def test_empty(spark):
    got = prefix_trie.prefix_trie(table(spark, [(1, 0, "a", "b")]).where("false"), prefix_trie.grafted)
    assert got.collect() == [] and "ends_sha256" in got.columns


def test_runs_of_ids_join_to_one_hash(spark):
    old = prefix_trie._RUN
    try:
        prefix_trie._RUN = 64
        import pyarrow as pa

        batch = pa.record_batch([pa.array([1] * 500 + [2]), pa.array([*range(500), 7])], names=["seq", "conv"])
        runs = list(prefix_trie._id_runs([batch.slice(0, 300), batch.slice(300)]))
        assert sum(r.num_rows for r in runs) > 20
        got = {k: v for b in prefix_trie._hash_runs(runs) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    finally:
        prefix_trie._RUN = old
    assert got == {1: hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest(), 2: hashlib.sha256(b"7").hexdigest()}
