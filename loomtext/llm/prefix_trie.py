"""The trie of shared conversation beginnings, by partition refinement.

A conversation is a sequence of turns; a node is a distinct sequence of first turns, and the conversations that begin with it are its members. All
conversations start in one class, the root. Round d splits every active class by its members' turn d: each part is a node of depth d. A
part in which only one distinct sequence goes on retires, as nothing can split it: its tail is emitted as a unary chain, a node a turn, without
further rounds. A part with few turns left (`local`) is refined in the same way within one task; only larger ones go into another
round. At the end sums are folded back from the deepest round to the root.

Conversations with equal turns are one sequence with a weight, so copies, however many, retire like one. A class is named by its smallest member.

What moves is slim: turns are two longs of a SHA-256 and a size. Groups are summed map-side; classes are tables that members are joined with, and
such joins adaptive execution can split. A conversation's turns are numbered over range partitions with a running offset, so one of any length spreads
over tasks, and its tail is made row by row. The ids of a node's finished conversations are joined in runs of bounded size by range partitions, and
only then hashed in order, as SHA-256 has to be, in a stream. So nothing gathers a class, a conversation or a group of copies in one task; the number
of rounds is that of the turns that large classes share.

Edge cases: rows with a null conversation id take no part; a null role or text is an empty one; turns are ordered by number, null first, equal numbers by
the turns' digests; repeated rows are turns of their own; an empty table gives no rows, not even a root; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import integer_ids, materialize, remove

#: Turns that a class has left when one task refines it to the end.
LOCAL = 4_096
#: Turns that can be taken from another conversation; how many is a hash's choice in `grafted`.
SHARED, GROUP = 8, 5
#: Bytes of joined ids in a run.
_RUN = 1 << 20
_TURN = ("k1", "k2", "size")


def digested(conversations: DataFrame) -> DataFrame:
    """(conv, turn, k1, k2, size): two longs of the turn's SHA-256, which holds the role's length too, and its text's bytes."""
    integer_ids(conversations, "conv_id")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("h"), F.octet_length(text).cast("long").alias("size")
    )
    half = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("long")
    return rows.select("conv", "turn", half(1).alias("k1"), half(16).alias("k2"), "size")


def numbered(turns: DataFrame) -> DataFrame:
    """turns with `pos`, from 1 in each conversation, and `upto`, the bytes of turns up to it. Two levels: range partitions, then
    the counts of the conversations that reach over partitions, at most two a partition."""
    spark = turns.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns, _ = materialize(turns, "turns")
    dealt = turns.repartitionByRange(tasks, "conv", "turn", "k1", "k2").withColumn("block", F.spark_partition_id())
    dealt, _ = materialize(dealt, "blocks")
    inside = Window.partitionBy("block", "conv").orderBy(F.col("turn").asc_nulls_first(), "k1", "k2").rowsBetween(Window.unboundedPreceding, 0)
    parts = dealt.groupBy("block", "conv").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    ends = dealt.groupBy("block").agg(F.min("conv").alias("low"), F.max("conv").alias("high"))
    ends = ends.select("block", F.explode(F.array_distinct(F.array("low", "high"))).alias("conv"))  # a row or two for each task
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    reach = parts.join(F.broadcast(ends), ["block", "conv"]).withColumn("n0", F.sum("n").over(before)).withColumn("b0", F.sum("bytes").over(before))
    reach = reach.where("n0 > 0").select("block", "conv", "n0", "b0")
    rows = dealt.withColumn("pos", F.count("*").over(inside)).withColumn("upto", F.sum("size").over(inside)).join(F.broadcast(reach), ["block", "conv"], "left")
    zero = F.lit(0).cast("long")
    return rows.select("conv", "k1", "k2", "size", (F.col("pos") + F.coalesce("n0", zero)).alias("pos"), (F.col("upto") + F.coalesce("b0", zero)).alias("upto"))


def heads(turns: DataFrame) -> DataFrame:
    """(conv, n, bytes, head): of each conversation the number of turns, their bytes, and its first SHARED turns."""
    first = F.collect_list(F.when(F.col("pos") <= SHARED, F.struct("pos", *_TURN)))  # SHARED at most
    return turns.groupBy("conv").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.array_sort(first).alias("head"))


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (rows, convs), as `build` takes them."""
    info = turns.groupBy("conv").agg(F.count("*").alias("len"), F.sum("size").alias("bytes"))
    rows = turns.join(info, "conv").select("conv", F.col("pos").alias("depth"), *_TURN, (F.col("bytes") - F.col("upto") + F.col("size")).alias("rest"))
    return rows, info.select("conv", "len")


def grafted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of conversation c - c % GROUP, then c's own after its first h; h is the CRC-32 of c in decimals, modulo
    SHARED + 1. (rows, convs): rows (conv, depth, k1, k2, size, rest), rest being the bytes of that turn and all later ones; convs (conv, len)."""
    info, _ = materialize(heads(turns), "heads")
    base = info.select(F.col("conv").alias("base"), F.col("head").alias("given"))
    info = info.withColumn("h", (F.crc32(F.col("conv").cast("string")) % (SHARED + 1)).cast("int")).withColumn("base", F.col("conv") - F.col("conv") % GROUP)
    info = info.join(base, "base", "left").withColumn("given", F.slice(F.coalesce("given", F.array().cast(info.schema["head"].dataType)), 1, F.col("h")))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, t: a + t["size"])
    own, tail = F.greatest(F.col("n") - F.col("h"), F.lit(0)), F.col("bytes") - total(F.slice("head", 1, F.col("h")))
    info, _ = materialize(info.select("conv", "h", "bytes", "given", F.size("given").alias("k"), own.alias("own"), tail.alias("tail")), "grafts")
    given = info.select("conv", "tail", "given", F.posexplode("given").alias("i", "t"))
    given = given.select("conv", (F.col("i") + 1).cast("long").alias("depth"), *(F.col(f"t.{c}") for c in _TURN), (F.col("tail") + total(F.slice("given", F.col("i") + 1, SHARED))).alias("rest"))
    later = turns.join(info.where("own > 0").select("conv", "h", "k", "bytes"), "conv").where(F.col("pos") > F.col("h"))
    later = later.select("conv", (F.col("pos") - F.col("h") + F.col("k")).cast("long").alias("depth"), *_TURN, (F.col("bytes") - F.col("upto") + F.col("size")).alias("rest"))
    return given.unionByName(later), info.select("conv", (F.col("k") + F.col("own")).cast("long").alias("len"))


def sequences(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, seq): equal sequences by their smallest conversation. They are told apart by length and 128 bits over all turns and places, which
    are xor sums, so no conversation is gathered."""
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "k1", "k2", "depth"))
    marks = rows.groupBy("conv").agg(mark(1).alias("m1"), mark(2).alias("m2"))
    marked = convs.join(marks, "conv", "left").select("conv", "len", F.coalesce("m1", F.lit(0)).alias("m1"), F.coalesce("m2", F.lit(0)).alias("m2"))
    marked, _ = materialize(marked, "marks")
    by = ["len", "m1", "m2"]
    found, _ = materialize(marked.groupBy(*by).agg(F.min("conv").alias("seq"), F.count("*").alias("w")), "sequences")
    return marked.join(found, by).select("conv", "seq", "len", "w")


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_seq long"
_BELOW, _RUNS, _ENDS = _NODE + ", top boolean", "seq long, first long, ids string", "seq long, ends_sha256 string"


def refine(top: int, start: int, rows: list[tuple]) -> list[list]:
    """One class to the end, in memory: rows (seq, w, len, depth, k1, k2, size) of its sequences' turns after depth `start`. The nodes below the class, as
    _NODE says."""
    turns: dict[int, dict[int, tuple]] = {}
    facts: dict[int, tuple[int, int]] = {}
    for s, w, n, d, *turn in rows:
        turns.setdefault(s, {})[d] = tuple(turn)
        facts[s] = (w, n)
    nodes: list[list] = []  # with the number of the parent's entry at the end
    active, depth = [(top, -1, sorted(turns))], start
    while active:
        depth += 1
        split = []
        for name, above, members in active:
            parts: dict[tuple, list[int]] = {}
            for s in members:
                parts.setdefault(turns[s][depth], []).append(s)
            for (_, _, size), part in parts.items():
                n, at = sum(facts[s][0] for s in part), len(nodes)
                end = [s for s in part if facts[s][1] == depth]
                nodes.append([part[0], depth, name, n, 0, 0, (n - 1) * size, end[0] if end else None, above])
                on = [s for s in part if facts[s][1] > depth]
                if len(on) == 1:  # retired: a unary chain
                    (s,), parent = on, part[0]
                    w, last = facts[s]
                    for d in range(depth + 1, last + 1):
                        nodes.append([s, d, parent, w, 0, 0, (w - 1) * turns[s][d][2], s if d == last else None, at])
                        parent, at = s, len(nodes) - 1
                elif on:
                    split.append((part[0], at, on))
        active = split
    for x in reversed(nodes):  # fold back: an entry stands after its parent's
        x[5] = x[5] or 1
        if x[8] >= 0:
            p = nodes[x[8]]
            p[4], p[5], p[6] = p[4] + 1, p[5] + x[5], p[6] + x[6]
    return [x[:8] for x in nodes]


#: Rows of a batch that a task passes on.
_ROWS = 20_000


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _refined(batches):
    """Rows (cls, from, seq, w, len, depth, k1, k2, size) in order of the first two: the nodes below each class, and whether they are its children."""
    at, held, out = None, [], []

    def done():
        return [[*x, x[1] == at[1] + 1] for x in refine(*at, held)] if held else []

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[:2] != at:
                out += done()
                at, held = r[:2], []
                if len(out) > _ROWS:
                    yield _batch(out, _BELOW)
                    out = []
            held.append(r[2:])
    yield _batch(out + done(), _BELOW)


def _id_runs(batches):
    """Rows (seq, conv) in order: the ids of a sequence joined in runs, (seq, first, ids)."""
    seq, first, held, size, out, total = None, None, [], 0, [], 0
    for b in batches:
        for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if s != seq or size > _RUN:
                if held:
                    out.append((seq, first, ",".join(held)))
                    total += size
                seq, first, held, size = s, c, [], 0
                if len(out) > _ROWS or total > 4 * _RUN:
                    yield _batch(out, _RUNS)
                    out, total = [], 0
            held.append(str(c))
            size += len(held[-1]) + 1
    yield _batch(out + ([(seq, first, ",".join(held))] if held else []), _RUNS)


def _hash_runs(batches):
    """Runs in order of (seq, first): the SHA-256 of each sequence's ids, joined by commas."""
    seq, h = None, None
    for b in batches:
        out = []
        for s, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if s != seq:
                if h:
                    out.append((seq, h.hexdigest()))
                seq, h = s, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield _batch(out, _ENDS)
    if h:
        yield _batch([(seq, h.hexdigest())], _ENDS)


def finished(members: DataFrame) -> DataFrame:
    """(seq, ends_sha256) of (seq, conv)."""
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = members.select("seq", "conv").repartitionByRange(tasks, "seq", "conv").sortWithinPartitions("seq", "conv").mapInArrow(_id_runs, _RUNS)
    return runs.repartition(tasks, "seq").sortWithinPartitions("seq", "first").mapInArrow(_hash_runs, _ENDS)


def build(rows: DataFrame, convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of conversations: rows (conv, depth, k1, k2, size, rest), depth from 1, and convs (conv, len), those without turns too.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node.
    """
    spark = rows.sparkSession
    rows, path = materialize(rows, "rebuilt")
    members, _ = materialize(sequences(rows, convs), "members")
    rows = _by_depth(rows, members)
    remove(spark, path)
    root = members.agg(F.min("conv").alias("cls"), F.count("*").alias("n"), F.max(F.when(F.col("len") == 0, F.col("seq"))).alias("end")).first()
    if not root.n:
        return spark.createDataFrame([], _NODE.replace("end_seq long", "ends_sha256 string"))
    kind = F.when(F.col("on") == 1, "tail").when(F.col("left") <= local, "local").otherwise("split").alias("kind")
    levels = [spark.createDataFrame([(root.cls, 0, None, root.n, 0, root.end)], "conv_id long, depth long, parent_conv_id long, n_convs long, saved long, end_seq long")]
    active = members.where((F.col("conv") == F.col("seq")) & (F.col("len") > 0)).select(F.lit(root.cls).cast("long").alias("cls"), "seq", "len", "w")
    active = active.crossJoin(F.broadcast(active.agg(F.count("*").alias("on"), F.sum("len").alias("left")).select(kind)))  # one row
    active, _ = materialize(active, "active")
    gone, d = [], 0
    while True:
        gone.append(active.where("kind <> 'split'").withColumn("from", F.lit(d).cast("long")))
        active = active.where("kind = 'split'").drop("kind")
        if not active.head(1):
            break
        d += 1
        met, path = materialize(active.join(rows.where(F.col("depth") == d).select("seq", *_TURN), "seq"), "turns")
        by, on = ["cls", *_TURN], F.col("len") > d
        part = met.groupBy(*by).agg(
            F.min("seq").alias("conv_id"), F.sum("w").alias("n_convs"), F.max(F.when(~on, F.col("seq"))).alias("end_seq"), F.count(F.when(on, 1)).alias("on"), F.sum(F.col("len") - d).alias("left"),
        )
        part, _ = materialize(part.select("*", kind), "parts")
        levels.append(part.select("conv_id", F.lit(d).cast("long").alias("depth"), F.col("cls").alias("parent_conv_id"), "n_convs", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), "end_seq"))
        active, _ = materialize(met.where(on).join(part.select(*by, "conv_id", "kind"), by).select(F.col("conv_id").alias("cls"), "seq", "len", "w", "kind"), "active")
        remove(spark, path)
    below, _ = materialize(_below(rows, _all(gone)), "below")
    return _with_ends(_folded(levels, below), finished(members))


def _by_depth(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The turns of one conversation of each sequence, stored in order of depth, so a round reads its depth's row groups."""
    own = members.where(F.col("conv") == F.col("seq")).select(F.col("seq").alias("conv"))
    own = rows.join(own, "conv").withColumnRenamed("conv", "seq")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(own.repartitionByRange(tasks, "depth", "seq").sortWithinPartitions("depth", "seq"), "depths")[0]


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _below(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The nodes below the classes that left the rounds, sums and all."""
    met = rows.join(gone, "seq").where(F.col("depth") > F.col("from"))
    last, first = F.col("depth") == F.col("len"), F.col("depth") == F.col("from") + 1
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    tail = met.where("kind = 'tail'").select(
        F.col("seq").alias("conv_id"), "depth", F.when(first, F.col("cls")).otherwise(F.col("seq")).alias("parent_conv_id"), F.col("w").alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), ((F.col("w") - 1) * F.col("rest")).alias("saved_tokens"), F.when(last, F.col("seq")).alias("end_seq"), first.alias("top"),
    )
    few = met.where("kind = 'local'").select("cls", "from", "seq", "w", "len", "depth", *_TURN)
    few = few.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cls", "from").sortWithinPartitions("cls", "from")
    return tail.unionByName(few.mapInArrow(_refined, _BELOW))


def _folded(levels: list[DataFrame], below: DataFrame) -> DataFrame:
    """All nodes: from the deepest round to the root, each takes in what its children have summed up."""
    tops = below.where("top").select("depth", F.col("parent_conv_id").alias("conv_id"), "n_leaves", "saved_tokens")
    out, deeper = [below.drop("top")], None
    for d in range(len(levels) - 1, -1, -1):
        child = tops.where(F.col("depth") == d + 1).drop("depth")
        if deeper is not None:
            child = child.unionByName(deeper.select(F.col("parent_conv_id").alias("conv_id"), "n_leaves", "saved_tokens"))
        sums = child.groupBy("conv_id").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("sum"))
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        node = levels[d].join(sums, "conv_id", "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", one).alias("n_leaves"), (F.col("saved") + F.coalesce("sum", zero)).alias("saved_tokens"), "end_seq",
        )
        deeper, _ = materialize(node, "folded")
        out.append(deeper)
    return _all(out)


def _with_ends(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """end_seq replaced by the hash of the ids that end there; nodes where none ends aren't joined."""
    none = hashlib.sha256().hexdigest()
    some = nodes.where("end_seq is not null").join(ends.withColumnRenamed("seq", "end_seq"), "end_seq").drop("end_seq")
    return some.unionByName(nodes.where("end_seq is null").drop("end_seq").withColumn("ends_sha256", F.lit(none)))


def prefix_trie(conversations: DataFrame, rebuild: Callable = plain, local: int = LOCAL) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text). rebuild: `plain`, or `grafted`."""
    turns, _ = materialize(numbered(digested(conversations)), "numbered")
    return build(*rebuild(turns), local)


# The query in SQL: CRC-32 bit by bit (-1 stands for one shift), nodes by the joined digests of their turns, subtrees by their nodes' smallest members.
_SHIFTS = "flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: [ascii(substr(c::VARCHAR, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))"
_CRC = f"xor(list_reduce({_SHIFTS}, lambda x, o: CASE WHEN o >= 0 THEN xor(x, o) ELSE xor(x >> 1, (x & 1) * 3988292384) END, 4294967295::BIGINT), 4294967295::BIGINT)"
TRIE_SQL = f"""
WITH t AS (SELECT conv_id::BIGINT AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, k, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS pos
  FROM (SELECT c, turn, sha256(octet_length(encode(role)) || ':' || role || text) AS k, octet_length(encode(text))::BIGINT AS size FROM t)),
i AS (SELECT c, c - c % {GROUP} AS base, {_CRC} % {SHARED + 1} AS h FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT i.c, o.pos, k, size FROM i JOIN o ON o.c = i.base AND o.pos <= i.h UNION ALL SELECT i.c, o.pos, k, size FROM i JOIN o ON o.c = i.c AND o.pos > i.h),
b AS (SELECT c, row_number() OVER w AS d, size, string_agg(k, '') OVER w AS p FROM r WINDOW w AS (PARTITION BY c ORDER BY pos)),
m AS (SELECT *, max(d) OVER (PARTITION BY c) AS n_turns, lag(p) OVER (PARTITION BY c ORDER BY d) AS parent FROM (SELECT * FROM b UNION ALL SELECT c, 0, 0, '' FROM i)),
n AS (SELECT p, d, min(c) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = n_turns), '')) AS ends_sha256 FROM m GROUP BY p, d),
k AS (SELECT x.p, count(y.p) AS n_children FROM n x LEFT JOIN n y ON y.parent = x.p GROUP BY x.p),
s AS (SELECT m.p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM n JOIN k USING (p) JOIN m ON m.c = n.conv_id AND m.d <= n.d GROUP BY m.p)
SELECT n.conv_id, n.d AS depth, a.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN k USING (p) JOIN s USING (p) LEFT JOIN n a ON a.p = n.parent"""
