"""N-gram Jaccard join: MinHash LSH forest with exact verification.

1. Each text becomes the set of hashes of its shingles of five words (lower-cased, between white space; a text of one
   to four words has one shingle). Texts with one set form a class, represented by one of its texts.
2. Each class has one label per tree: LEVELS independent MinHashes of BITS bits, read as a path in a prefix trie.
3. All labels are sorted by (tree, label), dealt by range, so a hot prefix lies in as many tasks as it fills. A sorted run is a trie:
   labels that share d levels are neighbours. Each label learns the size and the smallest class of its node on every level; where a
   node reaches across tasks, one row per task and end completes it. Labels alone under their shortest prefix meet nothing and go.
4. Each text starts at its longest prefixes and shortens them tree by tree, one level at a time, until its recall is reached: a pair at
   the threshold s is missed in a tree of matched depth d with probability 1 - s**d, so over all trees with the product. The
   cheapest step comes first: nodes of up to CROWD classes cost nothing, larger ones what they hold, by gain. So a text under a crowded prefix
   (a passage that many texts share) keeps that prefix long and shortens others further, and texts end at different depths.
5. Texts under a node that one of them has come down to are linked to the node's smallest; connected components of these links
   hold all pairs that meet. Small components share tasks.
6. A component too large for one task gets a representative, the class that meets most others, and each member its exact difference from it:
   a of the representative's r shingles are missing, b are new. Whatever else they hold, two members are linked if the sum of their
   a + s*b is (1 - s)*r at most, since they then have r - a - a' shingles in common of r + b + b' at most. So members are dealt to
   zones of that sum, links between zones that are sure are counted from the zones' sizes, and only pairs of zones that may hold other pairs
   become tasks, by tiles of bounded size. A family of close copies needs no pairs at all.
7. A task sorts its labels into tries again. A text's candidates are the texts under its nodes, with prefixes shortened to RECALL_INSIDE. Of texts
   made from one template most pairs meet there, far from the threshold; so a candidate's labels are compared on all levels of all trees, and one that
   agrees on fewer than a pair at the threshold does but once in 1 / MISSED times goes. The others are verified by the exact Jaccard similarity of the
   two shingle sets. A task returns, per class, how many documents it is linked
   with and a spanning link, never a list of pairs; so a large group of near copies gives rows in proportion to its classes.
8. Connected components of the spanning links are the groups.

Result, one row per doc_id: class_id (smallest id with the same shingles), n_links (other documents linked directly, copies included),
component_id (smallest id reachable), kept (doc_id = component_id). Ids may be of any type that can be ordered.

Edge cases: rows that repeat a doc_id are one document, that of the smallest set key; a null id forms rows of its own
without links (kept); null, empty and all-white-space texts have no shingles and link with nothing, not even each
other; very long texts only make larger sets; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import hashing
from loomtext.llm.common import by_bytes, connected_components, materialize, remove, smallest, whole_row

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Inside a component prefixes are shortened further, to this recall: few labels are left to compare.
RECALL_INSIDE = 1 - 1e-7
TREES, LEVELS, BITS = 24, 6, 10
#: The chance that the comparison of all levels rejects a pair at the threshold.
MISSED = 1e-10
#: Up to so many classes under a node cost nothing when prefixes are shortened.
CROWD = 64
#: Shingles and classes in a tile; a task holds two tiles.
TILE, CLASSES = 1_500_000, 3_000
#: Zones of the members of a large component, by their difference from its representative; one more is for those too far for sure links.
ZONES = 8

_FACTORS = hashing.mix(np.arange(1, TREES * LEVELS + 1, dtype=np.uint64)) | np.uint64(1)


def depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, levels: int = LEVELS) -> int:
    """The longest prefix that, matched in all trees alike, finds a pair at the threshold with the recall; 1 if none does."""
    for d in range(levels, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def shortest(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The level below which no prefix is shortened: one above the depth that suffices in all trees, which leaves room to
    keep some prefixes long."""
    return max(1, depth(threshold, recall) - 1)


def shorten(sizes: np.ndarray, threshold: float = THRESHOLD, recall: float = RECALL, crowd: int = CROWD) -> np.ndarray:
    """Matched depths, texts x trees. sizes: texts x trees x levels from LEVELS down to shortest(), classes under each node.

    A step shortens one tree's prefix of one text by a level. Steps are taken by cost per gain, of equal ones the longer prefixes and then the
    first trees, until the gains (the logarithm of the chance to miss a pair at the threshold) reach the target, or none is left.
    """
    n, trees, levels = sizes.shape
    miss = -np.log1p(-(threshold ** np.arange(LEVELS, LEVELS - levels, -1.0)))  # by level, rising
    gain = np.diff(miss)
    if not levels - 1 or not n:
        return np.full((n, trees), LEVELS)
    cost = np.where(sizes > crowd, sizes, 0).astype(float)
    ratio = np.maximum.accumulate(np.maximum(np.diff(cost, axis=2), 0) / gain, axis=2)  # a tree's steps stay in order
    step = np.broadcast_to(np.arange(levels - 1), ratio.shape)
    tree = np.broadcast_to(np.arange(trees)[:, None], ratio.shape)
    flat = lambda x: x.reshape(n, -1)
    order = np.lexsort((flat(tree), flat(step), flat(ratio)), axis=-1)
    need = -np.log1p(-recall) - trees * miss[0]
    total = np.cumsum(gain[np.take_along_axis(flat(step), order, axis=1)], axis=1)
    used = np.concatenate([np.full((n, 1), need > 0), total[:, :-1] < need - 1e-12], axis=1)
    out = np.full((n, trees), LEVELS)
    at, k = np.nonzero(used)
    np.subtract.at(out, (at, flat(tree)[at, order[at, k]]), 1)
    return out


def labels_of(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Trie labels, texts x TREES, as signed 64-bit integers; the first level is the highest. Texts without
    shingles have 0."""
    some = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, TREES), dtype=np.uint64)
    if len(some):
        starts = at[:-1][some]
        for t in range(TREES):
            label = np.zeros(len(some), dtype=np.uint64)
            for k in range(LEVELS):
                low = np.minimum.reduceat(g * _FACTORS[t * LEVELS + k] >> np.uint64(32), starts)
                label = label << np.uint64(BITS) | hashing.mix(low) & np.uint64((1 << BITS) - 1)
            out[some, t] = label
    return out.view(np.int64)


def set_keys(g: np.ndarray, at: np.ndarray):
    """For each text its sorted set of shingles and the set's key, two 64-bit halves of a digest."""
    for i in range(len(at) - 1):
        s = np.unique(g[at[i] : at[i + 1]])
        k = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
        yield s, int.from_bytes(k[:8], "little", signed=True), int.from_bytes(k[8:], "little", signed=True)


def _lists(values: np.ndarray, width: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(np.ascontiguousarray(values).ravel()))


def _signatures(batches):
    for b in by_bytes(batches, "text"):
        h, at, _ = hashing.words(b.column("text").to_pylist())
        g, at = hashing.shingles(h, at, NGRAM)
        keys = list(set_keys(g, at))
        n = np.array([len(s) for s, _, _ in keys], dtype=np.int64)
        b = b.drop_columns(["text"])
        own = [pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64()), pa.array(n), _lists(labels_of(g, at), TREES)]
        yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*b.schema.names, "k1", "k2", "n", "labels"])


def _sets(batches):
    for b in by_bytes(batches, "text"):
        h, at, _ = hashing.words(b.column("text").to_pylist())
        sets, k1, k2 = zip(*set_keys(*hashing.shingles(h, at, NGRAM)), strict=True)
        on = (np.array(k1) == b.column("k1").to_numpy()) & (np.array(k2) == b.column("k2").to_numpy())
        out = b.drop_columns(["text"]).append_column("shingles", pa.array([s.tobytes() for s in sets], pa.binary()))
        yield out.filter(pa.array(on))


def _shift(d: int) -> int:
    """Bits below the first d levels of a label."""
    return BITS * (LEVELS - d)


def _trie(low: int):
    """One task's sorted labels: rows (cls, tree, label, part, sizes, leads, head, tail), by level from LEVELS to `low`. head and tail are
    the numbers of levels, counted from `low` up, on which the row's node holds the task's first or last label: such a node may go on in
    the neighbouring task. Labels alone on level `low`, and surely so, are left out."""
    depths = list(range(LEVELS, low - 1, -1))

    def run(batches):
        got = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if got is None:
            return
        cls, tree, label, part = (got.column(c).to_numpy() for c in ("cls", "tree", "label", "part"))
        n = len(cls)
        size, lead, node = (np.empty((n, len(depths)), dtype=np.int64) for _ in range(3))
        for k, d in enumerate(depths):
            key = label >> _shift(d)
            new = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(tree) != 0)])
            node[:, k] = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            size[:, k] = np.diff(np.append(starts, n))[node[:, k]]
            lead[:, k] = np.minimum.reduceat(cls, starts)[node[:, k]]
        head, tail = (node == node[0]).sum(axis=1), (node == node[-1]).sum(axis=1)
        on = np.flatnonzero((size[:, -1] > 1) | (head > 0) | (tail > 0))
        edge = np.zeros(n, dtype=bool)
        edge[[0, -1]] = True
        for i in range(0, len(on), 65536):
            o = on[i : i + 65536]
            cols = [pa.array(x[o]) for x in (cls, tree, label, part)]
            yield pa.RecordBatch.from_arrays([*cols, _lists(size[o], len(depths)), _lists(lead[o], len(depths)), pa.array(head[o].astype(np.int32)), pa.array(tail[o].astype(np.int32)), pa.array(edge[o])], names=["cls", "tree", "label", "part", "sizes", "leads", "head", "tail", "edge"])

    return run


def _across(ends: list, low: int) -> list[tuple]:
    """(part, end, size, lead) of nodes that reach across tasks; end: twice the index of the level, and 1 more if it is the last label's node
    and not the first one's. ends: of each task, in order, its first and last label as (part, tree, label, sizes, leads)."""
    out, levels = [], LEVELS - low + 1
    for k in range(levels):
        shift, held = _shift(LEVELS - k), None  # held: key, size, lead, the ends that belong to it

        def close():
            if held and len(held[3]) > 1:
                out.extend((p, 2 * k + end, held[1], held[2]) for p, end in held[3])

        for first, last in ends:
            key = (first[1], first[2] >> shift)
            if held and held[0] == key:
                held = (key, held[1] + first[3][k], min(held[2], first[4][k]), [*held[3], (first[0], 0)])
            else:
                close()
                held = (key, first[3][k], first[4][k], [(first[0], 0)])
            if (last[1], last[2] >> shift) != key:
                close()
                held = ((last[1], last[2] >> shift), last[3][k], last[4][k], [(last[0], 1)])
        close()
    return out


def _descend(low: int, threshold: float, recall: float):
    """Rows (cls, nodes) with one list of (tree, label, sizes, leads) -> rows (cls, tree, label, leads, met, depth)."""
    levels = LEVELS - low + 1

    def run(batches):
        for b in batches:
            n, nodes = b.num_rows, b.column("nodes")
            if not n:
                continue
            owner = np.repeat(np.arange(n), np.diff(nodes.offsets.to_numpy()))
            x = nodes.flatten()
            tree, label = x.field("tree").to_numpy(), x.field("label")
            sizes, found = np.ones((n, TREES, levels), dtype=np.int64), x.field("sizes").flatten().to_numpy().reshape(-1, levels)
            sizes[owner, tree] = found
            d = shorten(sizes, threshold, recall)[owner, tree]
            yield pa.RecordBatch.from_arrays([b.column("cls").take(pa.array(owner)), x.field("tree"), label, x.field("leads"), pa.array(np.ascontiguousarray(found[:, -1])), pa.array(d.astype(np.int32))], names=["cls", "tree", "label", "leads", "met", "depth"])

    return run


def forest(reps: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(cls, tree, label, leads, met, depth) for each label that meets others: the depth its text has come down to in that tree, the smallest
    class under its node on each level, and the number of classes under the highest one. reps: (cls, labels)."""
    spark, low = reps.sparkSession, shortest(threshold, recall)
    levels, parts = LEVELS - low + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = reps.select("cls", F.posexplode("labels").alias("tree", "label"))
    rows = rows.repartitionByRange(parts, "tree", "label", "cls").sortWithinPartitions("tree", "label", "cls").withColumn("part", F.spark_partition_id())
    trie, path = materialize(rows.mapInArrow(_trie(low), "cls long, tree int, label long, part int, sizes array<long>, leads array<long>, head int, tail int, edge boolean"), "trie")
    ends: dict = {}
    for r in trie.where("edge").select("part", "tree", "label", "sizes", "leads").collect():  # two rows a task
        ends.setdefault(r.part, []).append(tuple(r))
    pairs = [(min(v, key=lambda x: x[1:3]), max(v, key=lambda x: x[1:3])) for _, v in sorted(ends.items())]
    fix = spark.createDataFrame(_across(pairs, low), "part int, at int, size long, lead long")
    fix = fix.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("size", "lead")))).alias("fix"))
    trie = trie.join(F.broadcast(fix), "part", "left")  # a row a task, of a few numbers

    def mended(name: str):
        own = lambda k, end, first: F.when(k >= levels - F.col(end), F.try_element_at("fix", 2 * k + first)[name])
        return F.transform(name + "s", lambda v, k: F.coalesce(own(k, "head", 0), own(k, "tail", 1), v))

    trie = trie.select("cls", "tree", "label", mended("size").alias("sizes"), mended("lead").alias("leads")).where(F.get("sizes", F.lit(levels - 1)) > 1)
    nodes = trie.groupBy("cls").agg(F.collect_list(F.struct("tree", "label", "sizes", "leads")).alias("nodes"))  # a row a tree at most
    down, _ = materialize(nodes.mapInArrow(_descend(low, threshold, recall), "cls long, tree int, label long, leads array<long>, met long, depth int"), "forest")
    remove(spark, path)
    return down


def _stars(down: DataFrame, low: int) -> DataFrame:
    """(u, v): each class and the smallest under the shortest node above it that some class has come down to."""
    lead = lambda d: F.get("leads", LEVELS - d)
    found = down.select(F.col("cls").alias("u"), lead(F.col("depth")).alias("v"))
    for d in range(low, LEVELS):
        node = ["tree", F.shiftrightunsigned("label", _shift(d)).alias("prefix")]
        opened, _ = materialize(down.where(F.col("depth") <= d).select(*node).distinct(), "opened")
        more = down.where(F.col("depth") > d).select("cls", *node, lead(F.lit(d)).alias("v")).join(opened, ["tree", "prefix"], "left_semi")
        found = found.union(more.select("cls", "v"))
    return found.where("u <> v").distinct()


@functools.cache
def least_agreeing(threshold: float, missed: float = MISSED, of: int = TREES * LEVELS) -> int:
    """The levels on which a pair at the threshold agrees at least, but for the chance `missed`."""
    p = threshold + (1 - threshold) / (1 << BITS)  # different MinHashes agree in BITS bits now and then
    tail = 0.0
    for c in range(of + 1):
        tail += math.comb(of, c) * p**c * (1 - p) ** (of - c)
        if tail > missed:
            return c
    return of


def _fields(labels: np.ndarray) -> np.ndarray:
    """Labels as their MinHashes: texts x levels of all trees."""
    at = np.arange(LEVELS, dtype=np.uint64) * np.uint64(BITS)
    return (labels[:, :, None] >> at & np.uint64((1 << BITS) - 1)).astype(np.uint16).reshape(len(labels), -1)


def _verify(d: int, threshold: float):
    shift, agreeing = np.uint64(_shift(d)), least_agreeing(threshold)

    def run(table: pa.Table) -> pa.Table:
        """One task: all classes of tiles a and b. Links within a == b, else between the two."""
        ids, first = np.unique(table.column("cls").to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        tile, mult = table.column("tile").to_numpy(), table.column("mult").to_numpy()
        lab = table.column("labels").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, TREES)
        fields, lab = _fields(lab), lab >> shift
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        flat, back = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(len(flat), dtype=np.int32)
        one, two = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
        links, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        # the tries of tile b: labels sorted tree by tree, and of each label of tile a the run under its node
        order = np.argsort(lab[two], axis=0, kind="stable")
        line = np.take_along_axis(lab[two], order, axis=0)
        low = np.stack([np.searchsorted(line[:, t], lab[one, t], "left") for t in range(TREES)], axis=1)
        high = np.stack([np.searchsorted(line[:, t], lab[one, t], "right") for t in range(TREES)], axis=1)
        order, met = np.ascontiguousarray(order.T), np.zeros(len(two), dtype=bool)
        for k, i in enumerate(one):
            met[:] = False
            for t in np.flatnonzero(high[k] > low[k]):
                met[order[t, low[k, t] : high[k, t]]] = True
            other = two[met]
            if a == b:
                other = other[other > i]
            other = other[np.minimum(sizes[other], sizes[i]) >= threshold * np.maximum(sizes[other], sizes[i])]
            other = other[(fields[other] == fields[i]).sum(axis=1) >= agreeing]
            if not len(other):
                continue
            mine = back[at[i] : at[i + 1]]
            mark[mine] = 1
            n = sizes[other]
            where = np.repeat(at[other] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.add.reduceat(mark[back[where]], np.concatenate([[0], np.cumsum(n)[:-1]]))
            mark[mine] = 0
            hit = other[common >= threshold * (n + sizes[i] - common) - 1e-9]
            links[i] += mult[hit].sum()
            links[hit] += mult[i]
            for j in hit:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)  # ids are sorted: the smaller index is the smaller id
        on = np.flatnonzero(links)
        return pa.table({"cls": ids[on], "root": ids[[root(i) for i in on]] if len(on) else ids[:0], "links": links[on]})

    return run


def _zone(threshold: float):
    """Rows (cls, grp, root, mult, n, shingles, base) -> (cls, grp, root, mult, n, zone): where a member stands to the representative `root`, whose
    shingles are `base`."""

    def run(batches):
        for b in batches:
            zones = []
            for x, base in zip(b.column("shingles").to_pylist(), b.column("base").to_pylist(), strict=True):
                x, base = np.frombuffer(x, dtype=np.uint64), np.frombuffer(base, dtype=np.uint64)
                common = len(np.intersect1d(x, base, assume_unique=True))
                share = (len(base) - common + threshold * (len(x) - common)) / ((1 - threshold) * len(base))
                zones.append(min(ZONES + 1, math.ceil(ZONES * share)))
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["shingles", "base"]).columns, pa.array(zones, pa.int32())], names=["cls", "grp", "root", "mult", "n", "zone"])

    return run


def _large(full: DataFrame, central: DataFrame, threshold: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """Large components: (own, a, b, cls, mult, tile, labels, shingles) of the pairs of tiles that have to be looked at, and (cls, root, links) of the
    links that are sure. full: (cls, grp, mult, n, labels, shingles); central: (cls, met)."""
    best = full.select("cls", "grp").join(central, "cls").groupBy("grp").agg(F.max_by("cls", F.struct("met", -F.col("cls"))).alias("root"))
    base = best.join(full.select(F.col("cls").alias("root"), F.col("shingles").alias("base")), "root")
    base, _ = materialize(base.dropDuplicates(["grp"]), "representatives")  # a row a component
    rows = full.select("cls", "grp", "mult", "n", "shingles").join(base, "grp").select("cls", "grp", "root", "mult", "n", "shingles", "base")
    rows = rows.mapInArrow(_zone(threshold), "cls long, grp long, root long, mult long, n long, zone int")
    rows, _ = materialize(rows.dropDuplicates(["cls"]), "zones")  # of a text that stands in several rows one

    zones = rows.groupBy("grp", "zone").agg(F.sum("n").alias("w"), F.count("*").alias("c"), F.sum("mult").alias("m"))
    zones = zones.select("grp", "zone", "m", F.ceil(F.greatest(F.col("w") / tile, F.col("c") / CLASSES)).cast("int").alias("tiles"))
    others = zones.groupBy("grp").agg(F.collect_list(F.struct("zone", "m", "tiles")).alias("all"))  # ZONES + 2 entries at most
    plan = zones.drop("m").join(others, "grp")
    number = lambda zone, i: zone * (1 << 24) + i
    sure = F.aggregate(F.filter("all", lambda z: z["zone"] + F.col("zone") <= ZONES), F.lit(0).cast("long"), lambda t, z: t + z["m"])
    open_ = F.filter("all", lambda z: z["zone"] + F.col("zone") > ZONES)
    meets = F.flatten(F.transform(open_, lambda z: F.transform(F.sequence(F.lit(0), z["tiles"] - 1), lambda i: number(z["zone"], i))))
    plan, _ = materialize(plan.select("grp", "zone", "tiles", sure.alias("sure"), meets.alias("meets")), "plan")
    placed = rows.join(plan, ["grp", "zone"])
    placed = placed.withColumn("tile", number(F.col("zone"), F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")))
    links = F.col("sure") - F.when(2 * F.col("zone") <= ZONES, F.col("mult")).otherwise(0)  # not with itself
    known = placed.select("cls", "root", links.alias("links")).where("links > 0")
    pairs = placed.where(F.size("meets") > 0).select("cls", F.col("grp").alias("own"), "tile", "meets").join(full.select("cls", "mult", "labels", "shingles"), "cls")
    pairs = pairs.select("own", "cls", "mult", "tile", "labels", "shingles", F.explode("meets").alias("x"))
    return pairs.select("own", F.least("tile", "x").alias("a"), F.greatest("tile", "x").alias("b"), "cls", "mult", "tile", "labels", "shingles"), known


def _links(got: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float, recall: float, tile: int) -> DataFrame:
    """(cls, root, links) of linked classes. got: (rep, k1, k2, n, labels) of the texts (rep, text); classes: (cls, rep,
    k1, k2, mult), where cls is a class's own number and rep, with the set key, finds its text."""
    # labels follow from the set key; they are fetched for the representative alone
    reps = classes.join(got.where("n > 0"), ["rep", "k1", "k2"]).groupBy("cls", "rep", "k1", "k2", "mult", "n").agg(F.first("labels").alias("labels"))
    reps, stored = materialize(reps, "classes")
    down = forest(reps, threshold, recall)
    groups = connected_components(_stars(down, shortest(threshold, recall))).select(F.col("node").alias("cls"), F.col("component").alias("grp"))
    members, path = materialize(reps.join(groups, "cls"), "members")
    remove(reps.sparkSession, stored)
    weight = members.groupBy("grp").agg(F.sum("n").alias("w"), F.count("*").alias("c"))
    weight = weight.withColumn("large", (F.col("w") > tile) | (F.col("c") > CLASSES))
    total, any_large = weight.agg(F.sum(F.col("w") + 64 * F.col("c")), F.max("large")).first()
    bundles = max(1, math.ceil(4 * (total or 0) / tile))  # small groups share tasks of a quarter of a tile
    full = members.join(weight.select("grp", "large"), "grp").select("cls", "rep", "k1", "k2", "grp", "mult", "n", "labels", "large").join(texts, "rep").drop("rep")
    full = full.mapInArrow(_sets, "cls long, k1 long, k2 long, grp long, mult long, n long, labels array<long>, large boolean, shingles binary").drop("k1", "k2")
    done = [path]
    if any_large:
        full, path = materialize(full, "member-sets")
        done.append(path)
    bundle = -1 - F.pmod(F.xxhash64("grp"), F.lit(bundles))
    zero = F.lit(0).cast("int")
    pairs = full.where("not large").select(bundle.alias("own"), zero.alias("a"), zero.alias("b"), "cls", "mult", zero.alias("tile"), "labels", "shingles")
    if any_large:
        more, known = _large(full.where("large"), down.groupBy("cls").agg(F.sum("met").alias("met")), threshold, tile)
        pairs = pairs.unionByName(more)
    inside = min(depth(threshold, recall), depth(threshold, RECALL_INSIDE))
    found = pairs.groupBy("own", "a", "b").applyInArrow(_verify(inside, threshold), "cls long, root long, links long")
    found, _ = materialize(found.union(known) if any_large else found, "links")
    remove(members.sparkSession, *done)
    return found


def _numbered(classes: DataFrame) -> DataFrame:
    """Classes with numbers of their own, stored: ids of any type stay out of the tasks."""
    return materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "numbered")[0]


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """doc_id, class_id, n_links, component_id, kept, for pairs with Jaccard similarity >= threshold."""
    kind = dict(docs.dtypes)["doc_id"]
    nulls = docs.where(F.col("doc_id").isNull()).select("doc_id")
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("rep"), "text")
    got, _ = materialize(texts.mapInArrow(_signatures, f"rep {kind}, k1 long, k2 long, n long, labels array<long>"), "sets")
    docs1 = got.groupBy(F.col("rep").alias("doc_id")).agg(F.min(F.struct("k1", "k2", "n")).alias("k")).select("doc_id", "k.k1", "k.k2", "k.n")
    keyed = docs1.where("n > 0")
    classes = _numbered(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult")))
    found = _links(got, classes, texts, threshold, recall, tile)

    comps = connected_components(found.select(F.col("cls").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cls")
    least = comps.join(classes, "cls").groupBy("component").agg(F.min("rep").alias("component_id"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    info = classes.join(links, "cls", "left").join(comps, "cls", "left").join(least, "component", "left")
    info = info.select("k1", "k2", F.col("rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = keyed.join(info, ["k1", "k2"]).select("doc_id", "class_id", "n_links", "component_id")
    alone = docs1.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    out = out.union(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    none = F.lit(None).cast(kind)
    return out.union(nulls.select(none, none, F.lit(0).cast("long"), none, F.lit(True)))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """The rows of docs that stay, one per group of rows with similar texts: that with the smallest doc_id, if it has any.

    Rows are compared by their own texts, whether they share a doc_id or have none. Of rows without words, which
    resemble nothing, those that repeat both doc_id and text are one; without an id all stay. Columns of any name and type go with
    their rows. docs is read more than once, so it should be a stored table.
    """
    i, h = F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))
    rep = F.xxhash64(i.cast("string"), F.when(i.isNull(), F.col("text")))
    keys = [i.alias("id"), h.alias("hash"), rep.alias("rep")]
    texts = docs.select(keys[2], "text")
    kind = dict(docs.dtypes)["doc_id"]
    got = docs.select(*keys, "text").mapInArrow(_signatures, f"id {kind}, hash string, rep long, k1 long, k2 long, n long, labels array<long>")
    got, _ = materialize(got, "sets")
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "hash", "rep")
    classes = got.where("n > 0").groupBy("k1", "k2").agg(F.min("rep").alias("rep"), F.min(row).alias("row"), F.count("*").alias("mult"))
    classes = _numbered(classes)
    found = _links(got.drop("id", "hash"), classes.drop("row"), texts, threshold, recall, tile)
    comps = connected_components(found.select(F.col("cls").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cls")
    keep = classes.join(comps, "cls", "left").groupBy(F.coalesce("component", "cls")).agg(F.min("row").alias("row")).select("row.id", "row.hash", "row.rep")
    blank = got.where("n = 0").select("id", "hash", "rep").distinct()
    keep = keep.union(blank.where("id is not null")).withColumnRenamed("id", "kept")
    # a row's own columns are compared by value, so copies of one row meet in one task as one row each
    all_rows = docs.select(*keys, whole_row(docs).alias("row"))
    once = all_rows.groupBy("id", "hash", "rep").agg(smallest(all_rows).alias("row"))
    out = once.join(keep, ["rep", "hash"]).where(F.col("id").eqNullSafe(F.col("kept"))).select("row.*")
    none = all_rows.where("id is null").join(blank.where("id is null").select("hash").distinct(), "hash", "left_semi")
    return out.unionByName(none.select("row.*"))
