"""Connected components and linking within buckets, without collecting or all-pairs expansion."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chunks, discarded, released, stored

#: Members of a bucket that one task compares with each other; larger buckets are dealt as blocks of about this size.
BLOCK = 1024
#: Share of the nodes from which large buckets are estimated, members there that make a bucket large, and how many such buckets are broadcast.
SAMPLE, LARGE, MOST_HINTS = 1 / 64, 32, 100_000
#: Members that a task packs at once; the binary logarithm of the most bits of a bitmap.
PACKED, MOST_BITS = 1 << 18, 26
#: Turns in which trees are made.
TURNS = 3
#: Pairs that are held at once in a task.
PAIRS = 1 << 21
#: Pairs that are tested at once in a bucket's task.
MOST_TESTED = 1 << 15
#: Bytes of one side of the pairs that are tested at once.
CHECKED = 4 << 20

Score = Callable[[np.ndarray, np.ndarray], np.ndarray]
Check = Callable[[list, list], np.ndarray]


# ---------------------------------------------------------------- components of all links


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for long columns a, b: the smallest node that links reach.

    Large-star and small-star steps until nothing changes: each hands every
    neighbour the smallest one, so a hub's links are spread over its
    neighbours, and the number of rounds is logarithmic.  Every step is an
    aggregation that combines before the shuffle and a join against one row per
    node, which Spark can split when a node is hot.  Only the last step's table
    is kept.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        before, old = state, e
        e = stored(small.select("x.u", "x.v").where("u <> v").distinct())
        discarded(old)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


# ---------------------------------------------------------------- linking within buckets


def dealt(nodes: DataFrame, members_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(bucket, salt, blocks, ...) for the members of all nodes: buckets that are large by a sample of the nodes are split by salt.

    The sample only decides which members meet in one task first; all other
    pairs of a split bucket are compared across its blocks later.
    """
    counts = members_of(nodes.sample(SAMPLE, seed=11)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE)
    hints = stored(counts.select("bucket", F.ceil(F.col("n") / SAMPLE / BLOCK).cast("int").alias("blocks")))
    if hints.count() <= MOST_HINTS:
        hints = F.broadcast(hints)  # its size has just been checked; beyond it, a shuffled join
    members = members_of(nodes).join(hints, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return members.withColumn("salt", F.pmod(F.xxhash64("cid", "bucket"), F.col("blocks")).cast("int"))


def large_buckets(nodes: DataFrame, members_of: Callable[[DataFrame], DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, sorted, that are large by the sample, and their blocks; where there are too many, the largest."""
    counts = members_of(nodes.sample(SAMPLE, seed=11)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE)
    found = sorted((r["bucket"], math.ceil(r["n"] / SAMPLE / BLOCK)) for r in counts.orderBy(F.desc("n"), "bucket").limit(MOST_HINTS).collect())
    return np.array([x for x, _ in found], np.int64), np.array([x for _, x in found], np.int32)


def meeting(nodes: DataFrame, records: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]], kind: np.dtype, hints: tuple[np.ndarray, np.ndarray], solve: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What ``solve`` makes of whole buckets (blocks of large ones, see ``dealt``) of two members or more, and of all blocks of large ones.

    ``records`` turns batches of nodes into arrays of members of type ``kind``,
    which has long fields bucket and cid.  They are shuffled packed, some
    hundreds to a row, as rows cost more than bytes; ``solve`` gets them as
    columns, with salt and blocks.
    """
    spark = nodes.sparkSession
    heaps = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    hints = spark.sparkContext.broadcast(hints)

    def salted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        large, own = hints.value
        blocks = np.ones(len(x), np.int32)
        if len(large):
            at = np.minimum(np.searchsorted(large, x["bucket"]), len(large) - 1)
            blocks = np.where(large[at] == x["bucket"], own[at], blocks)
        return (scrambled(x["cid"] ^ scrambled(x["bucket"]).view(np.int64)) % blocks.astype(np.uint64)).astype(np.int32), blocks

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in records(batches):
            held.append(x)
            n += len(x)
            if n >= PACKED:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(held)
        heap = (scrambled(x["bucket"] + salted(x)[0]) % np.uint64(heaps)).astype(np.int32)
        order = np.argsort(heap, kind="stable")
        x, heap = x[order], heap[order]
        edges = [0, *(np.flatnonzero(np.diff(heap)) + 1).tolist(), len(heap)]
        return pa.RecordBatch.from_arrays([pa.array(heap[edges[:-1]]), pa.array([x[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], names=["heap", "members"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, ("heap",)):
            x = np.frombuffer(b"".join(column(batch, "members").to_pylist()), kind)
            salt, blocks = salted(x)
            order = np.lexsort((salt, x["bucket"]))
            x, salt, blocks = x[order], salt[order], blocks[order]
            new = np.ones(len(x), bool)
            new[1:] = (x["bucket"][1:] != x["bucket"][:-1]) | (salt[1:] != salt[:-1])
            group = np.cumsum(new) - 1
            keep = (np.bincount(group)[group] > 1) | (blocks > 1)
            if keep.any():
                x, salt, blocks = x[keep], salt[keep], blocks[keep]
                rows = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[c])) for c in kind.names] + [pa.array(salt), pa.array(blocks)], names=[*kind.names, "salt", "blocks"])
                yield from solved(rows, np.unique(group[keep], return_inverse=True)[1], solve)

    return nodes.mapInArrow(pack, "heap int, members binary").repartition("heap").sortWithinPartitions("heap").mapInArrow(meet, schema)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A scrambling of 64-bit numbers."""
    x = np.ascontiguousarray(x).view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sieve(wanted: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Tells of longs whether they may be among the cids of ``wanted``, by a bitmap of bounded size: all that are, and few others."""
    bits = 1 << min(MOST_BITS, max(16, (8 * wanted.count()).bit_length()))
    place = F.pmod("cid", F.lit(bits))
    words = wanted.groupBy(F.floor(place / 64).cast("int").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(cid, {bits}L) % 64 as int)))").alias("set")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("set").to_numpy()
    table = wanted.sparkSession.sparkContext.broadcast(table)

    def holds(cid: np.ndarray) -> np.ndarray:
        at = cid & (bits - 1)
        return (table.value[at >> 6] >> (at & 63)) & 1 == 1

    return holds


def among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose cid is among those of ``wanted``: most others go by a bitmap of bounded size before anything is shuffled."""
    holds = sieve(wanted)

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(holds(column(batch, "cid").to_numpy())))

    return rows.mapInArrow(sift, rows.schema).join(wanted, "cid", "left_semi")


def link(members: DataFrame, sigs: DataFrame, score: Score, least: float, bodies_of: Callable[[DataFrame], DataFrame], check: Check) -> DataFrame:
    """(node, component) of members that share a bucket and pass the test; no link that would join two components is lost.

    ``members`` has (bucket, salt, blocks, cid) as from ``dealt``, ``sigs``
    (cid, sig binary); ``score(one, many)`` (rows of uint8) tells how near pairs
    seem, and pairs under ``least`` can't pass; ``bodies_of`` takes nodes (cid)
    and returns their bodies (cid, body), and ``check`` tells of lists of bodies
    which pairs hold.

    1. Each bucket (or block of a large one) hands on a tree of what seems near,
       the nearest first: a row per member at most, never the pairs.
    2. The trees' links are tested, each once, and components formed.
    3. A bucket is done if two members seem near at most, or if all are in one
       component.  In the others (and in large ones across their blocks) all
       pairs of different components that seem near are tested inside the task,
       each in the first bucket that both share, until none is left; it hands on
       a tree again.
    """
    spark = members.sparkSession
    # buckets in turns, so that the shuffle files of one turn are gone before the next
    turns = []
    for k in range(TURNS):
        rows = members.where(F.pmod("bucket", F.lit(TURNS)) == k).join(sigs.hint("shuffle_hash"), "cid").select("bucket", "salt", "blocks", "cid", "sig")
        turns.append(stored(rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt").mapInArrow(in_groups(("bucket", "salt"), forest_of(score, least)), TREE)))
        released(spark)
    trees = reduce(DataFrame.union, turns)
    pairs = stored(trees.where("b is not null").select("a", "b").distinct())
    split = trees.where("b is null").select("bucket", F.col("a").alias("cid"))
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("cid")).union(split.select("cid")).distinct())
    bodies = stored(bodies_of(wanted))
    both = pairs.join(bodies.select(F.col("cid").alias("b"), F.col("body").alias("bt")), "b")
    both = both.join(bodies.select(F.col("cid").alias("a"), F.col("body").alias("at")), "a")
    good = stored(both.select("a", "b", "at", "bt").mapInArrow(tested(check), "a long, b long"))
    discarded(pairs, wanted)
    released(spark)
    comps = connected_components(good)
    several = trees.where("b is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("links")).where("links > 1").select("bucket")
    seen = trees.where("b is not null").join(several, "bucket").select("bucket", F.explode(F.array("a", "b")).alias("cid")).union(split).distinct()
    named = seen.join(comps, F.col("cid") == F.col("node"), "left").select("bucket", "cid", F.coalesce("component", "cid").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    left = stored(named.join(mixed.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "bucket"))
    released(spark)
    if left.isEmpty():
        return comps
    # each with the buckets it is left in (never more than it has keys), so that a pair is tested in the first that both share
    shared = left.groupBy("cid").agg(F.array_sort(F.collect_list("bucket")).alias("buckets"))
    across = (
        left.join(shared, "cid")
        .join(sigs, "cid")
        .withColumn("own", F.pmod(F.xxhash64("cid", F.lit("across")), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "component", "buckets", "sig")
    )
    # a number of tasks is given, as few bytes mean much work here
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    met = lambda x: x.repartition(tasks, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    # only members that have something to test get their bodies
    hit = stored(met(across).mapInArrow(in_groups(("bucket", "i", "j"), open_members(score, least)), across.schema))
    released(spark)
    more = stored(met(hit.join(bodies, "cid")).mapInArrow(in_groups(("bucket", "i", "j"), links_of(score, least, check)), "a long, b long"))
    discarded(hit)
    comps = stored(joined_components(comps, more))
    discarded(*turns, bodies, left, good, more)
    return comps


def joined_components(comps: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) once more links (a, b) are added: only the components that they join are formed anew."""
    if more.isEmpty():
        return comps
    ends = more.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(comps, F.col("cid") == F.col("node"), "left")
    ends = stored(ends.select("cid", F.coalesce("component", "cid").alias("at"), F.col("node").isNull().alias("new")))
    between = more.join(ends.select(F.col("cid").alias("a"), F.col("at").alias("x")), "a").join(ends.select(F.col("cid").alias("b"), F.col("at").alias("y")), "b")
    roots = stored(connected_components(between.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    to = roots.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = comps.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return old.union(ends.where("new").select(F.col("cid").alias("node"), F.col("at").alias("component")).join(to, "component").select("node", F.col("to").alias("component")))


TREE = "bucket long, a long, b long"


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def matrix(sigs: pa.Array) -> np.ndarray:
    """Equal-length binaries as rows of bytes."""
    values = sigs.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def in_groups(keys: tuple[str, ...], solve: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch | None]):
    """A function for mapInArrow that calls ``solve`` with whole groups (rows sorted by the keys) and their numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in whole_groups(batches, keys):
            yield from solved(batch, group, solve)

    return run


def solved(batch: pa.RecordBatch, group: np.ndarray, solve: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """``solve`` for as many groups at once as have a bounded number of pairs."""
    size = np.bincount(group)
    part = (np.cumsum(size.astype(np.int64) ** 2) // PAIRS)[group]
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(group)]
    for at, end in zip(edges, edges[1:]):
        if (got := solve(batch.slice(at, end - at), group[at:end] - group[at])) is not None:
            yield got


def whole_groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut where a group ends, and the number of each row's group."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else joined_batches([held, batch])
        group = numbers(held, keys)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield held.slice(0, cut), group[:cut]
            held = held.slice(cut)
    if held is not None:
        yield held, numbers(held, keys)


def numbers(batch: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    change = np.zeros(batch.num_rows, bool)
    for k in keys:
        x = column(batch, k).to_numpy(zero_copy_only=False)
        change[1:] |= x[1:] != x[:-1]
    return np.cumsum(change)


def grouped(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Whole groups, one by one, from batches sorted by the keys."""
    for batch, group in whole_groups(batches, keys):
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        for at, end in zip(edges, edges[1:]):
            yield batch.slice(at, end - at)


def joined_batches(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def near_in_groups(group: np.ndarray, near: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (i, j, score) of one group that pass ``near(i, j)`` (which passes, and scores), at growing distances, all groups at once."""
    at, shift = np.arange(len(group)), 0
    while len(at):
        shift += 1
        at = at[at + shift < len(group)]
        at = at[group[at + shift] == group[at]]
        for part in np.array_split(at, len(at) // 50_000 + 1):
            if len(part):
                ok, s = near(part, part + shift)
                if ok.any():
                    yield part[ok], part[ok] + shift, s[ok]


def joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches when x[k] and y[k] are linked too."""
    while True:
        a, b = root[x], root[y]
        if (a == b).all():
            return root
        parent = np.arange(len(root))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        root = parent[root]


def best_of_each(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs in the order of preference: the places of each component's first one."""
    first = np.full(len(root), len(i))
    place = np.arange(len(i))
    np.minimum.at(first, root[i], place)
    np.minimum.at(first, root[j], place)
    return np.unique(first[first < len(i)])


def ordered(cid: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((np.maximum(cid[i], cid[j]), np.minimum(cid[i], cid[j]), -s))
    return i[order], j[order], s[order]


def forest(n: int, cid: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pairs of a spanning forest that takes the nearest first."""
    i, j, s = ordered(cid, i, j, s)
    root, out = np.arange(n), []
    ki, kj, place = i, j, np.arange(len(i))
    while len(ki):
        pick = best_of_each(root, ki, kj)
        out.append(place[pick])
        root = joined(root, ki[pick], kj[pick])
        go = root[ki] != root[kj]
        ki, kj, place = ki[go], kj[go], place[go]
    k = np.concatenate([*out, np.zeros(0, np.int64)]).astype(np.int64)
    return i[k], j[k], s[k]


def forest_of(score: Score, least: float):
    """(bucket, a, b): trees of what seems near in each block; a row without b for each member of a bucket in several blocks."""

    def solve(batch: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch | None:
        cid, bucket, sig = column(batch, "cid").to_numpy(), column(batch, "bucket").to_numpy(), matrix(column(batch, "sig"))

        def near(i, j):
            s = score(sig[i], sig[j])
            return s >= least, s

        held, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        for found in near_in_groups(group, near):
            held.append(found)
            n += len(found[0])
            if n > PAIRS:
                held = [forest(len(cid), cid, *(np.concatenate(x) for x in zip(*held)))]
                n = 0
        i, j, _ = forest(len(cid), cid, *(np.concatenate(x) for x in zip(*held)))
        large = np.flatnonzero(column(batch, "blocks").to_numpy() > 1)
        if not len(i) + len(large):
            return None
        b = np.maximum(cid[i], cid[j]).tolist() + [None] * len(large)
        return pa.RecordBatch.from_arrays([pa.array(np.append(bucket[i], bucket[large])), pa.array(np.append(np.minimum(cid[i], cid[j]), cid[large])), pa.array(b, pa.int64())], names=["bucket", "a", "b"])

    return solve


def open_pairs(score: Score, least: float, batch: pa.RecordBatch, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different components that seem near, in the first bucket that both share, the nearest first; and a node per group and component."""
    cid, own, sig = column(batch, "cid").to_numpy(), column(batch, "own").to_numpy(), matrix(column(batch, "sig"))
    within = column(batch, "i").to_numpy() == column(batch, "j").to_numpy()
    _, start = np.unique(np.stack([group, column(batch, "component").to_numpy()], axis=1), axis=0, return_inverse=True)
    first = np.full(start.max() + 1, len(group))
    np.minimum.at(first, start.ravel(), np.arange(len(group)))
    root = first[start.ravel()]

    def near(i, j):
        s = score(sig[i], sig[j])
        return (s >= least) & (root[i] != root[j]) & (within[i] | (own[i] != own[j])), s

    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *near_in_groups(group, near)]
    i, j, _ = ordered(cid, *(np.concatenate(x) for x in zip(*found)))
    bucket, buckets = column(batch, "bucket").to_pylist(), [*map(frozenset, column(batch, "buckets").to_pylist())]
    mine = np.fromiter((bucket[x] == min(buckets[x] & buckets[y]) for x, y in zip(i.tolist(), j.tolist())), bool, len(i))
    return i[mine], j[mine], root


def open_members(score: Score, least: float):
    """The rows that are in a pair still to test."""

    def solve(batch: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch | None:
        i, j, _ = open_pairs(score, least, batch, group)
        return batch.take(pa.array(np.union1d(i, j))) if len(i) else None

    return solve


def links_of(score: Score, least: float, check: Check):
    """(a, b): links that hold between members of different components, as trees."""

    def solve(batch: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch | None:
        i, j, root = open_pairs(score, least, batch, group)
        if not len(i):
            return None
        cid = column(batch, "cid").to_numpy()
        body, links, extra = column(batch, "body"), [], 0
        while len(i):
            pick = np.union1d(best_of_each(root, i, j), np.arange(min(extra, len(i))))
            ok = checked(check, body, i[pick], j[pick])
            links.append((i[pick[ok]], j[pick[ok]]))
            # where few hold, nearly all have to be tested: together, as many pairs in step cost far less each
            extra = 0 if 2 * ok.sum() > len(ok) else min(4 * extra + 1024, MOST_TESTED)
            root = joined(root, *links[-1])
            go = root[i] != root[j]
            go[pick] = False
            i, j = i[go], j[go]
        a, b = (np.concatenate(x) for x in zip(*links))
        a, b, _ = forest(len(cid), cid, a, b, np.zeros(len(a)))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[a], cid[b])), pa.array(np.maximum(cid[a], cid[b]))], names=["a", "b"])

    return solve


def checked(check: Check, body: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    bodies = body.take(pa.array(used)).to_pylist()
    return check([bodies[k] for k in at[: len(i)]], [bodies[k] for k in at[len(i) :]])


def tested(check: Check):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch], "at", CHECKED):
                ok = check(column(part, "at").to_pylist(), column(part, "bt").to_pylist())
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run
