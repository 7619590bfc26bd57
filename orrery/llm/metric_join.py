"""Embedding near-duplicates by an exact metric range join.

Unit vectors are points of a metric space: cosine >= c is distance <= r with
r = sqrt(2 - 2c).  Pivots, drawn from the vectors of a label, partition it: a
vector is owned by the cell of its nearest pivot.  Their number grows with the
square root of the label's vectors, so that replication, at worst a row per
vector and pivot, stays small beside the comparisons.  If y is owned by cell q and |x - y| <= r, the triangle inequality gives
d(x, q) <= d(x, p) + 2r for the own pivot p of x, and since y lies on q's side
of the plane between p and q, also d(x, q)^2 - d(x, p)^2 <= 2 r d(p, q).  A
vector that meets both is replicated to cell q.  Each cell then knows all that
its own vectors can link with, and cells join independently: no pair is seen
from two cells for one vector.

Equal vectors are one node from the start.  A cell is compared in blocks of a
bounded size, as dense cells are dealt over many tasks; a block hands on counts
and, per connected group in it, a tree of links, never the pairs.

Defined results: a vector that is null, zero or holds null or non-finite
components, or whose label is null, has no links and is its own component;
vectors of different lengths link with nothing; rows that repeat a vector count
as vectors of their own; a null id takes part, but no component is named after
it; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._components import column, connected_components, matrix
from ._shared import checkpointed, discarded, stored

COSINE = 0.93
#: Labels of fewer vectors have no pivots; the others one and one for each ROOT in the square root of their vectors.  Vectors in a block.
LEAST, ROOT, BLOCK = 32, 128, 2048
#: Allowance for rounding in distances; it only replicates more.
SLACK = 1e-6


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; scaled first, so that no square overflows or vanishes."""
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells_of(x: np.ndarray, pivots: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and which cells each row belongs to (owned or replicated)."""
    r = np.sqrt(2 - 2 * cosine)
    d2 = np.maximum(0, 2 - 2 * (x @ pivots.T))
    own = d2.argmin(axis=1)
    mine = d2[np.arange(len(x)), own][:, None]
    between = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))[own]
    member = (np.sqrt(d2) <= np.sqrt(mine) + 2 * r + SLACK) & (d2 - mine <= 2 * r * between + SLACK)
    return own, member


def vectors_of(batch: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """Binary column of little-endian doubles as rows."""
    c = column(batch, name) if isinstance(batch, pa.RecordBatch) else batch[name].combine_chunks()
    return matrix(c).view(np.float64)


def trees(near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Connected groups of a boolean matrix (rows against columns), as row and column numbers."""
    left = near.any(axis=1)
    while left.any():
        rows = np.zeros(len(near), bool)
        rows[np.flatnonzero(left)[0]] = True
        columns, fresh = np.zeros(near.shape[1], bool), rows.copy()
        while fresh.any():
            columns |= near[fresh].any(axis=0)
            grown = near[:, columns].any(axis=1) & left
            fresh, rows = grown & ~rows, rows | grown
        left &= ~rows
        yield np.flatnonzero(rows), np.flatnonzero(columns)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    v = F.col(vector_col).cast("array<double>")
    label = F.col(label_col)
    if vectors.schema[label_col].dataType.typeName() in ("float", "double"):
        label = label + F.lit(0.0)  # -0.0 is 0.0
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    tagged = rows.withColumn("digest", F.when(usable, F.unhex(F.md5(F.to_json(F.struct("v"))))))
    classes = tagged.where("digest is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    alone = F.col("least").isNotNull() & (F.row_number().over(W.partitionBy("least").orderBy("label", "digest")) == 1)
    nodes = classes.withColumn("node", F.when(alone, F.col("least")).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("label", "digest"), 1)))
    nodes = checkpointed(packed(nodes.withColumn("dim", F.size("v"))))
    counted = links_within(nodes, cosine)
    edges = counted.where("near is not null").select(F.col("node").alias("a"), F.col("near").alias("b"))
    counts = counted.where("near is null").groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(edges)
    named = nodes.select("node", "label", "digest", "least", "n").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select(F.col("label").alias("_l"), F.col("digest").alias("_d"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = tagged.drop("v").join(named, (F.col("label") == F.col("_l")) & (F.col("digest") == F.col("_d")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def packed(nodes: DataFrame) -> DataFrame:
    """The vectors as unit vectors, in binaries of doubles."""

    def pack(batches):
        for batch in batches:
            lists = column(batch, "v")
            ends = np.asarray(lists.offsets)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            out = [unit(flat[a:b][None, :]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "x"])

    keep = ["node", "label", "digest", "least", "n", "dim"]
    schema = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in keep)
    return nodes.select(*keep, "v").mapInArrow(pack, f"{schema}, x binary")


def renewed(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, as two sides of a cogroup must not share any."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def links_within(nodes: DataFrame, cosine: float) -> DataFrame:
    """(node, near, links): link counts of each node by block (near is null), and trees of links (links is null)."""
    group = ["label", "dim"]
    sizes = checkpointed(nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).withColumn("pivots", F.when(F.col("size") >= LEAST, 1 + F.ceil(F.sqrt("size") / ROOT)).otherwise(1).cast("int")).withColumn("parts", F.ceil(F.col("size") / (4 * BLOCK)).cast("int")))
    drawn = F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("size")) < F.col("pivots")
    # a label of one cell needs no pivots; where none happens to be drawn, the label is one cell
    pivots = nodes.join(sizes.where("pivots > 1"), group).where(drawn).select(*group, "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    parts = nodes.join(sizes, group).select(*group, "node", "n", "x", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int").alias("part"))

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        if not n:
            return pa.Table.from_batches([], schema=assigned)
        own, member = np.zeros(n, np.int64), np.ones((n, 1), bool)
        if right.num_rows:
            order = right.sort_by("x")  # the cells' numbers must not depend on the order of arrival
            own, member = cells_of(vectors_of(left, "x"), vectors_of(order, "x"), cosine)
        which, cell = np.nonzero(member)
        take = pa.array(which)
        columns = [left[c].combine_chunks().take(take) for c in ("label", "dim", "node", "n", "x")]
        return pa.Table.from_arrays([columns[0], columns[1], pa.array(cell), pa.array(own[which] == cell), *columns[2:]], schema=assigned)

    assigned = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int64()), ("owned", pa.bool_()), ("node", pa.int64()), ("n", pa.int64()), ("x", pa.binary())])
    keys = [*group, "part"]
    held = parts.groupBy(*keys).cogroup(renewed(pivots).groupBy(*keys)).applyInArrow(assign, "label string, dim int, cell long, owned boolean, node long, n long, x binary")
    cell = [*group, "cell"]
    held = stored(held)
    blocks = held.groupBy(*cell).agg(F.ceil(F.sum(F.col("owned").cast("int")) / BLOCK).cast("int").alias("bo"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("bm")).where("bo > 0")
    dealt = held.join(blocks, cell)
    own = dealt.where("owned").withColumns({"i": F.pmod(F.xxhash64("node", F.lit("own")), F.col("bo")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("bm") - 1))})
    all_ = dealt.withColumns({"j": F.pmod(F.xxhash64("node", F.lit("all")), F.col("bm")).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("bo") - 1))})
    found = pa.schema([("node", pa.int64()), ("near", pa.int64()), ("links", pa.int64())])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema=found)
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        near = vectors_of(left, "x") @ vectors_of(right, "x").T >= cosine
        near &= a[:, None] != b[None, :]
        links = near @ right["n"].to_numpy().astype(np.float64)
        some = np.flatnonzero(links)
        u, w = [], []
        rows, columns = some, np.flatnonzero(near.any(axis=0))
        for r, c in trees(near[np.ix_(rows, columns)]):
            r, c = a[rows[r]], b[columns[c]]
            root = min(r.min(), c.min())
            for x in (r, c):
                u.append(x)
                w.append(np.full(len(x), root))
        u, w = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (u, w))
        nodes_, nears = pa.array(np.append(a[some], u)), pa.array([None] * len(some) + w.tolist(), pa.int64())
        return pa.Table.from_arrays([nodes_, nears, pa.array(links[some].astype(np.int64).tolist() + [None] * len(u), pa.int64())], schema=found)

    tasks = [*cell, "i", "j"]
    links = checkpointed(own.select(*tasks, "node", "x").groupBy(*tasks).cogroup(renewed(all_.select(*tasks, "node", "n", "x")).groupBy(*tasks)).applyInArrow(join, "node long, near long, links long"))
    discarded(held)
    return links
