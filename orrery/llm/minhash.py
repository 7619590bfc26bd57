"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles; the similarity of two is
the weighted Jaccard index, sum(min) / sum(max) of the counts.  Counts are
discretised into unit levels, and levels into bands [0,1), [1,2), [2,4), [4,8),
...: one Poisson process per shingle and band, whose points fall on a level of
the band and a register of the signature.  A point counts for a document whose
count lies above its level, so two documents share the points of the levels
that both have, and a register (the earliest point) agrees with probability
equal to their similarity.  Processes are followed in time and stop as soon as
a point comes later than all registers, so a long text costs little more than
one point per shingle.

Registers are banded; of documents that share a band, those whose registers
agree often enough are tried (module ``_components``), and the exact multiset
overlap decides.  Documents of equal text are one node from the start.

Defined results: a null text is empty; documents of fewer than five words have
no shingles and are near nothing but equal texts; rows that repeat a doc_id and
text count as one document (one result row each); a null doc_id is in a class
by its text like any other, and comes last where one is to stay; ids are read as
longs; an empty table gives no rows; extra columns are ignored by
``near_duplicates`` and kept by ``without_near_duplicates``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._components import column, dealt, link
from ._shared import chunks, stored

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 26, 5
WORD = regex.compile(r"[^\x20\x09-\x0D]+")
#: A pair whose registers agree in a smaller share isn't verified; six standard deviations below the limit.
LEAST_SHARE = 0.8 - 6 * (0.8 * 0.2 / (BANDS * ROWS)) ** 0.5
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix finaliser)."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of the five-word shingles, in order, with repeats."""
    words = WORD.findall(text)
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    known: dict[str, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = mixed_bits(out ^ h[k : len(h) - SHINGLE + 1 + k])
    return out


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """BagMinHash signatures (64-bit registers) of (shingles, counts), all documents at once."""
    docs = len(bags)
    doc = np.repeat(np.arange(docs), [len(b[0]) for b in bags])
    item = np.concatenate([b[0] for b in bags]) if docs else np.zeros(0, np.uint64)
    count = np.concatenate([b[1] for b in bags]).astype(np.float64) if docs else np.zeros(0)
    # one process per item and dyadic band of levels [0,1), [1,2), [2,4), ...
    parts = []
    band, low = 0, 0.0
    while len(doc):
        parts.append((doc, mixed_bits(item ^ mixed_bits(np.full(len(item), band, np.uint64))), count, np.full(len(item), low)))
        low = 2.0 ** (band)
        band += 1
        more = count > low
        doc, item, count = doc[more], item[more], count[more]
    registers = np.full(docs * size, np.inf)
    points = np.zeros(docs * size, np.uint64)
    if not parts:
        return points.reshape(docs, size)
    doc, state, count, low = (np.concatenate(x) for x in zip(*parts))
    width = np.maximum(low, 1.0)  # a band is as wide as its lower end
    time, step = np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        draw = mixed_bits(state + np.array([step], np.uint64) * MIX1)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / width
        at = mixed_bits(draw)
        register = (at % np.uint64(size)).astype(np.int64) + doc * size
        level = low + width * ((at >> np.uint64(32)).astype(np.float64) / 2.0**32)
        counts = (level < count) & (time < registers[register])
        r, t, p = register[counts], time[counts], draw[counts]
        np.minimum.at(registers, r, t)
        first = registers[r] == t
        points[r[first]] = p[first]
        if step % 4 == 1:
            latest = registers.reshape(docs, size).max(axis=1)
        go = time < latest[doc]
        doc, state, count, low, width, time = (x[go] for x in (doc, state, count, low, width, time))
    return points.reshape(docs, size)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(text), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity of two bags."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    most = int(a[1].sum()) + int(b[1].sum()) - least
    return least / most if most else 1.0


def agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The share of registers (a byte of each) that agree."""
    return (one == many).mean(axis=1)


def overlapping(similarity: float, a: list[str], b: list[str]) -> np.ndarray:
    """Which pairs of texts have an exact multiset overlap of at least ``similarity``."""
    bags = {t: bag(t) for t in {*a, *b}}
    return np.array([overlap(bags[x], bags[y]) >= similarity for x, y in zip(a, b)], bool)


def signed_documents(rows: DataFrame) -> DataFrame:
    """(doc_id, h, keys, sig): digest of the text, a key per band and a byte per register; no keys where there are no shingles."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = column(batch, "text").to_pylist()
            bags = [bag(t) for t in texts]
            full = np.flatnonzero([len(b[0]) for b in bags])
            regs = signatures([bags[i] for i in full], BANDS * ROWS)
            hashes = np.repeat(mixed_bits(np.arange(BANDS, dtype=np.uint64))[None, :], len(full), axis=0)
            for k in range(ROWS):
                hashes = mixed_bits(hashes ^ regs[:, k::ROWS])
            keys, sigs = [None] * len(texts), [None] * len(texts)
            for i, own, reg in zip(full, hashes.view(np.int64), regs.astype(np.uint8)):
                keys[i], sigs[i] = own, reg.tobytes()
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([hashlib.md5(t.encode()).digest() for t in texts], pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "h", "keys", "sig"],
            )

    return rows.mapInArrow(sign, "doc_id long, h binary, keys array<long>, sig binary")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_md5, class_id (smallest doc_id of its class), class_size, n_copies (rows of equal text), kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed = stored(signed_documents(rows))
    groups = signed.groupBy("h").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    # the node of a text is the smallest id that has it; where texts share an id or have none, a negative number
    own = W.partitionBy("least").orderBy("h")
    alone = F.col("least").isNotNull() & (F.row_number().over(own) == 1)
    nodes = stored(groups.withColumn("cid", F.when(alone, F.col("least")).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("h"), 1))))
    full = nodes.where("keys is not null").select("cid", "keys", "sig")
    comps = link(
        dealt(full, lambda n: n.select(F.explode("keys").alias("bucket"), "cid")),
        full.select("cid", "sig"),
        agreement,
        LEAST_SHARE,
        lambda wanted: texts_of(rows, nodes.select("cid", F.col("least").alias("doc_id"), "h").join(wanted, "cid", "left_semi")),
        partial(overlapping, similarity),
    )
    of_text = nodes.drop("keys", "sig").join(comps, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    classes = of_text.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("last"), "least", "h")).alias("first"), F.sum("n_copies").alias("class_size"))
    # of different texts with the smallest id, or all without one, the text with the smallest digest stays
    of_text = of_text.join(classes, "component").select("h", F.col("first.least").alias("class_id"), "class_size", "n_copies", (F.col("h") == F.col("first.h")).alias("stays"))
    out = signed.select("doc_id", "h").join(of_text, "h")
    return out.select("doc_id", F.lower(F.hex("h")).alias("text_md5"), "class_id", "class_size", "n_copies", (F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("stays")).alias("kept"))


def keyed(id_col: str, digest: Column) -> Column:
    """One string of id and digest, so that a join by it and a choice of one row for each need the same shuffle."""
    return F.concat_ws("|", F.col(id_col).cast("long").cast("string"), digest)


def texts_of(rows: DataFrame, named: DataFrame) -> DataFrame:
    """(cid, body) of the named nodes, a row each; the texts of all rows are shuffled once to find them."""
    wanted = named.select("cid", keyed("doc_id", F.lower(F.hex("h"))).alias("wanted"))
    found = rows.select(keyed("doc_id", F.md5("text")).alias("key"), "text").join(wanted, F.col("key") == F.col("wanted"))
    return found.dropDuplicates(["key"]).select("cid", F.col("text").alias("body"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each class, with all their columns, whatever their names."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col).where("kept").select(keyed("doc_id", F.col("text_md5")).alias("kept"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), keyed(f"`{id_col}`", F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("key"))
    return rows.join(kept, F.col("key") == F.col("kept"), "left_semi").dropDuplicates(["key"]).select("row.*")
