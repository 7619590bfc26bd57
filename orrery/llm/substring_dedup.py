"""Removal of repeated byte strings, by hash-compared suffix sorting.

A byte goes when it lies in a string of ``length`` bytes that also starts
somewhere else.  Equal strings are brought together without moving texts:

1. Of the ``gram``-byte hashes inside a window of ``length`` bytes, the smallest
   is its anchor.  Equal windows have equal anchors at equal distances, and
   neighbouring windows mostly share one: a text of n bytes has about
   2n / (length - gram) anchors, each owning a run of windows (a *segment*).
2. Only anchors whose hash occurs twice go on.  Equal segments collapse into a
   class before anything is compared, so a group of copies is one class.
3. In a bucket of different segments with one anchor, the owned suffixes are
   sorted by mergesort.  Two suffixes are compared by their longest common
   extension, found by binary search over prefix polynomial hashes, in a
   logarithmic number of steps; neighbours that agree on ``length`` bytes are
   compared byte by byte before they count.  All buckets of a batch are sorted
   at once in numpy.
4. Buckets of more than ``hot`` different segments aren't sorted in one task:
   their windows are counted by 128-bit digest, combined before the shuffle.

Segments are told apart by 128 bits (anchor and segment digest).

Defined results: a null text is empty; texts under ``length`` bytes keep all;
matches never cross documents; rows that repeat a document repeat its strings,
so each of them loses what they share; a null doc_id is matched to itself by
its text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import column, grouped
from ._shared import CHUNK_BYTES, checkpointed, chunks

LENGTH, GRAM, HOT = 200, 64, 4096
BASE = 0x9E3779B97F4A7C15 | 1
POSITION_BITS = np.uint64(22)


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 64, 256, np.uint64, endpoint=False)


class PrefixHashes:
    """Polynomial hashes of all prefixes of a byte buffer; any substring's hash in constant time."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(16, len(data)).bit_length() if len(data) > 1 << 16 else 1 << 17
        up, self.down = powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_codes()[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def anchors(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of the texts data[starts:ends]: text number, first window, windows, anchor's place, anchor's hash.

    The smallest gram hash of each window is found by doubling; ties go to the
    left, which doesn't depend on where the text lies.
    """
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    n = len(data) - length + 1
    if n <= 0:
        return none
    hashes = PrefixHashes(data)
    at = np.arange(len(data) - gram + 1)
    h = hashes.of(at, gram)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    key = (h >> POSITION_BITS << POSITION_BITS) | at.astype(np.uint64)
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    rest = width - reach
    key = np.minimum(key[:n], key[rest : rest + n])
    anchor = (key & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(starts, np.arange(n), side="right") - 1
    valid = np.arange(n) + length <= ends[text]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & valid)
    # a run ends where the next begins or its text's windows end
    stop = np.minimum(np.append(np.flatnonzero(new)[1:], n)[np.searchsorted(np.flatnonzero(new), first)], ends[text[first]] - length + 1)
    if not len(first):
        return none
    return text[first], first, stop - first, anchor[first], h[anchor[first]]


def text_parts(bodies: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, place, bytes): texts in parts that overlap by length - 1 bytes, so each window lies in one part."""
    for row, body in enumerate(bodies):
        for at in range(0, max(1, len(body) - length + 1), CHUNK_BYTES):
            yield row, at, body[at : at + CHUNK_BYTES + length - 1]


def segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(hash, segment, doc_id, th, first, rel, windows) of every anchor of every document."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "body"):
            held: list[tuple[int, int, bytes]] = []
            size = 0
            for part in [*text_parts(column(batch, "body").to_pylist(), length), None]:
                if held and (part is None or size + len(part[2]) > 2 * CHUNK_BYTES):
                    yield found(batch, held)
                    held, size = [], 0
                if part:
                    held.append(part)
                    size += len(part[2])

    def found(batch: pa.RecordBatch, parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        buffer = b"".join(p[2] for p in parts)
        ends = np.cumsum([len(p[2]) for p in parts])
        starts = ends - [len(p[2]) for p in parts]
        text, first, windows, anchor, h = anchors(np.frombuffer(buffer, np.uint8), ends, starts, length, gram)
        rows = np.asarray([p[0] for p in parts])[text]
        place = first - starts[text] + np.asarray([p[1] for p in parts])[text]
        digest = xxhash.xxh3_64_intdigest
        # the places of anchor and windows count too: equal bytes may be owned differently at the ends of texts
        own = [digest(buffer[a : a + w + length - 1], (r << 8) | w) for a, w, r in zip(first.tolist(), windows.tolist(), (anchor - first).tolist())]
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(np.asarray(own, np.uint64).view(np.int64)), column(batch, "doc_id").take(take), column(batch, "th").take(take), pa.array(place << 16 | (anchor - first) << 8 | windows)],
            names=["hash", "segment", "doc_id", "th", "at"],
        )

    return docs.select("doc_id", "th", "body").mapInArrow(find, "hash long, segment long, doc_id long, th long, at long")


# ---------------------------------------------------------------- suffix sort


class Suffixes:
    """Suffixes of a buffer, cut after ``length`` bytes, compared by hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.hashes = data, length, PrefixHashes(data)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common extensions, by binary search over hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length, np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) >> 1
            same = self.hashes.of(x[open_], mid) == self.hashes.of(y[open_], mid)
            low[open_] = np.where(same, mid, low[open_])
            high[open_] = np.where(same, high[open_], mid - 1)

    def before(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """x < y, or x <= y where asked."""
        n = self.common(x, y)
        end = n == self.length
        i = np.minimum(n, self.length - 1)
        return np.where(end, or_equal, self.data[x + i] < self.data[y + i])

    def sort(self, at: np.ndarray, run: np.ndarray) -> np.ndarray:
        """An order that sorts the suffixes within each run (runs are contiguous): bottom-up mergesort of all runs at once."""
        starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        size = np.diff(np.append(starts, len(run)))
        begin, end = np.repeat(starts, size), np.repeat(starts + size, size)
        order, index = np.arange(len(at)), np.arange(len(at))
        width = 1
        while width < size.max(initial=0):
            off = index - begin
            block = begin + off // (2 * width) * (2 * width)
            left = off // width % 2 == 0
            middle = np.minimum(block + width, end)
            low = np.where(left, middle, block)
            high = np.where(left, np.minimum(block + 2 * width, end), middle)
            base = low.copy()
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) >> 1
                # equal ones of the left block go first
                smaller = self.before(at[order[mid]], at[order[open_]], ~left[open_])
                low[open_] = np.where(smaller, mid + 1, low[open_])
                high[open_] = np.where(smaller, high[open_], mid)
            place = np.where(left, index + low - base, index - (middle - block) + low - base)
            merged = np.empty_like(order)
            merged[place] = order
            order, width = merged, 2 * width
        return order

    def repeated(self, at: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Which suffixes have a twin of ``length`` equal bytes in their run; neighbours after sorting are verified by bytes."""
        order = self.sort(at, run)
        x, y = at[order[:-1]], at[order[1:]]
        twins = np.flatnonzero(run[order[:-1]] == run[order[1:]])
        twins = twins[self.common(x[twins], y[twins]) == self.length]
        span = np.arange(self.length)
        sure = [(self.data[x[t][:, None] + span] == self.data[y[t][:, None] + span]).all(axis=1) for t in np.array_split(twins, len(twins) // 20_000 + 1)]
        twins = twins[np.concatenate(sure)]
        out = np.zeros(len(at), bool)
        out[order[twins]] = out[order[twins + 1]] = True
        return out


def owned(bodies: list[bytes], rel: np.ndarray, windows: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every owned suffix of the segments: its segment, place in the joined buffer and in the segment, and run (bucket, distance to the anchor)."""
    starts = np.cumsum([0, *map(len, bodies)])[:-1]
    which = np.repeat(np.arange(len(bodies)), windows)
    o = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    return which, starts[which] + o, o, bucket[which] * 256 + rel[which] - o


def masks(mixed: DataFrame, length: int) -> DataFrame:
    """(hash, segment, mask): which owned windows of each class are repeated in its bucket (a byte each)."""

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in grouped(batches, ("hash",)):
            held.append(group)
            size += group.num_rows
            if size >= HOT:
                yield solved(held)
                held, size = [], 0
        if held:
            yield solved(held)

    def solved(groups: list[pa.RecordBatch]) -> pa.RecordBatch:
        bucket = np.repeat(np.arange(len(groups)), [g.num_rows for g in groups])
        t = pa.Table.from_batches(groups)
        bodies = t["bytes"].to_pylist()
        rel, windows = t["rel"].to_numpy().astype(np.int64), t["windows"].to_numpy().astype(np.int64)
        which, at, o, run = owned(bodies, rel, windows, bucket)
        order = np.lexsort((which, run))
        twin = np.zeros(len(at), bool)
        suffixes = Suffixes(np.frombuffer(b"".join(bodies), np.uint8), length)
        twin[order] = suffixes.repeated(at[order], run[order])
        flags, ends = twin.astype(np.uint8).tobytes(), np.cumsum(windows)
        return pa.RecordBatch.from_arrays([t["hash"].combine_chunks(), t["segment"].combine_chunks(), pa.array([flags[e - w : e] for e, w in zip(ends.tolist(), windows.tolist())], pa.binary())], names=["hash", "segment", "mask"])

    dealt = mixed.repartition("hash").sortWithinPartitions("hash")
    return dealt.mapInArrow(sort, "hash long, segment long, mask binary")


def hot_masks(mixed: DataFrame, length: int) -> DataFrame:
    """The same for large buckets: windows counted by digest, with partial sums before the shuffle."""

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                bodies = column(part, "bytes").to_pylist()
                rel, windows = (column(part, c).to_numpy().astype(np.int64) for c in ("rel", "windows"))
                which, at, o, _ = owned(bodies, rel, windows, np.zeros(len(bodies), np.int64))
                joined = b"".join(bodies)
                d = [xxhash.xxh3_128_digest(joined[a : a + length]) for a in at.tolist()]
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays([column(part, "hash").take(take), column(part, "segment").take(take), pa.array(rel[which] - o), pa.array(o), pa.array(d, pa.binary())], names=["hash", "segment", "distance", "o", "digest"])

    rows = mixed.mapInArrow(digests, "hash long, segment long, distance long, o long, digest binary")
    again = rows.groupBy("hash", "distance", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hits = rows.join(again, ["hash", "distance", "digest"]).groupBy("hash", "segment").agg(F.collect_set("o").alias("hits"))
    as_mask = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.array_max("hits")), lambda o: F.when(F.array_contains("hits", o.cast("long")), F.lit("01")).otherwise(F.lit("00"))), ""))
    return hits.select("hash", "segment", as_mask.alias("mask"))


# ---------------------------------------------------------------- operator


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, th, start, end): byte ranges of repeated strings; they may overlap.  ``docs`` has doc_id, th and body."""
    found = segments(docs, length, gram)
    again = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    occurrences = checkpointed(found.join(again, "hash"))
    classes = occurrences.groupBy("hash", "segment").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "at")).alias("one"))
    buckets = classes.groupBy("hash").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("fewest")).where("m > 1 and fewest = 1")
    named = classes.join(buckets, "hash").select("hash", "segment", "one.doc_id", "one.th", "one.at", "n", (F.col("m") > hot).alias("hot"))
    wanted = named.groupBy("doc_id", "th").agg(F.collect_list(F.struct("hash", "segment", "at", "n", "hot")).alias("wanted"))
    cut = F.transform("wanted", lambda w: F.struct(w["hash"].alias("hash"), w["segment"].alias("segment"), w["n"].alias("n"), w["hot"].alias("hot"), F.shiftright(w["at"], 8).bitwiseAND(255).cast("int").alias("rel"), w["at"].bitwiseAND(255).cast("int").alias("windows"), F.substring(F.col("body"), F.shiftright(w["at"], 16).cast("int") + 1, w["at"].bitwiseAND(255).cast("int") + length - 1).alias("bytes")))
    fetched = joined_to(docs, wanted, "inner").select(F.explode(cut).alias("x")).select("x.*")
    mixed = checkpointed(fetched.dropDuplicates(["hash", "segment"]))
    cold = masks(mixed.where("not hot").drop("n", "hot"), length)
    partial = cold.union(hot_masks(mixed.where("hot").drop("n", "hot"), length))
    # a class of several members is repeated as a whole, whatever else is in its bucket
    whole = classes.where("n > 1").select("hash", "segment", F.lit(None).cast("binary").alias("mask"))
    some = partial.join(mixed.where("n = 1").select("hash", "segment"), ["hash", "segment"], "left_semi")
    hit = occurrences.join(whole.union(some), ["hash", "segment"])

    def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, end = [], [], []
            for i, (at, mask) in enumerate(zip(column(batch, "at").to_pylist(), column(batch, "mask").to_pylist())):
                first, windows = at >> 16, at & 255
                if mask is None:
                    runs = [(0, windows)]
                else:
                    edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + mask + b"\0", np.uint8).astype(np.int8)))
                    runs = zip(edges[::2].tolist(), edges[1::2].tolist())
                for a, b in runs:
                    rows.append(i)
                    start.append(first + a)
                    end.append(first + b + length - 1)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(take), column(batch, "th").take(take), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "th", "start", "end"])

    return hit.select("doc_id", "th", "at", "mask").mapInArrow(spans, "doc_id long, th long, start long, end long")


def joined_to(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    other = other.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    return docs.join(other, docs["doc_id"].eqNullSafe(other["_id"]) & (docs["th"] == other["_th"]), how).drop("_id", "_th")


def bodies_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    body = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body")).withColumn("th", F.xxhash64("body"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (maximal removed runs), kept (the remaining bytes), n_bytes."""
    if not 8 <= gram < length or length - gram > 254:
        raise ValueError("the gram must be shorter than the length, by at most 254 bytes")
    docs = bodies_of(docs, id_col, text_col)
    spans = removed_spans(docs, length, gram, hot).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "body"):
            out = []
            for body, found in zip(column(batch, "body").to_pylist(), column(batch, "spans").to_pylist()):
                runs: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in found or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append([*s])
                edges = [0, *(e for r in runs for e in r), len(body)]
                out.append((len(body), runs, b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))))
            n, runs, kept = zip(*out)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined_to(docs, spans, "left").select("doc_id", "body", "spans").mapInArrow(cut, "doc_id long, n_bytes long, spans array<array<long>>, kept binary")


def digest_rows(result: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return result.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
