"""Best-fit-decreasing packing of tokenized documents into sequences.

Only lengths matter for packing, and there are at most ``limit`` different
ones.  So the fit runs on the driver over the histogram of lengths: a segment
tree over the remaining capacities finds the tightest open bin in logarithmic
time, and equal bins and equal lengths are placed together, which gives the
very bins that placing document by document would.  Its state is bounded by
``limit``, not by the rows.  The executors then number the pieces within each
length and look up their places in the plan; one small shuffle of lengths and
ids, never of texts.  Numbering is salted by input partition, so a length that
a third of all pieces share is still dealt over many tasks.

Defined results: a null text is empty and still takes its end token; a null id
is kept; repeated rows are packed each on their own; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import checkpointed, chunks, strings

#: Texts with these go to the library whole: special strings, white space on which tables disagree, and characters whose handling depends on Unicode versions.
ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
RARE = regex.compile(r"[^\u0000-įı-ɏ‐-‧€]")
MARKS = string.punctuation.replace("'", "")
MEMORY = 500_000
#: New words that the library gets as one text, the mark between them, and texts at once, as their encodings are large.
TOGETHER, MARK, TEXTS = 64, "|", 64


def plain(text: str) -> bool:
    """Whether lower case and splitting at white space do to a text what the library does."""
    if any(x in text for x in ODD):
        return False
    try:
        text.encode("latin-1")  # much faster than a pattern, and true of most texts
        return True
    except UnicodeEncodeError:
        return not RARE.search(text)


class WordIds:
    """Ids by the ``tokenizers`` library for a file that puts text in lower case and encodes word by word.

    Merges never cross white space, so what stands between white space is
    encoded once, by the library, and looked up from then on.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def each(self, words: list[str]) -> None:
        for w, got in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False)):
            self.known[w] = np.asarray(got.ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes words some at a time, with a mark between them that they don't hold: a call for each costs more than its tokens."""
        some = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for k in range(0, len(some), TEXTS):
            texts = [f" {MARK} ".join(x) for x in some[k : k + TEXTS]]
            for own, got in zip(some[k : k + TEXTS], self.library.encode_batch_fast(texts, add_special_tokens=False)):
                self.split(own, np.asarray(got.ids, "<u4"))

    def split(self, own: list[str], ids: np.ndarray) -> None:
        marks, data = (4 * np.flatnonzero(ids == self.mark)).tolist(), ids.tobytes()
        if len(marks) != len(own) - 1:  # a word gives the mark's id too
            self.each(own)
        else:
            self.known.update(zip(own, [data[a:b] for a, b in zip([0, *(m + 4 for m in marks)], [*marks, len(data)])]))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Words of all texts, and the parts of these, are told apart by Arrow, so that each is looked up once for all of them."""
        simple = [plain(t) for t in texts]
        lists = [t.lower().split() if ok else [] for t, ok in zip(texts, simple)]
        words = pa.array([*chain.from_iterable(lists)], pa.string()).dictionary_encode()
        kinds, cut, tails = parted(words.dictionary)
        parts = pa.concat_arrays([kinds, tails]).dictionary_encode()
        found, part = self.ids_of(parts.dictionary.to_numpy(zero_copy_only=False).tolist()) + [b""], parts.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        both = np.full((len(kinds), 2), len(found) - 1)
        both[:, 0], both[cut, 1] = part[: len(kinds)], part[len(kinds) :]
        ids, _ = gathered(np.frombuffer(b"".join(found), "<u4"), sizes, both.ravel())
        ids, ends = gathered(ids, sizes[both].sum(axis=1), words.indices.to_numpy())
        cuts = ends[np.cumsum([0, *map(len, lists)])].tolist()
        return [ids[a:b].tobytes() if ok else np.asarray(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, ok, a, b in zip(texts, simple, cuts, cuts[1:])]

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of different words, each of which is remembered."""
        out = [*map(self.known.get, words)]
        new = [k for k, got in enumerate(out) if got is None]
        if len(self.known) + len(new) > MEMORY:
            # words met first are the most frequent: they stay
            self.known = dict(islice(self.known.items(), MEMORY * 3 // 4))
        todo = [words[k] for k in new]
        self.each([w for w in todo if self.mark is None or MARK in w])
        if self.mark is not None:
            self.learn([w for w in todo if MARK not in w])
        for k, w in zip(new, todo):
            out[k] = self.known[w]
        return out


def parted(words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Words without the marks at their end, between which the library always splits; places of those that have such, and their marks."""
    core = pc.utf8_rtrim(words, characters=MARKS)
    ok = pc.and_(pc.not_equal(core, words), pc.utf8_is_alnum(pc.utf8_slice_codeunits(core, -1)))
    cut = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
    sizes = pc.utf8_length(core).to_numpy()[cut]
    tails = [w[n:] for w, n in zip(words.take(pa.array(cut)).to_numpy(zero_copy_only=False), sizes.tolist())]
    return pc.if_else(ok, core, words), cut, pa.array(tails, pa.string())


def gathered(values: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values``, of the given sizes, in the order of ``pick``; and where each begins, with the end of the last."""
    own = sizes[pick]
    ends = np.cumsum(own)
    shift = (np.cumsum(sizes) - sizes)[pick] - ends + own
    return values[np.repeat(shift, own) + np.arange(own.sum())], np.append(0, ends)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenized_pieces(docs: DataFrame, path: str, limit: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``limit`` tokens: id, piece, start, length, ids_crc32."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(path).encode_all, np.asarray([end_id], "<u4").tobytes()
        for batch in chunks(batches, "text"):
            rows = []
            for i, ids in enumerate(encode(strings(batch, "text"))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            which, *rest = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which)), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rest[1:])],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


class OpenBins:
    """Open bins by remaining capacity; a segment tree tells the tightest one that is large enough."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.tree = [0] * (2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]

    def put(self, capacity: int, first: int, bins: int) -> None:
        if bins and capacity:
            self.groups[capacity].append((first, bins))
            self.add(capacity, 1)

    def take(self, capacity: int) -> tuple[int, int]:
        self.add(capacity, -1)
        return self.groups[capacity].pop()

    def add(self, capacity: int, step: int) -> None:
        k = capacity + self.size
        while k:
            self.tree[k] += step
            k >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open bin that is at least ``least``: up while nothing lies to the right, then down left first."""
        k = least + self.size
        if not self.tree[k]:
            while k > 1 and (k & 1 or not self.tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.tree[2 * k] else 2 * k + 1
        return k - self.size


def fit(histogram: dict[int, int], limit: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts of lengths.

    Returns rows (length, from_rank, first_bin, per_bin, offset), sorted, and
    the number of bins: the pieces of a length from a rank on fill ``per_bin``
    places of each bin from ``first_bin`` on.
    """
    bins, used, plan = OpenBins(limit), 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = bins.tightest(length)
            if capacity is None:
                new = -(-left // (limit // length))
                capacity, first, n = limit, used, new
                used += new
            else:
                first, n = bins.take(capacity)
            per_bin = capacity // length
            full = min(n, left // per_bin)
            placed = full * per_bin
            if not full:  # fewer are left than one bin takes
                full, per_bin, placed = 1, left, left
            plan.append((length, rank, first, per_bin, limit - capacity))
            bins.put(capacity - per_bin * length, first, full)
            bins.put(capacity, first + full, n - full)
            left, rank = left - placed, rank + placed
    return np.asarray(sorted(plan), np.int64).reshape(-1, 5), used


def best_fit_packing(pieces: DataFrame, limit: int) -> DataFrame:
    """The rows of ``pieces`` (with a long ``length`` from 1 to ``limit``) with sequence_id and offset added."""
    columns = pieces.columns
    held = checkpointed(pieces.withColumn("_part", F.spark_partition_id()))
    per_part = held.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `limit` rows
    if any(not 1 <= n <= limit for n in histogram):
        raise ValueError(f"lengths must lie between 1 and {limit}")
    plan, _ = fit(histogram, limit)
    before = per_part.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    order = [c for c in columns if c != "length" and held.schema[c].dataType.typeName() not in ("map", "variant")]
    numbered = (
        held.withColumn("_k", F.row_number().over(W.partitionBy("length", "_part").orderBy(*order)))
        .join(before.drop("_n"), ["length", "_part"])
        .withColumn("_rank", F.col("_k") - 1 + F.coalesce(F.col("_before"), F.lit(0)))
        .select(*columns, F.col("_rank").cast("long"))
    )
    if not len(plan):
        return numbered.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    shift = np.int64(1 << 50)
    starts = plan[:, 0] * shift + plan[:, 1]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            _, from_rank, first, per_bin, offset = plan[np.searchsorted(starts, length * shift + rank, side="right") - 1].T
            at = rank - from_rank
            rest = [batch.column(i) for i, f in enumerate(batch.schema.names) if f != "_rank"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(first + at // per_bin), pa.array(offset + at % per_bin * length)], names=[f for f in batch.schema.names if f != "_rank"] + ["sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "_rank")
    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")
