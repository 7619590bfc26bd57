"""Quality rules by compression bands.

zstandard compresses the whole document and each of its fixed chunks.  Text
that repeats itself compresses too well, noise hardly at all; what is usual
depends on the length, so each length band has limits of its own.  A document
is rejected when its whole ratio (compressed / original bytes) leaves the band
of its length, or when more than ``bad_share`` of its bytes lie in chunks that
leave the band of theirs.  Simple counts of the words go first: they form the
base rules, which reject very short texts and texts of repeated word windows.

Words are maximal runs of characters other than U+0020 and U+0009 to U+000D.
Each document is judged where it is read: no shuffle, one document in memory.

Defined results: a null text has no words and fails the base rules, as does an
empty one; repeated rows give repeated results; an empty table gives no rows;
extra columns, whatever their names, don't take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """Limits of the ratio from a length on: below ``low`` is repetitive, above ``high`` incompressible."""

    from_bytes: int
    low: float
    high: float


#: By length in bytes; shorter texts have no limits, as the frame outweighs what it holds.  Low limits lie about 0.01 (256
#: bytes: 0.02) under the range of the documents labelled clean at sf0.1, high ones 0.02 to 0.06 over it, so that random
#: letters and digits exceed them up to the band's end; from 32768 bytes on there are no clean rows, limits go on falling.
BANDS = (
    Limits(256, 0.580, 0.765),
    Limits(362, 0.574, 0.728),
    Limits(512, 0.525, 0.702),
    Limits(724, 0.497, 0.660),
    Limits(1024, 0.481, 0.610),
    Limits(1448, 0.456, 0.590),
    Limits(2048, 0.454, 0.570),
    Limits(2896, 0.441, 0.550),
    Limits(4096, 0.427, 0.530),
    Limits(5793, 0.417, 0.520),
    Limits(8192, 0.410, 0.500),
    Limits(11585, 0.405, 0.490),
    Limits(16384, 0.393, 0.480),
    Limits(32768, 0.375, 0.470),
    Limits(65536, 0.360, 0.460),
)
CHUNK = 4096


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of five words found twice or more (exact: windows are ranked, not hashed)."""
    n = len(ids)
    if n <= WINDOW:
        return 0

    def ranked(x: np.ndarray) -> np.ndarray:
        return np.unique(x, return_inverse=True)[1].astype(np.int64)

    m = np.int64(n)
    twos = ranked(ids[:-1] * m + ids[1:])
    fours = ranked(twos[:-2] * m + twos[2:])
    _, which, found = np.unique(fours[:-1] * m + ids[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(found[which] > 1)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def band(size: int, bands: tuple[Limits, ...]) -> Limits | None:
    return next((b for b in reversed(bands) if size >= b.from_bytes), None)


def measure(text: str | None, compress, bands: tuple[Limits, ...], bad_share: float) -> tuple:
    words = WORD.findall(text or "")
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n_repeat = repeated_words(ids) if len(known) < len(words) else 0
    seen: set[str] = set()
    n_dup = 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            n_dup += line in seen
            seen.add(line)
    raw = (text or "").encode()
    ratio, verdict = None, "kept"
    if limits := band(len(raw), bands):
        ratio = len(compress(raw)) / len(raw)
        verdict = "repetitive" if ratio < limits.low else "incompressible" if ratio > limits.high else "kept"
        bad = 0
        if verdict == "kept" and len(raw) > CHUNK:
            for at in range(0, len(raw), CHUNK):
                part = raw[at : at + CHUNK]
                if own := band(len(part), bands):
                    r = len(compress(part)) / len(part)
                    bad += len(part) if r < own.low or r > own.high else 0
            if bad > bad_share * len(raw):
                verdict = "bad chunks"
    n_words = len(words)
    failed = n_words < 10 or 100 * n_repeat > 20 * n_words
    symbols = sum(map((text or "").count, SYMBOLS))
    return n_words, sum(map(len, words)), symbols, n_dup, n_repeat, failed, not failed and verdict == "kept", ratio, "base" if failed else verdict


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, verdict string"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: tuple[Limits, ...] = BANDS, bad_share: float = 0.5, level: int = 3, keep_row: bool = False) -> DataFrame:
    """One row per document: its id (with ``keep_row``: its whole row as a struct ``row``), the counts, ratio and verdict."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=level).compress
        schema = None
        for batch in chunks(batches, "_text"):
            rows = [measure(t, compress, bands, bad_share) for t in batch.column(1).to_pylist()]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.string()]
            schema = schema or pa.schema([pa.field("_key", batch.schema.field(0).type), *(pa.field(c.split()[0], k) for c, k in zip(COLUMNS.split(", "), kinds))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], schema=schema)

    key = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep_row else F.col(id_col)
    rows = docs.select(key.alias("_key"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(judge, f"_key {kind}, {COLUMNS}").withColumnRenamed("_key", "row" if keep_row else id_col)


def passing(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The verdict is computed beside the row in one pass, so nothing is joined.
    """
    judged = quality_rules(docs, keep_row=True, **options)
    return judged.where("kept").select("row.*")
