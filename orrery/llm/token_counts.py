"""Exact token counts by prefix dynamic programming.

A byte-pair encoding is *local*: a token sequence is the encoding of its bytes
exactly when every adjacent pair of tokens encodes to itself.  So the last
token of the encoding of a prefix is the one vocabulary entry that ends there
and may follow the last token of the prefix before it, and

    count[i] = count[i - len(last[i])] + 1

gives the exact number of tokens at every prefix in one pass.  The tokenizer
first splits a text into pieces that merges never cross; the program runs once
per distinct piece, and running sums over the pieces extend it to whole texts.
Counts for truncation and budgets are then look-ups: nothing is encoded again.

Defined results: a null text is empty (0 bytes, 0 tokens); repeated rows give
repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chunks, strings

#: The byte-level alphabet of the vocabulary files and their split pattern.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CONTRACTION = regex.compile(r"'re|'ve|'ll")
#: Beyond these characters the library itself splits, as Unicode versions may differ.
RARE = regex.compile(r"[^\u0000-ɏ‐-‧€]")
#: Distinct pieces and pairs remembered by a worker; when full, a memory is emptied.
MEMORY = 500_000


def byte_alphabet() -> dict[str, int]:
    shown = {chr(b): b for b in PRINTABLE}
    rest = [b for b in range(256) if b not in PRINTABLE]
    return shown | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts tokens as the ``tokenizers`` library does for a byte-level BPE file, at every prefix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without normaliser or prefix space is needed")
        code = byte_alphabet()
        raw = lambda s: bytes(code[c] for c in s)
        model = spec["model"]
        # tokens are numbered by the order in which merges form them: single bytes, then by rank
        self.vocab = {bytes([b]): b for b in range(256)}
        self.left, self.right, self.formed = [*range(256)], [*range(256)], {}
        for pair in model["merges"]:
            x, y = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            if x + y in self.vocab:
                raise ValueError("two merges form one token")
            k = self.vocab[x + y] = len(self.left)
            self.left.append(self.vocab[x])
            self.right.append(self.vocab[y])
            self.formed[self.vocab[x], self.vocab[y]] = k
        if {raw(t) for t in model["vocab"]} != set(self.vocab):
            raise ValueError("the vocabulary isn't what its merges form")
        self.longest = max(map(len, self.vocab))
        specials = [t for t in spec["added_tokens"] if t["special"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in specials):
            raise ValueError("special tokens that take in white space aren't supported")
        names = sorted((t["content"] for t in specials), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.split = regex.compile(PATTERN).findall
        self.code, self.library = code, Tokenizer.from_file(path)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, int] = {}

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a.

        It may not if, while the two are being formed, the parts on either side
        of their border merge with each other first.  The merges of both are
        undone from the last to the first; at each step the parts at the border
        must have no merge that comes before the one just undone.
        """
        before, left, right, formed = 1 << 60, self.left, self.right, self.formed
        while True:
            if formed.get((a, b), before) < before:
                return False
            if a > b or b < 256:
                if a < 256:
                    return True
                before, a = a, right[a]
            else:
                # of equal merges the left one is made first, so b's own rank still counts
                before, b = b + 1, left[b]

    def program(self, piece: bytes) -> list[int]:
        """count[i] = tokens of piece[:i], for every i."""
        n, vocab, pairs, longest = len(piece), self.vocab, self.pairs, self.longest
        count, last = [0] * (n + 1), [0] * (n + 1)
        if len(pairs) >= MEMORY:
            pairs.clear()
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                token = vocab.get(piece[j:i])
                if token is None:
                    continue
                if j:
                    pair = last[j], token
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = self.follows(*pair)
                    if not fits:
                        continue
                count[i], last[i] = count[j] + 1, token
                break
        return count

    def pieces(self, text: str) -> list[str]:
        """What merges never cross; a special string is a piece of its own."""
        if self.special and self.special.search(text):
            return [p for part in self.special.split(text) if part for p in ([part] if self.special.fullmatch(part) else self.pieces(part))]
        if RARE.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.split(text)

    def tokens(self, piece: str) -> int:
        got = self.known.get(piece)
        if got is None:
            got = 1 if self.special and self.special.fullmatch(piece) else self.program(piece.encode())[-1]
            if len(piece) <= 64:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[piece] = got
        return got

    def piece_counts(self, text: str) -> tuple[list[str], np.ndarray]:
        """The pieces and the exact number of tokens after each."""
        pieces = self.pieces(text)
        try:
            counts = [*map(self.known.__getitem__, pieces)]
        except KeyError:
            counts = [self.tokens(p) for p in pieces]
        return pieces, np.cumsum(counts, dtype=np.int64)

    def inside(self, piece: str, before: str, base: int, base_before: int) -> list[int]:
        """Tokens of the text that ends after 1, 2, ... characters of a piece.

        ``base`` tokens stand before the piece, ``base_before`` before the one
        before it.  A cut can change how the last characters split: white space
        that leads a word joins the white space before it, a cut contraction is
        punctuation and letters, a cut special string is ordinary text.
        """
        if self.special and self.special.fullmatch(piece):
            # the start of a special string continues the punctuation before it
            return [base_before + int(self.piece_counts(before + piece[:k])[1][-1]) for k in range(1, len(piece))] + [base + 1]
        if CONTRACTION.fullmatch(piece):
            return [base + self.tokens("'"), base + self.tokens("'") + self.tokens(piece[1]), base + self.tokens(piece)]
        raw, at, out = self.program(piece.encode()), 0, []
        for c in piece:
            at += len(c.encode())
            out.append(base + raw[at])
        if before and before.isspace() and piece[0].isspace():
            out[0] = base_before + self.tokens(before + piece[0])
        return out

    def prefix_counts(self, text: str) -> list[int]:
        """Exact number of tokens of text[:i], for i from 0 to len(text)."""
        pieces, sums = self.piece_counts(text)
        out, base, base_before, before = [0], 0, 0, ""
        for piece, total in zip(pieces, sums.tolist()):
            out += self.inside(piece, before, base, base_before)
            base_before, base, before = base, total, piece
        return out

    def longest_prefix(self, text: str, budget: int, known: tuple[list[str], np.ndarray] | None = None) -> str:
        """The longest text[:i] of at most ``budget`` tokens, found from stored counts."""
        pieces, sums = known or self.piece_counts(text)
        j = int(np.searchsorted(sums, budget, side="right"))
        if j == len(pieces):
            return text
        start = sum(map(len, pieces[:j]))
        best = start
        for k in range(j, min(j + 2, len(pieces))):
            base, base_before = (int(sums[i]) if i >= 0 else 0 for i in (k - 1, k - 2))
            for x, n in enumerate(self.inside(pieces[k], pieces[k - 1] if k else "", base, base_before), 1):
                if n <= budget:
                    best = max(best, start + x)
            start += len(pieces[k])
        return text[:best]


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit, kept_bytes.

    kept_bytes is the length of the longest prefix of at most ``limit`` tokens.
    No shuffle: each row is counted where it is read.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in chunks(batches, "text"):
            n_bytes, n_tokens, kept = [], [], []
            for text in strings(batch, "text"):
                size = len(text.encode())
                pieces, sums = c.piece_counts(text)
                n = int(sums[-1]) if pieces else 0
                n_bytes.append(size)
                n_tokens.append(n)
                kept.append(size if n <= limit else len(c.longest_prefix(text, limit, (pieces, sums)).encode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens]), pa.array(kept, pa.int64())],
                names=["id", "n_bytes", "n_tokens", "over_limit", "kept_bytes"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, kept_bytes long").withColumnRenamed("id", id_col)
