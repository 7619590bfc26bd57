"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read in overlapping windows of words.  Each word gives a word input
(an embedding, for the words of the training sample) and a character input (the
mean embedding of its hashed character trigrams, for all words).  Gated units
read a window in both directions, attention weighs their states, and a logistic
unit scores the window; the score of a text is that of its worst window, so all
of a long text counts.  In training, each document teaches by its worst window.

The network is fitted on the driver on a bounded sample: at most ``most_rows``
labelled documents of a class (twice as many clean ones) of ``most_chars``
characters; longer ones are passed over for the next.  Its weights (some
hundred kB, bounded by the vocabulary) go to the executors with the task, and
each text is scored where it is read: no shuffle.

Defined results: a null or empty text is one window without words and gets the
score of the bias; without labels of both classes every score is the share of
toxic labels (0.5 without labels); a document with several labels is toxic if
one says so; rows that repeat a document repeat its
score; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import column
from ._shared import chunks, strings

WORD = regex.compile(r"[^\x20\x09-\x0D]+")
#: White space for str.split that doesn't end a word here.
SPACES = regex.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WINDOW, STRIDE = 48, 24
HIDDEN, EMBEDDING, ATTENTION = 12, 12, 12
TRIGRAMS, VOCABULARY, LEAST_COUNT = 4096, 8192, 3
MEMORY = 150_000
#: Windows that are scored together, so that arrays stay in the cache.
BLOCK = 1024
#: Documents of the prior that smooth a word's log odds, shares of word and character inputs dropped in training, decay of embeddings.
SMOOTH, WORD_DROP, CHAR_DROP, DECAY = 4, 0.1, 0.5, 0.02


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def raw_words(text: str) -> list[str]:
    text = text.lower()
    return WORD.findall(text) if SPACES.search(text) else text.split()


def bare(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}") or word


def words_of(text: str) -> list[str]:
    return [*map(bare, raw_words(text))]


def trigrams(word: str) -> list[int]:
    w = f"<{word}>".encode()
    return [zlib.crc32(w[i : i + 3]) % TRIGRAMS for i in range(max(1, len(w) - 2))]


def crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> np.uint32(1) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


CRC = crc_table()


def all_trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``trigrams`` of many words, all in one array, and how many each word has."""
    if "" in words:  # the only word that gives less than three bytes
        parts = [*map(trigrams, words)]
        return np.fromiter((g for p in parts for g in p), np.int64), np.fromiter(map(len, parts), np.int64, len(parts))
    sizes = pc.binary_length(pa.array(words, pa.string())).to_numpy().astype(np.int64)
    data = np.frombuffer(f"<{'><'.join(words)}>".encode(), np.uint8)
    at = np.arange(sizes.sum()) + np.repeat(2 * np.arange(len(words)), sizes)
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(3):
        crc = CRC[(crc ^ data[at + k]) & np.uint32(255)] ^ crc >> np.uint32(8)
    return (~crc % np.uint32(TRIGRAMS)).astype(np.int64), sizes


def window_places(n: int) -> list[int]:
    """Starts of the windows that cover n words; the last may be short."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW + STRIDE, STRIDE)]


@dataclass
class Words:
    """Words as vocabulary numbers (0: none) and trigrams, all trigrams in one array."""

    ids: np.ndarray
    grams: np.ndarray
    sizes: np.ndarray
    drop: np.ndarray | None = None  # in training: which of a word's two inputs are left

    @staticmethod
    def of(words: list[str], vocabulary: dict[str, int]) -> Words:
        return Words(np.asarray([vocabulary.get(w, 0) for w in words], np.int64), *all_trigrams(words))

    def some(self, which: np.ndarray) -> Words:
        sizes = self.sizes[which]
        shift = (np.cumsum(self.sizes) - self.sizes)[which] - (np.cumsum(sizes) - sizes)
        return Words(self.ids[which], self.grams[np.repeat(shift, sizes) + np.arange(sizes.sum())], sizes)


@dataclass
class Network:
    vocabulary: dict[str, int]
    weights: dict[str, np.ndarray]
    prior: float | None = None  # set if there was nothing to learn from
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None  # what either direction takes from known words, [direction, word, unit]

    @staticmethod
    def fresh(vocabulary: dict[str, int], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        e, h, a = EMBEDDING, HIDDEN, ATTENTION
        shapes = {"words": (len(vocabulary) + 1, e), "chars": (TRIGRAMS, e), "att_w": (2 * h, a), "att_b": (a,), "att_v": (a,), "out_w": (2 * h,), "out_b": (1,)}
        for d in "fb":
            shapes |= {f"{d}_x": (2 * e, 3 * h), f"{d}_h": (h, 3 * h), f"{d}_b": (3 * h,)}
        scale = lambda k, s: 0.0 if k.endswith("_b") else 0.3 if k in ("words", "chars") else 1 / np.sqrt(s[0])
        return Network(vocabulary, {k: (rng.standard_normal(s) * scale(k, s)).astype(np.float32) for k, s in shapes.items()})

    # ------------------------------------------------------------ inputs

    def inputs(self, words: Words) -> np.ndarray:
        """Input vectors: the word's own embedding beside the mean of its trigrams'."""
        if not len(words.sizes):
            return np.zeros((0, 2 * EMBEDDING), np.float32)
        means = np.add.reduceat(self.weights["chars"][words.grams], np.cumsum(words.sizes) - words.sizes, axis=0) / words.sizes[:, None]
        own = self.weights["words"][words.ids]
        if words.drop is not None:
            own, means = own * words.drop[:, :1], means * words.drop[:, 1:]
        return np.hstack([own, means]).astype(self.weights["words"].dtype)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What both directions take from a word's input, one row per word; a last row for padding."""
        w = self.weights
        both = np.hstack([x @ w["f_x"] + w["f_b"], x @ w["b_x"] + w["b_b"]])
        return np.vstack([both, np.zeros((1, both.shape[1]), both.dtype)])

    # ------------------------------------------------------------ forward

    def states(self, p: np.ndarray, at: np.ndarray, mask: np.ndarray, direction: str, keep: list) -> np.ndarray:
        """Hidden states of one direction, [step, window, unit]."""
        h3 = 3 * HIDDEN
        own = p[:, :h3] if direction == "f" else p[:, h3:]
        u = self.weights[f"{direction}_h"]
        n, t = at.shape
        h, out = np.zeros((n, HIDDEN), np.float32), np.zeros((t, n, HIDDEN), np.float32)
        for k in range(t) if direction == "f" else range(t - 1, -1, -1):
            x, r = own[at[:, k]], h @ u
            gates = sigmoid(x[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
            z, g = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + g * r[:, 2 * HIDDEN :])
            m = mask[:, k, None]
            before, h = h, h + m * (1 - z) * (new - h)
            out[k] = h
            keep.append((k, before, z, g, new, r[:, 2 * HIDDEN :], m))
        return out

    def pooled(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.weights
        hidden = np.tanh(states @ w["att_w"] + w["att_b"])
        e = np.where(mask.T > 0, hidden @ w["att_v"], -1e9)
        e = np.exp(e - e.max(axis=0)) * mask.T
        share = e / np.maximum(e.sum(axis=0), 1e-9)
        context = (share[:, :, None] * states).sum(axis=0)
        return hidden, share, context, context @ w["out_w"] + w["out_b"][0]

    def logits(self, p: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """What ``states`` and ``pooled`` give, without what training keeps: [unit, window], as numpy is slow at rows of few units.

        ``p`` is as from ``projected``, or one such array for each direction, [direction, word, unit].
        """
        w, (n, t), two = self.weights, at.shape, 2 * HIDDEN
        both = p if p.ndim == 3 else np.stack(np.split(p, 2, axis=1))
        at, mask = np.ascontiguousarray(at.T), np.ascontiguousarray(mask.T)
        states = np.empty((t, two, n), np.float32)
        x, r, gates, rest = np.empty((n, 3 * HIDDEN), both.dtype), *(np.empty((k, n), np.float32) for k in (3 * HIDDEN, two, HIDDEN))
        for d, own in zip("fb", both):
            u, h = np.ascontiguousarray(w[f"{d}_h"].T), np.zeros((HIDDEN, n), np.float32)
            z, g, new, units = gates[:HIDDEN], gates[HIDDEN:], r[two:], slice(0, HIDDEN) if d == "f" else slice(HIDDEN, two)
            for k in range(t) if d == "f" else range(t - 1, -1, -1):
                np.take(own, at[k], axis=0, out=x, mode="clip")
                np.matmul(u, h, out=r)
                gates[:], rest[:] = x.T[:two], x.T[two:]
                gates += r[:two]
                gates *= 0.5
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                new *= g
                new += rest
                np.tanh(new, out=new)
                new -= h
                np.subtract(1, z, out=z)
                z *= mask[k]
                new *= z
                states[k, units] = h = h + new
        hidden = np.tanh(w["att_w"].T @ states + w["att_b"][:, None])
        e = np.where(mask > 0, w["att_v"] @ hidden, -1e9)
        e = np.exp(e - e.max(axis=0)) * mask
        share = e / np.maximum(e.sum(axis=0), 1e-9)
        return w["out_w"] @ (share[:, None] * states).sum(axis=0) + w["out_b"][0]

    # ------------------------------------------------------------ backward

    def gradients(self, words: Words, at: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, g = self.weights, {k: np.zeros_like(v) for k, v in self.weights.items()}
        x = self.inputs(words)
        p = self.projected(x)
        kept = {"f": [], "b": []}
        states = np.concatenate([self.states(p, at, mask, d, kept[d]) for d in "fb"], axis=2)
        hidden, share, context, logit = self.pooled(states, mask)
        d_logit = ((sigmoid(logit) - target) * weight / len(target)).astype(np.float32)
        g["out_w"], g["out_b"][0] = d_logit @ context, d_logit.sum()
        d_context = d_logit[:, None] * w["out_w"]
        d_share = (states * d_context).sum(axis=2)
        d_e = share * (d_share - (share * d_share).sum(axis=0))
        g["att_v"] = (d_e[:, :, None] * hidden).sum(axis=(0, 1))
        d_hidden = d_e[:, :, None] * w["att_v"] * (1 - hidden * hidden)
        g["att_w"], g["att_b"] = np.tensordot(states, d_hidden, axes=([0, 1], [0, 1])), d_hidden.sum(axis=(0, 1))
        d_states = share[:, :, None] * d_context + d_hidden @ w["att_w"].T
        d_p = np.zeros_like(p)
        for d, part, columns in (("f", d_states[:, :, :HIDDEN], slice(0, 3 * HIDDEN)), ("b", d_states[:, :, HIDDEN:], slice(3 * HIDDEN, None))):
            u, d_h = w[f"{d}_h"], np.zeros((len(target), HIDDEN), np.float32)
            for k, before, z, r, new, rn, m in reversed(kept[d]):
                d_h = d_h + part[k]
                d_new = d_h * m * (1 - z) * (1 - new * new)
                d_z = d_h * m * (before - new) * z * (1 - z)
                d_r = d_new * rn * r * (1 - r)
                d_x = np.hstack([d_z, d_r, d_new])
                d_rec = np.hstack([d_z, d_r, d_new * r])
                np.add.at(d_p[:, columns], at[:, k], d_x)
                g[f"{d}_h"] += before.T @ d_rec
                d_h = d_h * (1 - m * (1 - z)) + d_rec @ u.T
        d_p = d_p[:-1]
        d_in = np.zeros_like(x)
        for d, part in (("f", d_p[:, : 3 * HIDDEN]), ("b", d_p[:, 3 * HIDDEN :])):
            g[f"{d}_x"], g[f"{d}_b"] = x.T @ part, part.sum(axis=0)
            d_in += part @ w[f"{d}_x"].T
        if words.drop is not None:
            d_in *= np.repeat(words.drop, EMBEDDING, axis=1)
        np.add.at(g["words"], words.ids, d_in[:, :EMBEDDING])
        np.add.at(g["chars"], words.grams, np.repeat(d_in[:, EMBEDDING:] / words.sizes[:, None], words.sizes, axis=0))
        return g

    # ------------------------------------------------------------ scoring

    def numbered(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of the table of known words, which grows by the new ones, for texts as from ``raw_words``."""
        words = pa.array([*chain.from_iterable(texts)], pa.string()).dictionary_encode()
        # words are told apart by Arrow, so that each is looked up once for all texts
        kinds = [*map(bare, words.dictionary.to_numpy(zero_copy_only=False).tolist())]
        out = [*map(self.known.get, kinds)]
        new = [*{w for w, got in zip(kinds, out) if got is None}]
        if self.table is None or len(self.known) + len(new) > self.table.shape[1] - 1:
            # words met first are the most frequent: they stay, in their rows
            self.known = dict(islice(self.known.items(), MEMORY // 2))
            new = [*set(kinds).difference(self.known)]
            if self.table is None or len(self.known) + len(new) > self.table.shape[1] - 1:  # a very long text may have more words than are remembered
                table = np.zeros((2, max(MEMORY, len(self.known) + len(new)) + 1, 3 * HIDDEN), np.float32)
                if self.table is not None:
                    table[:, : len(self.known)] = self.table[:, : len(self.known)]
                self.table = table
        if new:
            at = len(self.known)
            self.known.update(zip(new, range(at, at + len(new))))
            both = self.projected(self.inputs(Words.of(new, self.vocabulary)))[:-1]
            self.table[:, at : at + len(new)] = both.reshape(len(new), 2, -1).transpose(1, 0, 2)
        rows = np.fromiter(map(self.known.__getitem__, kinds), np.int64, len(kinds))[words.indices.to_numpy()]
        return np.split(rows, np.cumsum([*map(len, texts)])[:-1])

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        ids = self.numbered([raw_words(t) for t in texts])
        at, mask, owner = windows(ids, self.table.shape[1] - 1)
        z = np.concatenate([self.logits(self.table, at[i : i + BLOCK], mask[i : i + BLOCK]) for i in range(0, len(at), BLOCK)])
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner, z)
        return sigmoid(worst)


def windows(ids: list[np.ndarray], padding: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers [window, step], which of them are words, and the text of each window."""
    places = [(i, s) for i, x in enumerate(ids) for s in window_places(len(x))]
    owner = np.asarray([i for i, _ in places])
    flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
    sizes = np.asarray([len(x) for x in ids])
    begin = (np.cumsum(sizes) - sizes)[owner]
    step = np.asarray([s for _, s in places])[:, None] + np.arange(WINDOW)
    real = step < sizes[owner][:, None]
    at = np.where(real, np.append(flat, padding)[np.where(real, begin[:, None] + step, len(flat))], padding)
    return at, real.astype(np.float32), owner


def odds(lists: list[list[str]], y: np.ndarray) -> dict[str, float]:
    """Smoothed log odds of a toxic document among those with a word, for words of LEAST_COUNT documents, relative to the prior."""
    toxic, all_ = Counter(), Counter()
    for words, label in zip(lists, y):
        own = set(words)
        all_.update(own)
        if label > 0:
            toxic.update(own)
    prior = float(y.mean())
    logit = lambda p: float(np.log(p / (1 - p)))
    return {w: logit((toxic[w] + SMOOTH * prior) / (n + SMOOTH)) - logit(prior) for w, n in all_.items() if n >= LEAST_COUNT}


def trained(texts: list[str], labels: list[int], epochs: int = 6, least_steps: int = 500, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the logistic loss of each document's worst window.

    Few labelled documents are soon known by heart, by their rare words and
    trigrams.  Against that, the first coordinate of a word's embedding starts
    at the word's log odds (which also choose the window of the first pass),
    inputs are dropped at random, and embeddings decay.
    """
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Network({}, {}, prior=float(y.mean()) if len(y) else 0.5)
    lists = [words_of(t) for t in texts]
    start = odds(lists, y)
    common = sorted(start, key=lambda w: (-abs(start[w]), w))[:VOCABULARY]
    net = Network.fresh({w: i + 1 for i, w in enumerate(common)}, seed)
    net.weights["words"] *= 0.1
    net.weights["words"][:, 0] = [0.0, *(start[w] for w in common)]
    every = {w: i for i, w in enumerate(dict.fromkeys(w for t in lists for w in t))}
    lexicon = Words.of([*every], net.vocabulary)
    numbers = [np.asarray([every[w] for w in t], np.int64) for t in lists]
    epochs = max(epochs, -(-least_steps // -(-len(y) // batch)))
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    share = y.mean()
    balance = np.where(y > 0, min(3.0, (1 - share) / share), 1.0).astype(np.float32)
    step = 0
    steps = epochs * -(-len(y) // batch)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            used, flat = np.unique(np.concatenate([numbers[k] for k in pick]), return_inverse=True)
            own = np.split(flat, np.cumsum([len(numbers[k]) for k in pick])[:-1])
            words = lexicon.some(used)
            at, mask, owner = windows(own, len(used))
            if epoch == 0:
                z = np.append(net.weights["words"][words.ids, 0], -np.inf)[at].max(axis=1)
            else:
                z = net.logits(net.projected(net.inputs(words)), at, mask)
            worst = np.lexsort((z, owner))[np.searchsorted(owner, np.arange(len(pick)), side="right") - 1]
            words.drop = (rng.random((len(used), 2)) >= (WORD_DROP, CHAR_DROP)).astype(np.float32)
            grads = net.gradients(words, at[worst], mask[worst], y[pick], balance[pick])
            step += 1
            now = rate * (1 - step / (steps + 1))
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                move = now * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                if k in ("words", "chars"):
                    move[:, int(k == "words") :] += now * DECAY * net.weights[k][:, int(k == "words") :]
                net.weights[k] -= move.astype(np.float32)
    return net


def remainder(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 4; the rows that leave 2 are held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4))


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int, most_chars: int, id_col: str, text_col: str, label_col: str) -> list[tuple[str, int]]:
    """At most ``most_rows`` documents per class (twice as many clean ones) of at most ``most_chars`` characters, by the order of a digest of their ids."""
    # several labels of a document: toxic if one of them says so
    usable = labels.where(remainder(id_col) != 2).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_doc"), text.alias("_text")).where(F.length("_text") <= most_chars)
    fitting = usable.join(texts.select(F.col("_doc").alias("_id")), "_id", "left_semi")
    order = F.md5(F.concat_ws("|", F.lit("train"), F.col("_id").cast("string")))
    picked = None
    for y, n in ((1, most_rows), (0, 2 * most_rows)):
        part = fitting.where(F.col("_y") == y).orderBy(order, "_id").limit(n)
        picked = part if picked is None else picked.union(part)
    # the picked ids are at most 3 x most_rows, so this side may be broadcast
    found = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
    # an id may come with several texts, so rows are bounded again, in a fixed order
    rows = found.select("_doc", "_text", "_y").orderBy(F.md5(F.col("_doc").cast("string")), F.xxhash64("_text")).limit(3 * most_rows).collect()
    return [(r["_text"], r["_y"]) for r in sorted(rows, key=lambda r: (r["_doc"], r["_text"]))]


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = 800, most_chars: int = 40_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = training_rows(docs, labels, most_rows, most_chars, id_col, text_col, label_col)
    net = trained([t for t, _ in rows], [y for _, y in rows])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            s = net.scores(strings(batch, "text")).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("id", "held_out")), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), (remainder(id_col) == 2).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(score, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
