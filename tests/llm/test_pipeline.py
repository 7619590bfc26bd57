"""The pipeline against its stages done one after the other by brute force in Python (mixing: by SQL in DuckDB)."""

import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def closure(n, links):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return [find(i) for i in range(n)]


def good(rows):
    import zstandard

    from orrery.llm.quality_rules import BANDS, measure

    compress = zstandard.ZstdCompressor(level=3).compress
    return [r for r in rows if measure(r["text"], compress, BANDS, 0.5)[6]]


def lined(rows):
    from orrery.llm.fuzzy_lines import normalised, similar

    seen = [(r["doc_id"], k, " ".join(w)) for r in rows for k, x in enumerate(r["text"].split("\n")) if len(w := normalised(x)) >= 3]
    names = sorted({n for *_, n in seen})
    counts = np.array([np.bincount(np.frombuffer(n.encode("utf-32-le"), np.uint32) % 64, minlength=64) for n in names])
    sizes = counts.sum(axis=1)

    def possible(i):  # edits change the counts of characters by one each
        apart = np.maximum(np.maximum(counts[:i] - counts[i], 0).sum(axis=1), np.maximum(counts[i] - counts[:i], 0).sum(axis=1))
        return np.flatnonzero(apart <= 0.2 * np.maximum(sizes[:i], sizes[i]) + 1e-9).tolist()

    links = [(i, j) for i in range(len(names)) for j in possible(i) if similar(names[i], names[j], 0.8)]
    roots = dict(zip(names, closure(len(names), links)))
    first = {}
    for i, k, n in seen:
        first[roots[n]] = min(first.get(roots[n], (i, k)), (i, k))
    gone = {(i, k) for i, k, n in seen if first[roots[n]] != (i, k)}
    out = []
    for r in rows:
        left = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if (r["doc_id"], k) not in gone)
        if left == r["text"] or left.strip(" \t\n\v\f\r"):
            out.append(r | {"text": left, "n_chars": len(left)})
    return out


def single(rows):
    from orrery.llm.minhash import bag, overlap

    bags = [bag(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i]["text"] == rows[j]["text"] or len(bags[i][0]) and len(bags[j][0]) and overlap(bags[i], bags[j]) >= 0.8]
    least = {}
    for r, root in zip(rows, closure(len(rows), links)):
        least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    return [r for r in rows if r["doc_id"] in set(least.values())]


def uses(rows):
    import duckdb
    import pyarrow as pa

    from orrery.llm.mixing import oracle_sql

    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(rows))
    return Counter(r["doc_id"] for r in con.sql(oracle_sql()).to_arrow_table().to_pylist())


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def same(a, b):
    key = lambda r: str(sorted(r.items()))
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_run_equals_brute_force(spark):
    from orrery.llm.packing import fit, word_ids

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, frame, columns = rows_of(docs), docs, docs.columns
    for stage, brute in ((corpus_pipeline.quality, good), (corpus_pipeline.lines, lined), (corpus_pipeline.near_duplicates, single)):
        before = len(rows)
        frame, rows = stage(spark, frame, SF), brute(rows)
        assert frame.columns == columns and 0 < len(rows) < before
        same(rows_of(frame), rows)
        frame = spark.createDataFrame(rows, docs.schema)
    counts = uses(rows)
    same(rows_of(corpus_pipeline.mixing(spark, frame, SF)), [r for r in rows for _ in range(counts[r["doc_id"]])])
    want, library = Counter(), word_ids(corpus_pipeline.tokenizer_path("word_bpe_49k.json")).library
    for r in rows:
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), corpus_pipeline.SEQUENCE)):
            part = ids[at : at + corpus_pipeline.SEQUENCE]
            want[r["doc_id"], k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += counts[r["doc_id"]]
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == +want
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= corpus_pipeline.SEQUENCE
    assert len(places) == fit(Counter(r["length"] for r in out), corpus_pipeline.SEQUENCE)[1]
