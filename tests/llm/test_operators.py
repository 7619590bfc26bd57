"""The operators against brute force on small fixtures, and their edge cases."""

import base64
import hashlib
import io
import random
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from orrery.llm import _components, fuzzy_lines, metric_join, minhash, mixing, packing, quality_rules, substring_dedup, token_counts, toxicity, zip_warc
from orrery.llm._components import connected_components
from orrery.llm._shared import shared_dir

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `row` string, _text string"
ODD = [(1, None), (2, ""), (3, " \n\t\n "), (None, "a text without an id, which is long enough to count as one text"), (4, "tie tie tie"), (4, "tie tie tie"), (5, "x" * 200_000), (6, "word " * 30_000)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "r", "t") for i, t in rows], DOCS)


def closure(n, links):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return [find(i) for i in range(n)]


# ---------------------------------------------------------------- 2 token counts


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter(P.path("byte_bpe_50k.json"))


def test_every_prefix_has_the_librarys_count(counter):
    rng = random.Random(3)
    parts = list("ab 's'll're  \t\n é日'T1234.,!ß") + ["<|endoftext|>", " the", "'ll", "aaaa", "   ", "\x85", "\x1c", "　"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))
        want = [len(counter.library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text) == want, text
        for budget in (0, 1, 4):
            assert len(counter.longest_prefix(text, budget)) == max(i for i, n in enumerate(want) if n <= budget)


def test_token_counts_of_odd_rows(spark, counter):
    out = token_counts.token_counts(docs(spark, ODD), P.path("byte_bpe_50k.json"), 1024).collect()
    want = Counter((i, len((t or "").encode()), len(counter.library.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) and (r["kept_bytes"] < r["n_bytes"]) == r["over_limit"] for r in out)
    assert token_counts.token_counts(docs(spark, []), P.path("byte_bpe_50k.json"), 5).count() == 0


# ---------------------------------------------------------------- 3 quality rules


def test_quality_counts_by_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "dd ", "\n", "# ", "　", "x\x1cy "]) for _ in range(rng.randrange(0, 60))) for _ in range(150)] + [t for _, t in ODD]
    got = quality_rules.quality_rules(docs(spark, list(enumerate(texts)))).collect()
    for r in got:
        t = texts[r["doc_id"]] or ""
        words = quality_rules.WORD.findall(t)
        wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        seen = Counter(wins)
        hit = {i + k for i, w in enumerate(wins) if seen[w] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if quality_rules.WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(hit) > 20 * len(words)) and not (r["base_failed"] and r["kept"])


def test_compression_bands(spark):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9))) for _ in range(3000))
    noise = base64.b64encode(rng.randbytes(9000)).decode()
    noise = " ".join(noise[i : i + 40] for i in range(0, len(noise), 40))
    listed = " ".join(f"entry-of-the-very-long-list-number-{i:05d}-which-ends-here" for i in range(4000))
    rows = {r["doc_id"]: r["verdict"] for r in quality_rules.quality_rules(docs(spark, [(1, prose), (2, noise), (3, listed)])).collect()}
    assert rows == {1: "kept", 2: "incompressible", 3: "repetitive"}
    assert quality_rules.passing(docs(spark, [(1, prose), (2, noise)])).columns == [c.strip("`") for c in ("doc_id", "text", "lang", "source", "n_chars", "row", "_text")]
    assert quality_rules.passing(docs(spark, [])).count() == 0


def test_every_band_rejects_noise_and_repetition():
    rng = random.Random(8)
    compress = zstandard.ZstdCompressor(level=3).compress
    verdict = lambda text: quality_rules.measure(text, compress, quality_rules.BANDS, 0.5)[8]
    edges = [b.from_bytes for b in quality_rules.BANDS] + [100_000]
    for low, high in zip(edges, edges[1:]):
        for size in (low, high - 1):
            plain = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(size))
            for noise in (plain, base64.b64encode(rng.randbytes(size)).decode()[:size]):
                spaced = " ".join(noise[i : i + 24] for i in range(0, size, 24))[:size]
                assert verdict(spaced) == "incompressible", size
            listed = " ".join(f"item-{i:05d}-of-the-list" for i in range(size // 20))[:size]
            assert verdict(listed) == "repetitive", size


def test_labelled_documents_by_compression():
    rows = {r["doc_id"]: r["text"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    compress = zstandard.ZstdCompressor(level=3).compress
    found = {0: [], 1: []}
    for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist():
        text = rows[r["doc_id"]] or ""
        m = quality_rules.measure(text, compress, quality_rules.BANDS, 0.5)
        if not m[5] and (r["quality"] or len(text.encode()) >= 1024):
            found[r["quality"]].append(m[6])
    assert np.mean(found[1]) >= 0.98 and np.mean(found[0]) <= 0.4 and len(found[0]) > 10


# ---------------------------------------------------------------- 9 packing


def test_fit_equals_best_fit_decreasing():
    rng = random.Random(5)
    for t in range(150):
        limit = rng.choice([7, 10, 31, 64])
        sizes = [rng.choice([1, 2, 3, limit // 2]) if t % 3 == 0 else rng.randint(1, limit) for _ in range(rng.randrange(0, 150))]
        room: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [(c, i) for i, c in enumerate(room) if c >= s]
            if fits:
                room[min(fits)[1]] -= s
            else:
                room.append(limit - s)
        assert packing.fit(Counter(sizes), limit)[1] == len(room)


def test_packing_round_trip(spark):
    rng = random.Random(8)
    rows = ODD + [(10 + i, " ".join(rng.choice(["Cat", "dog's", "<|endoftext|>", "İx", "hotel12"]) for _ in range(rng.randrange(0, 300)))) for i in range(120)]
    out = packing.best_fit_packing(packing.tokenized_pieces(docs(spark, rows), P.path("word_bpe_49k.json"), 64), 64).collect()
    library = packing.word_ids(P.path("word_bpe_49k.json")).library
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[i, k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by: dict[int, list] = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by) == packing.fit(Counter(r["length"] for r in out), 64)[1]
    assert packing.best_fit_packing(packing.tokenized_pieces(docs(spark, []), P.path("word_bpe_49k.json"), 64), 64).count() == 0


def test_word_ids_equal_the_librarys():
    w, rng = packing.WordIds(P.path("word_bpe_49k.json")), random.Random(2)
    parts = list("ab 's'll're  \t\n é日'T12.,!İΣßŉ") + ["<|endoftext|>", "<|", "\x85", "\x1c", "　", "aaa"]
    for _ in range(2000):
        x = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))
        assert w.encode(x) == np.asarray(w.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x


def test_new_words_go_to_the_library_together(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 2000)
    w = packing.WordIds(P.path("word_bpe_49k.json"))
    library, given = w.library, []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            given.append(len(texts))
            return library.encode_batch_fast(texts, **kw)

        encode = library.encode

    w.library = Counted()
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    texts = [" ".join(words), "a|b | || |c c| \x00 \x00| ß|ß", "|", "", "\xa0 \xad é\x01 x"]
    assert w.encode_all(texts) == [np.asarray(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert sum(given) < 40
    for k in range(50):  # the words met first stay, and no more are kept than a batch adds to the limit
        w.encode_all([f"{' '.join(words[:20])} {' '.join(f'x{k}y{i}' for i in range(100))}"])
        assert len(w.known) <= 2000 and words[0] in w.known
    w.mark = None
    w.known.clear()
    assert w.encode_all(texts[:1]) == [np.asarray(library.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()] and sum(given) > 600


def test_words_with_marks_are_remembered_by_their_parts():
    w, rng = packing.WordIds(P.path("word_bpe_49k.json")), random.Random(5)
    marks = [".", ",", "***", "%%%", "$", '."', "|", "<", "`~", "_"]
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)] + ["é2", "x½", "it's", "''", "", "ª"]
    texts = [" ".join(a + b for a in words for b in marks), "", "<| a", "***", "'s. 's's!"]
    texts += ["".join(rng.choice(["a", "é", "1", "²", "'s", " ", "\xa0", *marks]) for _ in range(30)) for _ in range(300)]
    assert w.encode_all(texts[:1])[0] == np.asarray(w.library.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()
    assert len(w.known) < 200  # not a thousand words
    assert w.encode_all(texts) == [np.asarray(w.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert w.encode_all([]) == [] and w.encode_all(["<|"]) == w.encode_all(["<|", ""])[:1]


# ---------------------------------------------------------------- 5 packages


def test_warc_round_trip(spark):
    pages = [(3, "http://a", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (7, "u\r\nv", ""), (None, "n", "<p>é</p>"), (9, "l", "z" * 3_000_000), (5, "t", "same"), (5, "t", "same")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, payload string")
    got = zip_warc.read_packages(spark, zip_warc.write_packages(df, shared_dir(spark))).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    rows = Counter((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    want = Counter()
    kinds = {(3, "<p>é</p>"): ("revisit", 1), (1, "<p>é</p>"): ("response", None), (2, None): ("response", None), (7, ""): ("revisit", 2), (None, "<p>é</p>"): ("revisit", 1), (9, "z" * 3_000_000): ("response", None)}
    for k, _, t in pages[:6]:
        want[(k, len((t or "").encode()), digest(t), *kinds[k, t])] += 1
    want[5, 4, digest("same"), "response", None] += 1
    want[5, 4, digest("same"), "revisit", 5] += 1
    assert rows == want
    assert zip_warc.read_packages(spark, zip_warc.write_packages(df.limit(0), shared_dir(spark))).count() == 0


def test_small_payloads_may_all_be_responses(spark):
    df = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy")], "page_id long, url string, html string")
    got = zip_warc.read_packages(spark, zip_warc.write_packages(df, shared_dir(spark), least_bytes=3))
    assert {r["record_type"] for r in got.collect()} == {"response"}


def test_directory_reads_zip64_and_refuses_others():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        with z.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True) as f:
            f.write(b"0123456789")
        z.writestr(zipfile.ZipInfo("other/x"), "abc", zipfile.ZIP_DEFLATED)
        z.comment = b"a note"
    found = {m["name"]: m for m in zip_warc.directory(raw, len(raw.getvalue()))}
    assert zip_warc.member_bytes(raw, found["archive/data.warc.gz"]) == b"0123456789" and zip_warc.member_bytes(raw, found["other/x"]) == b"abc"
    # the same directory with a ZIP64 end record and locator
    data = raw.getvalue()
    end = data.rfind(b"PK\5\6")
    n, size, start = int.from_bytes(data[end + 10 : end + 12], "little"), *(int.from_bytes(data[end + k : end + k + 4], "little") for k in (12, 16))
    record = b"PK\6\6" + (44).to_bytes(8, "little") + bytes(12) + b"".join(x.to_bytes(8, "little") for x in (n, n, size, start))
    locator = b"PK\6\7" + bytes(4) + end.to_bytes(8, "little") + (1).to_bytes(4, "little")
    wide = data[:end] + record + locator + b"PK\5\6" + bytes(4) + b"\xff\xff" * 2 + b"\xff" * 8 + bytes(2)
    assert [m["name"] for m in zip_warc.directory(io.BytesIO(wide), len(wide))] == ["archive/data.warc.gz", "other/x"]
    with pytest.raises(ValueError):
        zip_warc.directory(io.BytesIO(b"not a package" * 9), 117)


# ---------------------------------------------------------------- 7 mixing


def test_mixing_equals_sql_on_a_skewed_corpus(spark):
    import duckdb
    import pyarrow as pa

    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 40), "big" if i % 3 else rng.choice([None, "s1", "s2", "s3"])) for i in range(400)] + [(7, "a b c", "s1"), (7, "a b c", "s1"), (900, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share, repeats in ((0.95, 4.0), (1.0, 1.3)):
        got = mixing.mixed(df, mixing.word_count(F.col("text")), entropy_share=share, max_repeats=repeats, block_tokens=500)
        con = duckdb.connect()
        con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
        want = con.sql(mixing.oracle_sql(share, repeats, 500)).to_arrow_table().to_pylist()
        key = lambda r: str(sorted(r.items()))
        assert sorted(map(key, got.toArrow().to_pylist())) == sorted(map(key, want))
    assert mixing.mixed(df.limit(0), mixing.word_count(F.col("text"))).count() == 0
    whole = mixing.mixed(df, mixing.word_count(F.col("text")), keep_row=True)
    assert whole.select("row.*").columns == df.columns


# ---------------------------------------------------------------- 6 BagMinHash


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(40):
        items = np.unique(rng.integers(0, 2**63, rng.integers(5, 200)).astype(np.uint64))
        a = rng.integers(0, 9, len(items))
        b = np.maximum(0, a + rng.integers(-2, 3, len(items)))
        bags = [(items[x > 0], x[x > 0]) for x in (a, b)]
        s = minhash.signatures(bags, 512)
        off.append((s[0] == s[1]).mean() - minhash.overlap(*bags))
    assert abs(np.mean(off)) < 0.01


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(12):
        base = [rng.choice(vocabulary) for _ in range(80)]
        for _ in range(8):
            own = base[:]
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(80)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    rows += [(200, rows[0][1]), (201, None), (202, ""), (203, "few words"), (204, "few words"), (205, "r " * 500), (206, "r " * 510)]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    bags = [minhash.bag(t or "") for _, t in rows]
    same = lambda i, j: (rows[i][1] or "") == (rows[j][1] or "") or (len(bags[i][0]) and len(bags[j][0]) and minhash.overlap(bags[i], bags[j]) >= 0.8)
    roots = closure(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if same(i, j)])
    assert {i: got[i]["class_id"] for i, _ in rows} == {rows[k][0]: rows[r][0] for k, r in enumerate(roots)}
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got.values())
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    got = minhash.near_duplicates(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {r["class_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    left = minhash.without_near_duplicates(docs(spark, ODD))
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([1, 3, None, 4, 5, 6])


def test_large_groups_of_near_duplicates(spark, monkeypatch):
    """Groups far larger than a block: near copies, and documents whose signatures seem near but whose overlap is too small."""
    monkeypatch.setattr(_components, "BLOCK", 16)
    monkeypatch.setattr(_components, "SAMPLE", 1.0)
    monkeypatch.setattr(_components, "LARGE", 32)
    rng = random.Random(12)
    copies, half = ([f"w{rng.randrange(10_000)}" for _ in range(n)] for n in (200, 170))
    rows = []
    for k in range(400):
        own = copies[:]
        own[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(own)))
    for k in range(100):
        rows.append((1000 + k, " ".join(half + [f"y{rng.randrange(10**6)}" for _ in range(27)])))
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[0])
    bags = [minhash.bag(t) for _, t in rows]
    roots = closure(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if minhash.overlap(bags[i], bags[j]) >= 0.8])
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {rows[k][0]: rows[r][0] for k, r in enumerate(roots)}


def test_near_duplicates_with_clashing_columns(spark):
    names = ["_id", "_h", "key", "kept", "row", "doc_id", "text"]
    df = spark.createDataFrame([(*"abcde", 1, "one two"), (*"abcde", 2, "one two")], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    assert [tuple(r) for r in minhash.without_near_duplicates(df).collect()] == [(*"abcde", 1, "one two")]


# ---------------------------------------------------------------- 4 lines


def test_near_copies_without_ids(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(None, " ".join(base)), (None, " ".join(base[:-1] + ["other"])), (7, "quite another text of more than five words")]
    got = [r for r in minhash.near_duplicates(docs(spark, rows)).collect() if r["doc_id"] is None]
    assert [(r["class_id"], r["class_size"]) for r in got] == [(None, 2)] * 2 and sum(r["kept"] for r in got) == 1
    assert minhash.without_near_duplicates(docs(spark, rows)).count() == 2



def test_edit_distance():
    rng = random.Random(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(500):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(0, 14))) for _ in range(2))
        assert fuzzy_lines.edit_distance(a, b) == plain(a, b)
    pairs = [tuple("".join(rng.choice("ab日 ") for _ in range(rng.randrange(0, 180))) for _ in range(2)) for _ in range(60)]
    pairs += [(a, "".join(c for c in a if rng.random() > 0.15)) for a, _ in pairs]
    want = [plain(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for a, b in pairs]
    assert fuzzy_lines.all_similar(0.8, *zip(*pairs)).tolist() == want and 0 < sum(want) < len(want)


def test_lower_bound_rules_out_no_similar_pair():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinsé日l") for _ in range(rng.randrange(2, 9)))
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 400)))  # more letters than are told apart
    a, b = [], []
    for k in range(400):
        x = " ".join(word() for _ in range(rng.randrange(1, 90))) if k % 8 else "".join(rng.choice(many) for _ in range(rng.randrange(1, 200)))
        share = rng.choice([0.05, 0.15, 0.19, 0.21, 0.3])
        near = "".join(c if rng.random() > share else rng.choice(["", "q", c + "q"]) for c in x)
        a.append(x)
        b.append(rng.choice([near, near, "q" * int(len(x) * share) + x, x[int(len(x) * share) :], "".join(rng.sample(x, len(x)))]))
    a, b = [*a, "", "x", ""], [*b, "", "", "x"]
    out = fuzzy_lines.ruled_out(0.8, a, b)
    near = np.array([fuzzy_lines.similar(x, y, 0.8) for x, y in zip(a, b)])
    # pairs just beyond the limit may stay open
    assert not (out & near).any() and out.sum() > 0.6 * (~near).sum() and near.sum() > 100
    assert fuzzy_lines.all_similar(0.8, a, b).tolist() == near.tolist()


def test_few_long_lines_are_bounded_one_by_one():
    """Each of another length; in step with no other, each column of their tables cost as much as one of hundreds of pairs."""
    rng = random.Random(17)
    line = lambda n: "".join(rng.choices("abcdefgh ijkl", k=n))
    a = [line(n) for n in range(16_000, 40_000, 2_000)]
    b = [x[:100] + x[140:] if k % 2 else line(len(x)) for k, x in enumerate(a)]
    began = time.process_time()
    out = fuzzy_lines.ruled_out(0.8, a, b)
    took = time.process_time() - began
    assert out.tolist() == [k % 2 == 0 for k in range(len(a))]
    assert took < 2
    short = [(line(rng.randrange(1, 90)), line(rng.randrange(1, 90))) for _ in range(400)]
    short += [(x, x[: rng.randrange(len(x) + 1)] + y[:9]) for x, y in short]
    x, y = map(list, zip(*short))
    together = fuzzy_lines.ruled_out(0.8, x, y)
    assert together.tolist() == [bool(fuzzy_lines.ruled_out(0.8, [p], [q])[0]) for p, q in short]
    assert 0 < together.sum() < len(together)


def test_members_meet_packed_and_bodies_are_sifted(spark):
    """A row holds many keys, buckets meet whole, and a member with nothing to test gets no body."""
    kind = np.dtype([("bucket", "<i8"), ("cid", "<i8")])
    nodes = spark.range(3000).selectExpr("id as cid").repartition(3)
    passed = spark.sparkContext.accumulator(0)

    def records(batches):
        for batch in batches:
            cid = np.repeat(batch.column(0).to_numpy(), 2)
            out = np.empty(len(cid), kind)
            out["cid"], out["bucket"] = cid, np.where(np.arange(len(cid)) % 2, cid // 3, 7_000_000 + cid % 2)
            yield out

    def solve(batch, group):
        passed.add(batch.num_rows)
        return batch.append_column("size", _components.pa.array(np.bincount(group)[group]))

    hints = np.array([7_000_000, 7_000_001]), np.array([4, 4], np.int32)
    met = _components.meeting(nodes, records, kind, hints, solve, "bucket long, cid long, salt int, blocks int, size long").collect()
    assert len(met) == 6000 and passed.value == 6000
    sizes = Counter((r["bucket"], r["salt"]) for r in met)
    assert all(r["size"] == sizes[r["bucket"], r["salt"]] for r in met) and len(sizes) == 1000 + 8 and {r["blocks"] for r in met} == {1, 4}

    wanted = spark.createDataFrame([(-5,), (3,), (2**62,)], "cid long")
    rows = spark.range(-2000, 200_000).selectExpr("id as cid", "cast(id as string) as body").union(spark.createDataFrame([(2**62, "far")], "cid long, body string"))
    assert sorted(map(tuple, _components.among(rows, wanted).collect())) == [(-5, "-5"), (3, "3"), (2**62, "far")]
    assert _components.among(rows, wanted.limit(0)).count() == 0

    # 1, 2 and 5 seem near; 1 and 2 are of one component, 3 is alone; the pair 1-5 is tested in bucket 10, which both share first
    rows = [(10, 1, 1, [10, 11], b"a"), (10, 5, 5, [10, 11], b"a"), (10, 3, 3, [10, 11], b"z"), (11, 1, 1, [10, 11], b"a"), (11, 5, 5, [10, 11], b"a"), (12, 1, 1, [12], b"a"), (12, 2, 1, [12], b"a")]
    names = ["bucket", "cid", "component", "buckets", "sig", "i", "j", "own"]
    batch = _components.pa.RecordBatch.from_pylist([dict(zip(names, [*r, 0, 0, 0])) for r in rows])
    got = [x.to_pylist() for x in _components.in_groups(("bucket", "i", "j"), _components.open_members(lambda x, y: (x == y).all(axis=1) * 1.0, 0.5))(iter([batch]))]
    assert [(r["bucket"], r["cid"]) for part in got for r in part] == [(10, 1), (10, 5)]


def test_lines_by_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(40)] for _ in range(12)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(bases)[:]
            if rng.random() < 0.5:
                line[rng.randrange(40)] = rng.choice(vocabulary)
            lines.append(rng.choice([" ".join(line), " ".join(line).upper() + ".", "", "a b"]))
        rows.append((i, "\n".join(lines)))
    rows += [(50, None), (51, ""), (52, "x" * 50_000)]
    seen = [(i, k, " ".join(w)) for i, t in rows for k, line in enumerate((t or "").split("\n")) if len(w := fuzzy_lines.normalised(line)) >= 3]
    names = sorted({n for *_, n in seen})
    links = [(i, j) for i in range(len(names)) for j in range(i) if fuzzy_lines.similar(names[i], names[j], 0.8)]
    roots = dict(zip(names, closure(len(names), links)))
    first: dict[int, tuple] = {}
    for i, k, n in seen:
        first[roots[n]] = min(first.get(roots[n], (i, k)), (i, k))
    want: dict[int, list] = {i: [] for i, _ in rows}
    for i, k, n in seen:
        if first[roots[n]] != (i, k):
            want[i].append(k)
    out = fuzzy_lines.without_repeated_lines(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in out} == want and links
    for r in out:
        text = dict(rows)[r["doc_id"]]
        assert r["text"] == (text if not want[r["doc_id"]] else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[r["doc_id"]]))


def simhash(line):
    hashes = [xxhash.xxh3_64_intdigest(w) for w in line.split()]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_edit_similarity_alone_decides_which_lines_are_near(spark):
    rng = random.Random(21)
    made = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 10)))
    lines = []
    for size in (4, 6, 9, 14, 20, 30, 50, 90):
        for _ in range(6):
            base = [made() for _ in range(size)]
            lines.append(" ".join(base))
            for share in (0.05, 0.12, 0.18, 0.3):  # words of about this share of the line replaced, left out or put in
                line = base[:]
                for _ in range(max(1, round(share * size))):
                    at = rng.randrange(len(line))
                    line[at : at + rng.randrange(2)] = rng.choice([[made()], [made()], []])
                lines.append(" ".join(line))
    rng.shuffle(lines)
    lines = [x for x in dict.fromkeys(lines) if len(x.split()) >= 3]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if fuzzy_lines.similar(lines[i], lines[j], 0.8)]
    sims = [simhash(x) for x in lines]
    assert sum((sims[i] ^ sims[j]).bit_count() > 3 for i, j in links) > 100  # blocks of a SimHash would miss these
    roots = closure(len(lines), links)
    got = {r["doc_id"]: r["kept_in"] for r in fuzzy_lines.without_repeated_lines(docs(spark, list(enumerate(lines)))).collect()}
    assert got == {i: [] if root == i else [root] for i, root in enumerate(roots)}


def test_large_groups_of_lines(spark, monkeypatch):
    """Near copies and lines that only seem near, in groups far larger than a block, as all buckets are split."""
    monkeypatch.setattr(_components, "BLOCK", 16)
    monkeypatch.setattr(_components, "SAMPLE", 1.0)
    monkeypatch.setattr(_components, "LARGE", 32)
    rng = random.Random(3)
    made = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 10)))
    copies, half = [made() for _ in range(30)], [made() for _ in range(20)]
    lines = []
    for k in range(400):
        own = copies[:]
        own[rng.randrange(30)] = made()
        lines.append(" ".join(own))
        if k % 4 == 0:
            lines.append(" ".join(half + [made() for _ in range(12)]))
    lines = [*dict.fromkeys(lines)]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if fuzzy_lines.similar(lines[i], lines[j], 0.8)]
    roots = closure(len(lines), links)
    got = {r["doc_id"]: r["kept_in"] for r in fuzzy_lines.without_repeated_lines(docs(spark, list(enumerate(lines)))).collect()}
    assert got == {i: [] if root == i else [root] for i, root in enumerate(roots)}


def test_lines_of_sf001_by_exhaustive_comparison(spark):
    """Every pair of the different lines of a corpus that lengths and counts of characters don't rule out, measured on its own."""
    texts = [r["text"] or "" for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    names = sorted({" ".join(w) for t in texts for x in t.split("\n") if len(w := fuzzy_lines.normalised(x)) >= 3})
    counts = np.array([np.bincount(np.frombuffer(n.encode("utf-32-le"), np.uint32) % 64, minlength=64) for n in names])
    sizes = counts.sum(axis=1)
    pairs = []
    for i in range(len(names)):
        longer = np.maximum(sizes[:i], sizes[i])
        apart = np.maximum(np.maximum(counts[:i] - counts[i], 0).sum(axis=1), np.maximum(counts[i] - counts[:i], 0).sum(axis=1))
        pairs += [(i, int(j)) for j in np.flatnonzero(apart <= 0.2 * longer + 1e-9) if fuzzy_lines.similar(names[i], names[j], 0.8)]
    classes = spark.createDataFrame(list(enumerate(names)), "cid long, norm string")
    members = fuzzy_lines.candidates(classes, 0.8)
    sketch = {r["cid"]: np.frombuffer(r["sig"], np.uint8)[None, :] for r in fuzzy_lines.sketched(classes).collect()}
    buckets: dict[int, set] = {}
    for r in members.collect():
        buckets.setdefault(r["cid"], set()).add(r["bucket"])
    found = [bool(buckets.get(i, set()) & buckets.get(j, set())) and fuzzy_lines.closeness(0.8, sketch[i], sketch[j])[0] >= fuzzy_lines.LEAST_SHARE for i, j in pairs]
    assert len(found) > 20 and np.mean(found) >= 0.9


def test_lines_with_clashing_columns(spark):
    names = ["removed", "n_lines", "_gid", "_id", "_th", "_text", "row", "doc_id", "text", "th", "removed_lines"]
    df = spark.createDataFrame([(*"abcdefg", 1, "one two three", "t", "u"), (*"abcdefg", 2, "one two three", "t", "u")], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = {r["doc_id"]: r.asDict() for r in fuzzy_lines.without_repeated_lines(df).collect()}
    kept = {"removed": "a", "_gid": "c", "_id": "d", "_th": "e", "_text": "f", "row": "g", "th": "t"}
    assert out == {1: kept | {"doc_id": 1, "text": "one two three", "n_lines": 1, "removed_lines": [], "kept_in": []}, 2: kept | {"doc_id": 2, "text": "", "n_lines": 1, "removed_lines": [0], "kept_in": [1]}}


def test_lines_of_odd_rows(spark):
    rows = [(None, "one two three"), (1, "one two three"), (1, "one two three"), (2, "ONE  two, three\nshort")]
    out = Counter((r["doc_id"], r["text"]) for r in fuzzy_lines.without_repeated_lines(docs(spark, rows)).collect())
    assert out == Counter({(None, ""): 1, (1, "one two three"): 2, (2, "short"): 1})
    assert fuzzy_lines.without_repeated_lines(docs(spark, [])).count() == 0


def test_lines_that_only_seem_near_are_tested_together():
    """As nearly all pairs have to be tested there, a few large calls do it; the one link among them is found."""
    n, calls = 200, []
    bodies = [f"line {k}" for k in range(n)]

    def check(a, b):
        calls.append(len(a))
        return np.array([{x, y} == {"line 7", "line 190"} for x, y in zip(a, b)])

    columns = {"bucket": [5] * n, "i": [0] * n, "j": [0] * n, "own": [0] * n, "cid": range(n), "component": range(n), "buckets": [[5]] * n, "sig": [b"s"] * n, "body": bodies}
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=[*columns])
    out = _components.links_of(lambda one, many: np.ones(len(one)), 0.5, check)(batch, np.zeros(n, np.int64))
    assert out.to_pylist() == [{"a": 7, "b": 190}]
    assert sum(calls) > 19_000 and len(calls) <= 6


def test_a_line_met_everywhere_is_one_record_a_pack(spark):
    """What is shuffled to find the classes doesn't grow with the copies; all occurrences are kept beside it."""
    df = fuzzy_lines.tagged(docs(spark, [(k, f"the same few words\nonly here {k} \u00e4 \U0001f600") for k in range(300)]).coalesce(1), "doc_id", "text")
    whole = fuzzy_lines.line_occurrences(df, 3)
    rows = whole.collect()
    firsts = np.concatenate([np.frombuffer(r["firsts"], fuzzy_lines.FIRST) for r in rows])
    names = [x for r in rows for x in bytes(r["norms"]).decode().split("\n")]
    assert dict(zip(names, firsts["n"].tolist())) == {"the same few words": 300} | {" ".join(fuzzy_lines.normalised(f"only here {k} \u00e4 \U0001f600")): n for k, n in ((1, 10), (10, 90), (100, 200))}
    assert len(firsts) == 4 and sum(len(r["occurrences"]) for r in rows) == 600 * fuzzy_lines.OCCURRENCE.itemsize
    got = {r["norm"]: (r["n"], r["first"]["doc_id"], r["first"]["line"]) for r in fuzzy_lines.line_classes(whole.union(whole)).collect()}
    assert got["the same few words"] == (600, 0, 0) and sorted(x[1:] for x in got.values()) == [(0, 0), (0, 1), (10, 1), (100, 1)]


def test_more_links_join_components_and_new_nodes(spark):
    comps = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, component long")
    more = spark.createDataFrame([(2, 6), (0, 9), (20, 21), (21, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in _components.joined_components(comps, more).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 0: 0, 8: 0, 9: 0, 20: 3, 21: 3, 3: 3}


# ---------------------------------------------------------------- 10 substrings


def stripped(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()


@pytest.mark.parametrize(("length", "gram", "hot", "seed"), [(30, 10, 4096, 1), (30, 10, 2, 2), (60, 20, 4096, 3)])
def test_substrings_by_brute_force(spark, length, gram, hot, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    parts = [word(rng.randrange(20, 120)) for _ in range(6)]
    texts = ["".join(rng.choice([rng.choice(parts), word(rng.randrange(1, 60)), "x" * rng.randrange(0, 60), "é" * 3]) for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    texts += [None, "", "abc" * 50, "abc" * 50]
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.digest_rows(substring_dedup.without_repeats(docs(spark, list(enumerate(texts))), length, gram, hot)).collect()}
    assert got == dict(enumerate(stripped([(t or "").encode() for t in texts], length)))


def test_substrings_across_parts_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 300)
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abcdefg ") for _ in range(2000)) for _ in range(2))
    bodies = [(a + b).encode(), (b[500:1700] + a[:900]).encode()]
    parts = [(r, p, x) for r, p, x in substring_dedup.text_parts(bodies, 60)]
    assert {(r, p + i): x[i : i + 60] for r, p, x in parts for i in range(len(x) - 59)} == {(r, i): t[i : i + 60] for r, t in enumerate(bodies) for i in range(len(t) - 59)}
    out = substring_dedup.without_repeats(docs(spark, ODD)).collect()
    rows = Counter((r["doc_id"], r["n_bytes"], len(r["kept"])) for r in out)
    assert rows[5, 200_000, 0] == 1 and rows[1, 0, 0] == 1 and rows[4, 11, 11] == 2
    assert substring_dedup.without_repeats(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 1 vectors


@pytest.mark.parametrize("root, block", [(32, 2048), (1, 2048), (2, 16), (0.5, 7)])
def test_vectors_by_brute_force(spark, monkeypatch, root, block):
    monkeypatch.setattr(metric_join, "ROOT", root)
    monkeypatch.setattr(metric_join, "BLOCK", block)
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 8))
    rows = [(i, (centers[rng.integers(12)] + 0.15 * rng.standard_normal(8)).astype(np.float32).tolist(), int(rng.integers(2))) for i in range(160)]
    rows += [(200, rows[0][1], rows[0][2]), (201, None, 0), (202, [0.0] * 8, 0), (203, [float("nan")] + [1.0] * 7, 0), (204, rows[0][1], None), (205, [None] + [1.0] * 7, 1), (206, [1.0, 2.0], 0), (207, [float("inf")] * 8, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = {r["vec_id"]: r for r in metric_join.near_vectors(df).collect()}
    ok = [k for k, r in enumerate(rows) if r[1] is not None and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]

    def cosine(a, b):
        x, y = np.asarray(a, float), np.asarray(b, float)
        return x @ y / np.sqrt((x @ x) * (y @ y)) if len(x) == len(y) else -1

    links = [(i, j) for i in ok for j in ok if j < i and rows[i][2] == rows[j][2] and cosine(rows[i][1], rows[j][1]) >= 0.93]
    n = Counter(k for link in links for k in link)
    roots = closure(len(rows), links)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {rows[k][0]: (n[k], rows[roots[k]][0], roots[k] == k) for k in range(len(rows))}
    assert len(links) > 100


def test_vectors_with_odd_ids(spark):
    v = [1.0, 0.0]
    df = spark.createDataFrame([(None, v, 1), (4, v, 1), (4, v, 1), (4, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in metric_join.near_vectors(df).collect())
    assert got == Counter({(None, 2, 4, False): 1, (4, 2, 4, True): 2, (4, 0, 4, True): 1})
    assert metric_join.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("values, kind", [(("1.50", "2.50"), "decimal(10,2)"), (("2020-01-01", "2020-01-02"), "date"), (("a", "b"), "binary"), (("0.0", "1.0"), "double"), (("true", "false"), "boolean")])
def test_vectors_with_labels_of_any_type(spark, values, kind):
    rows = [(i, [1.0, i / 100], values[i % 2]) for i in range(40)] + [(90, [1.0, 0.0], None), (91, [1.0, 0.0], "-0.0" if kind == "double" else values[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").withColumn("label", F.col("label").cast(kind))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in metric_join.near_vectors(df).collect()}
    assert got == {i: (20 if i % 2 == 0 else 19, i % 2) for i in range(40)} | {90: (0, 90), 91: (20, 0)}


# ---------------------------------------------------------------- 8 toxicity


def test_gradients():
    net = toxicity.Network.fresh({"a": 1, "b": 2}, 1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    words = toxicity.Words.of(["a", "b", "cat"], net.vocabulary)
    at = np.array([[0, 1, 2, 3], [2, 0, 3, 3]])
    mask, y, weight = (at < 3).astype(float), np.array([1.0, 0.0]), np.array([1.0, 2.0])
    grads = net.gradients(words, at, mask, y, weight)

    def loss():
        z = net.logits(net.projected(net.inputs(words)), at, mask)
        return (weight * (np.log1p(np.exp(z)) - y * z)).mean()

    for k, w in net.weights.items():
        i = np.unravel_index(np.abs(grads[k]).argmax(), w.shape)
        old = w[i]
        w[i] = old + 1e-3
        high = loss()
        w[i] = old - 1e-3
        low = loss()
        w[i] = old
        assert (high - low) / 2e-3 == pytest.approx(grads[k][i], rel=1e-2, abs=1e-5), k


def plain_score(net, text):
    """A text's score, word by word and window by window, with numpy on single vectors only."""
    w, words = net.weights, toxicity.words_of(text)
    squash = lambda v: 1 / (1 + np.exp(-v))

    def given(word):
        grams = [w["chars"][g] for g in toxicity.trigrams(word)]
        return np.concatenate([w["words"][net.vocabulary.get(word, 0)], sum(grams) / len(grams)])

    def read(xs, d):
        h, out = np.zeros(toxicity.HIDDEN), []
        for x in xs:
            a, u = np.split(x @ w[d + "_x"] + w[d + "_b"], 3), np.split(h @ w[d + "_h"], 3)
            z, g = squash(a[0] + u[0]), squash(a[1] + u[1])
            h = z * h + (1 - z) * np.tanh(a[2] + g * u[2])
            out.append(h)
        return out

    best, start = -np.inf, 0
    while True:
        xs = [given(x) for x in words[start : start + toxicity.WINDOW]]
        logit = w["out_b"][0]
        if xs:
            states = [np.concatenate(p) for p in zip(read(xs, "f"), read(xs[::-1], "b")[::-1])]
            e = np.exp([np.tanh(s @ w["att_w"] + w["att_b"]) @ w["att_v"] for s in states])
            logit = logit + sum(k * s for k, s in zip(e / e.sum(), states)) @ w["out_w"]
        best = max(best, logit)
        if start + toxicity.WINDOW >= len(words):
            return squash(best)
        start += toxicity.STRIDE


def test_toxicity_scores_word_by_word():
    rng = random.Random(5)
    words = ["mud", "sea", "lamp", "Ürn", "(oak)", "x", "..."]
    texts = ["", " \n", "mud", *(" ".join(rng.choices(words, k=k)) for k in (2, 47, 48, 49, 72, 73, 96, 97, 500))]
    net = toxicity.Network.fresh({w: i + 1 for i, w in enumerate(words[:5])}, 3)
    assert np.allclose(net.scores(texts), [plain_score(net, t) for t in texts], atol=1e-5)


def test_toxicity_on_few_labels(spark):
    """sf0.01 labels 37 toxic documents outside the held-out quarter, and 14 in it."""
    from orrery.llm.queries import QUERIES

    at = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    name = next(n for n in QUERIES if n.startswith("op8_"))
    held = [r for r in QUERIES[name](spark, at).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    caught = sum(r["predicted"] for r in held if labels[r["doc_id"]])
    wrong = sum(r["predicted"] for r in held if not labels[r["doc_id"]])
    assert caught >= 8 and wrong <= 4


def test_toxicity_sample_passes_over_long_texts(spark):
    rows = [(i, "a " * (50_000 if i % 2 else 3) + str(i)) for i in range(80)] + [(4, "another text of four")]
    labels = spark.createDataFrame([(i, 1, y) for i in range(80) for y in ((0, 1) if i == 4 else (i % 3 // 2,))], "doc_id long, quality int, toxic int")
    got = toxicity.training_rows(docs(spark, rows), labels, 5, 40_000, "doc_id", "text", "toxic")
    assert all(len(t) <= 40_000 for t, _ in got)
    assert sum(y for _, y in got) >= 5 and sum(1 - y for _, y in got) >= 10
    assert got == toxicity.training_rows(docs(spark, rows[::-1]).repartition(3), labels, 5, 40_000, "doc_id", "text", "toxic")


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    plain, bad = [f"w{i}" for i in range(200)], ["scumbag", "moronic"]

    def text(toxic):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        return " ".join(words)

    rows = [(i, text(i % 4 == 0)) for i in range(600)] + [(None, "a"), (700, None), (701, "")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in out if r["doc_id"] is not None)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    assert toxicity.toxicity(docs(spark, []), labels.limit(0)).count() == 0


def test_windows_cover_all_words():
    for n in range(0, 200):
        starts = toxicity.window_places(n)
        assert {s + k for s in starts for k in range(toxicity.WINDOW) if s + k < n} == set(range(n))
        assert all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:]))


# ---------------------------------------------------------------- components


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    nodes = sorted({x for link in links if link[0] != link[1] for x in link})
    roots = closure(131, links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: roots[x] for x in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_inputs_are_kept_from_the_first_words_on(monkeypatch):
    rng = random.Random(4)
    often = [f"w{i}é" for i in range(20)]
    texts = [" ".join(often), "", *(" ".join(rng.choice([*often, f"n{rng.randrange(10**6)}", "\x1c", "a\xa0b", "(", "日本!"]) for _ in range(120)) for _ in range(40))]
    net = toxicity.Network.fresh({w: i + 1 for i, w in enumerate(often)}, 3)
    monkeypatch.setattr(toxicity, "MEMORY", 150)
    got = np.concatenate([net.scores([t]) for t in texts])
    more = [" ".join(f"{c}{i}" for i in range(60)) for c in "xyz"]
    texts, got = texts + more, np.append(got, [net.scores([t])[0] for t in more])
    assert set(toxicity.words_of(texts[0])) <= set(net.known) and len(net.known) <= 150 < len({w for t in texts for w in toxicity.words_of(t)})
    plain = toxicity.Network(net.vocabulary, net.weights)
    for t, s in zip(texts, got):  # each word by its own trigrams, each window by the forward pass of training
        words = toxicity.words_of(t)
        assert words == [w.strip(".,;:!?\"'()[]{}") or w for w in toxicity.WORD.findall(t.lower())]
        x = toxicity.Words.of(words, net.vocabulary)
        assert x.grams.tolist() == [g for w in words for g in toxicity.trigrams(w)]
        at, mask, _ = toxicity.windows([np.arange(len(words))], len(words))
        p = plain.projected(plain.inputs(x))
        states = np.concatenate([plain.states(p, at, mask, d, []) for d in "fb"], axis=2)
        assert abs(toxicity.sigmoid(plain.pooled(states, mask)[-1].max()) - s) < 1e-5
    assert abs(net.scores([" ".join(f"q{i}" for i in range(1000)), texts[0]])[1] - got[0]) < 1e-5  # more words than are remembered
    assert abs(net.scores(texts[:1])[0] - got[0]) < 1e-5
