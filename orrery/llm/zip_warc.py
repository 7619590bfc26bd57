"""WARC records in ZIP packages: a writer, and a reader that never extracts.

A package holds two stored members: ``archive/data.warc.gz``, one gzip member
per record, and ``indexes/index.cdxj``, where each record starts and how long
it is.  The reader reads the end of a package, follows the ZIP64 locator where
there is one, parses the central directory, finds the stored archive members
and their indexes, and turns the index into byte ranges; tasks then read those
ranges straight out of the package, wherever it lies.

Of records with equal payloads (SHA-1 and length) the one with the smallest
page id is written as response, the others as revisit records of it, which
carry the headers only; payloads under ``least_bytes`` are always responses.
The join that finds them goes by digest: equal payloads of a large group are
split over tasks by Spark's skew join, since the other side has one row a digest.

Packages are written once, under a name of the task attempt, and their list is
checkpointed, so a task that runs again leaves a file that nobody reads.

Defined results: a null html is an empty payload; a null page id is written
without a key, is larger than any other and reads back as null; of rows that
repeat one page id and payload exactly one is the response; an empty table
gives no package and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import checkpointed, chunks

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Compressed bytes that one task reads at once; a longer record is a range of its own.
RANGE_BYTES = 2 << 20
DATE = "1970-01-01T00:00:00Z"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the HTTP header of the page, whose Content-Length tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {url}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", url))
    if key is not None:
        head.append(f"X-Page-Key: {key}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Key: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def parse(raw: bytes) -> dict:
    """The headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = headers(head)
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a WARC record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"warc": fields, "http": headers(http), "payload": payload}


def gzip_members(raw: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """Each member's content; read in steps, so that what follows a member is copied by a step at most."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        z, parts = zlib.decompressobj(wbits=31), []
        while not z.eof:
            if at >= len(raw):
                raise ValueError("a gzip member is cut off")
            piece = view[at : at + step]
            parts.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        yield b"".join(parts)


# ---------------------------------------------------------------- writing


def duplicates_marked(pages: DataFrame, least_bytes: int) -> DataFrame:
    """key, url, payload, first_key, revisit."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("key"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.octet_length("payload")})
    at = F.struct(F.col("key").isNull().alias("last"), "key", "row")
    firsts = (
        rows.where(F.col("size") >= least_bytes)
        .groupBy("sha", "size", "key")
        .agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
        .groupBy("sha", "size")
        .agg(F.min(F.struct("first", "n")).alias("m"), F.sum("n").alias("total"))
        .where("total > 1")
        .select("sha", "size", F.col("m.first.key").alias("first_key"), F.col("m.first.row").alias("first_row"), F.col("m.n").alias("n_first"))
    )
    is_first = F.col("key").eqNullSafe(F.col("first_key")) & ((F.col("n_first") == 1) | (F.col("row") == F.col("first_row")))
    joined = rows.join(firsts, ["sha", "size"], "left")
    return joined.select("key", "url", "payload", "first_key", (F.col("n_first").isNotNull() & ~is_first).alias("revisit"))


def write_packages(pages: DataFrame, to: str, least_bytes: int = 0) -> DataFrame:
    """Write a package per task under ``to``; returns their list (path, n_records), checkpointed."""
    folder = f"{to.rstrip('/')}/warc-{uuid.uuid4().hex}"
    store, at = opened(folder)
    store.create_dir(at, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, lines = TaskContext.get(), 0, []
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.zip"
        parts = chunks(batches, "payload")
        first = next(parts, None)
        if first is None:
            return
        store, at = opened(path)
        with store.open_output_stream(at) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
            offset = 0
            with package.open(zipfile.ZipInfo(ARCHIVE, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as member:
                part = first
                while part is not None:
                    for row in part.to_pylist():
                        z = zlib.compressobj(1, wbits=31)
                        raw = z.compress(record(row["key"], row["url"], row["payload"], row["first_key"], row["revisit"])) + z.flush()
                        member.write(raw)
                        lines.append(json.dumps({"url": row["url"], "offset": offset, "length": len(raw)}))
                        offset += len(raw)
                        n += 1
                    part = next(parts, None)
            package.writestr(zipfile.ZipInfo(INDEX, (1980, 1, 1, 0, 0, 0)), "\n".join(lines) + "\n")
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

    return checkpointed(duplicates_marked(pages, least_bytes).mapInArrow(write, "path string, n_records long"))


# ---------------------------------------------------------------- reading


def read_range(f, start: int, length: int) -> bytes:
    f.seek(start)
    got = f.read(length)
    if len(got) != length:
        raise ValueError("a package is cut off")
    return got


def directory(f, size: int) -> list[dict]:
    """Members by the central directory: name, method, length, stored length and place of the local header."""
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = read_range(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    entries, length, start = struct.unpack("<10xHII", tail[end : end + 20])
    if 0xFFFFFFFF in (length, start) or entries == 0xFFFF:
        locator = read_range(f, tail_at + end - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        record_at = struct.unpack("<8xQ4x", locator)[0]
        zip64 = read_range(f, record_at, 56)
        if zip64[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        entries, length, start = struct.unpack("<32xQQQ", zip64)
    raw, at, found = read_range(f, start, length), 0, []
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError("the central directory is damaged")
        method, packed, plain, n_name, n_extra, n_note, local = struct.unpack("<10xH8xIIHHH8xI", raw[at : at + 46])
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # the fields that are full in the entry, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        found.append({"name": name, "method": method, "packed": packed, "plain": plain, "local": local})
        at += 46 + n_name + n_extra + n_note
    return found


def data_start(f, member: dict) -> int:
    """Where a member's bytes begin; its local header has a name and an extra field of its own length."""
    local = read_range(f, member["local"], 30)
    if local[:4] != b"PK\3\4":
        raise ValueError("a local header is damaged")
    n_name, n_extra = struct.unpack("<26xHH", local)
    return member["local"] + 30 + n_name + n_extra


def member_bytes(f, member: dict) -> bytes:
    raw = read_range(f, data_start(f, member), member["packed"])
    return raw if member["method"] == 0 else zlib.decompress(raw, wbits=-15)


def package_ranges(f, size: int, most: int = RANGE_BYTES) -> Iterator[tuple[int, int]]:
    """(place, length) of runs of whole records in a package.

    Indexes tell where records end; an archive member without one is one range.
    """
    members = directory(f, size)
    indexes = [m for m in members if m["name"].startswith("indexes/") and m["name"].endswith(".cdxj")]
    for archive in (m for m in members if m["name"].startswith("archive/") and m["name"].endswith(".warc.gz")):
        if archive["method"]:
            raise ValueError(f"{archive['name']} is compressed in the package; its records can't be read by range")
        start, at, held = data_start(f, archive), 0, 0
        if not indexes:
            yield start, archive["packed"]
            continue
        places = [json.loads(line) for m in indexes for line in member_bytes(f, m).decode().splitlines()]
        own = sorted((x["offset"], x["length"]) for x in places if x.get("filename", archive["name"].split("/", 1)[1]) == archive["name"].split("/", 1)[1])
        for offset, length in own:
            if held and (offset != at + held or held + length > most):
                yield start + at, held
                at, held = offset, 0
            at, held = (at if held else offset), held + length
        if held:
            yield start + at, held


def read_packages(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """Every record of the packages: key, url, record_type, refers_to, payload_bytes, payload_digest, payload."""

    def plan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = opened(path)
                with store.open_input_file(at) as f:
                    ranges = [*package_ranges(f, f.size())]
                if ranges:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(ranges)), *(pa.array(x, pa.int64()) for x in zip(*ranges))], names=["path", "start", "length"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, at = opened(row["path"])
                with store.open_input_file(at) as f:
                    raw = read_range(f, row["start"], row["length"])
                rows = []
                for r in map(parse, gzip_members(raw)):
                    revisit = r["warc"]["warc-type"] == "revisit"
                    named = r["warc"]["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and (digest(r["payload"]) != named or len(r["payload"]) != int(r["http"]["content-length"])):
                        raise ValueError("a payload doesn't have the digest or length that its record names")
                    number = lambda k: int(r["warc"][k]) if k in r["warc"] else None  # noqa: B023, E731
                    rows.append({"key": number("x-page-key"), "url": r["warc"].get("warc-target-uri"), "record_type": r["warc"]["warc-type"], "refers_to": number("x-refers-to-key"), "payload_bytes": int(r["http"]["content-length"]), "payload_digest": named, "payload": None if revisit else r["payload"]})
                yield pa.RecordBatch.from_pylist(rows, schema=READ)

    paths = packages.select("path").repartition(max(1, spark.sparkContext.defaultParallelism))
    ranges = paths.mapInArrow(plan, "path string, start long, length long")
    # dealt anew, as packages differ in size; a number of tasks is given, as few bytes of ranges mean much to read
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return ranges.repartition(tasks, "path", "start").mapInArrow(read, "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


READ = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
