"""WARC archives: written as one gzip stream per file, normalised to one gzip member per record with an offset index.

`write_archives` decides response or revisit for every page (equal payloads of at least `min_bytes` bytes are stored once)
and writes files as a single gzip stream, the form in which many archives arrive. `normalize` inflates such a file once,
as a stream, rewrites every record as a member of its own and writes a sidecar index (one JSON line per record: offset, length,
type, id). `read_records` uses the index to fetch single members and to check them.

Files are written by the tasks to a folder that all executors share, under names that no other attempt uses; a file counts
only if the table of its stage names it, so retries and lost executors leave at most unused files. A task holds one record
and its compressed form in memory. Files are opened through pyarrow, so file, HDFS and object-store addresses work
where pyarrow supports them.

Cases: null html is an empty payload; a null url leaves out the target; null page_ids are kept (no number in the record id)
and come last among equal payloads; rows that repeat a page_id are records of their own, of equal ones the first is the
response; records of any length are handled whole; empty tables give no files. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoicelake.llm.words import Batches, Mapper, mapped
from invoicelake.session import scratch_path, staged

FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20
LEVEL = 6
#: Fixed values of the format.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, row: int, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; with `refers_to` (a record id) a revisit, which keeps the HTTP head but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id, row)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None, row: int) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{row}"


def page_of(identifier: str) -> int | None:
    number = identifier.strip("<>").split(":")[2]
    return int(number) if number else None


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]))
    return fields, block[:int(fields["content-length"])]


def inflated(source) -> "Batches":
    """Blocks of the inflated content of a gzip file of one or many members; other files as they are."""
    data = source.read(READ_BYTES)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = source.read(READ_BYTES)
        return
    unzip = zlib.decompressobj(31)
    while data:
        out = unzip.decompress(data, 4 * READ_BYTES)
        if out:
            yield out
        data = unzip.unconsumed_tail or (unzip.unused_data.lstrip(b"\0") if unzip.eof else b"")
        if unzip.eof:
            unzip = zlib.decompressobj(31)
        data = data or source.read(READ_BYTES)
    if rest := unzip.flush():
        yield rest


def records(blocks) -> "Batches":
    """The records of a stream, one after the other, each whole."""
    buffer = bytearray()
    need = None
    for block in blocks:
        buffer += block
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = re.search(rb"\r\ncontent-length:[ \t]*([0-9]+)", bytes(buffer[:end]).lower())
                if not length:
                    raise ValueError("a record without Content-Length")
                need = end + 4 + int(length[1]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer.strip():
        raise ValueError("the archive ends within a record")


def _open(path: str):
    system, place = fs.FileSystem.from_uri(path)
    return system, place


def _write(folder: str) -> Mapper:
    """Write the pages of one partition, each file as a single gzip stream."""
    def run(batches):
        system, place = _open(folder)
        out = zipper = None
        name, n, raw = "", 0, 0
        for batch in batches:
            for page_id, row, url, html, refers in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if out is None:
                    name, n, raw = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, zipper = system.open_output_stream(f"{place}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record(page_id, row, url, (html or "").encode(), refers)
                out.write(zipper.compress(data))
                n, raw = n + 1, raw + len(data)
                if raw >= FILE_BYTES:
                    out.write(zipper.flush())
                    out.close()
                    out = None
                    yield _row(f"{folder}/{name}", n, raw)
        if out is not None:
            out.write(zipper.flush())
            out.close()
            yield _row(f"{folder}/{name}", n, raw)
    return run


def _row(path: str, n: int, raw: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([raw], pa.int64())], ["path", "n_records", "raw_bytes"])


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """One row per file written: path, n_records, raw_bytes. Of equal payloads of at least `min_bytes` the smallest page_id is stored."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))
    keys = staged(rows.select("page_id", "row", F.sha1("html").alias("digest"), F.xxhash64("html").alias("check"), F.octet_length("html").alias("size"),
                              F.xxhash64("page_id", "url", "html").alias("whole")), "payloads")
    best = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = keys.where(F.col("size") >= min_bytes).groupBy("digest", "check", "size").agg(F.min(best).alias("first"))
    kept = F.concat(F.lit("urn:page:"), F.coalesce(F.col("first.page_id").cast("string"), F.lit("")), F.lit(":"), F.col("first.row"))
    plan = keys.join(firsts, ["digest", "check", "size"], "left").select("row", "whole", F.when(F.col("first.row") != F.col("row"), kept).alias("refers"))
    # both scans read the same columns, so that rows keep their numbers; whole rows are compared to be sure
    same = F.when(F.col("whole") == F.xxhash64("page_id", "url", "html"), F.col("html")).otherwise(F.raise_error(F.lit("the pages changed between two scans")))
    joined = rows.join(staged(plan, "plan"), "row").select(F.col("page_id").cast("long").alias("page_id"), "row", "url", same.alias("html"), "refers")
    _make(pages, folder)
    return staged(mapped(joined, _write(folder), "path string, n_records long, raw_bytes long"), "archives")


def _make(df: DataFrame, folder: str) -> None:
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).mkdirs(target)


def _normalize(folder: str) -> Mapper:
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = _open(path)
                target, home = _open(folder)
                name = uuid.uuid4().hex
                rows: dict[str, list] = {k: [] for k in ("offset", "length", "record_id", "type")}
                at = 0
                with system.open_input_stream(place, compression=None) as source, target.open_output_stream(f"{home}/{name}.warc.gz", compression=None) as out:
                    for data in records(inflated(source)):
                        fields, _ = parse(data)
                        zipper = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = zipper.compress(data) + zipper.flush()
                        out.write(member)
                        for k, v in zip(rows, (at, len(member), fields["warc-record-id"].strip("<>"), fields["warc-type"])):
                            rows[k].append(v)
                        at += len(member)
                with target.open_output_stream(f"{home}/{name}.idx", compression=None) as index:
                    for values in zip(*rows.values()):
                        index.write(json.dumps(dict(zip(rows, values))).encode() + b"\n")
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows["offset"]), pa.string()), pa.array([f"{folder}/{name}.warc.gz"] * len(rows["offset"]), pa.string()),
                                                  pa.array(rows["offset"], pa.int64()), pa.array(rows["length"], pa.int64()), pa.array(rows["record_id"], pa.string()),
                                                  pa.array(rows["type"], pa.string())], ["source", "path", "offset", "length", "record_id", "type"])
    return run


def normalize(archives: DataFrame, folder: str) -> DataFrame:
    """The offset index of the rewritten archives: source, path, offset, length, record_id, type. `archives` has one path per row."""
    spark = archives.sparkSession
    _make(archives, folder)
    files = archives.select("path")
    spread = files.repartition(max(1, files.count()))  # one file is one task; files are bounded by their writers
    kind = "source string, path string, offset long, length long, record_id string, type string"
    return staged(mapped(spread, _normalize(folder), kind), "index")


def _read(batches: Batches) -> Batches:
    current, source = None, None
    for batch in batches:
        rows = []
        for path, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if path != current:
                if source is not None:
                    source.close()
                system, place = _open(path)
                current, source = path, system.open_input_file(place)
            fields, block = parse(zlib.decompress(source.read_at(length, offset), 31))
            head, _, payload = block.partition(b"\r\n\r\n")
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            size = int(re.search(rb"(?i)content-length: *([0-9]+)", head)[1])
            if fields["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError("a payload does not match its digest")
            refers = fields.get("warc-refers-to")
            rows.append((page_of(fields["warc-record-id"]), size, digest, fields["warc-type"], None if refers is None else page_of(refers)))
        columns = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                                         ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_records(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, fetched by its offset and checked."""
    return mapped(index.select("path", "offset", "length"), _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back."""
    spark = pages.sparkSession
    archives = write_archives(pages, scratch_path(spark, "warc"), min_bytes)
    return read_records(normalize(archives, scratch_path(spark, "members")))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS x FROM p),
d AS (SELECT *, list_transform(range(0, 40), lambda i: CAST(instr('0123456789abcdef', x[i + 1]) - 1 AS INTEGER)) AS n FROM f),
b AS (SELECT *, list_transform(range(0, 32), lambda i: CAST(list_sum(list_transform(range(0, 5), lambda k: ((n[(5 * i + k) // 4 + 1] >> (3 - (5 * i + k) % 4)) & 1) << (4 - k))) AS INTEGER)) AS q FROM d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(q, lambda v: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[v + 1]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
