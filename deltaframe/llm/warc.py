"""WARC archives: one gzip member per record, written by tasks, read by byte ranges.

Writing: each task appends its records to archives of its own in a folder that
all machines share, under a name no other attempt uses; only archives that a
finished task reports are part of the result.

Reading: files are cut into byte ranges.  A task looks for gzip's magic number in
its range, takes a place that it has to guess for a member if a WARC header decodes there and what
follows the member is another member or the end of the file, and owns the records
that start inside its range, wherever they end.  Where a member ends the next one is known to
start; one that doesn't decode is damaged, gives a row that says so, and the search goes on behind it.
A member may hold several records.

Cases: a null payload is an empty one; a null key or target is left out of the
record and null again when read; equal rows each give a record; of equal payloads
of at least ``REVISIT_BYTES`` those with the least key are responses, the others
revisit that key (rows without a key too, if any row has one); other columns are
not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ensure_importable, materialise, open_read, open_write, scratch_path, slices

REVISIT_BYTES = 100
RANGE_BYTES = 4 << 20
ARCHIVE_BYTES = 256 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16
_PLAIN = "".join(map(chr, range(0x21, 0x7F))).replace("%", "")


# -- one record --------------------------------------------------------------------------------


def record_id(key: int | None, digest: str, revisit: bool) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key} {digest} {revisit}')}>"


def encode_record(key: int | None, target: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A gzip member that holds one response or revisit record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(key, digest, revisit)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if target is None else quote(target, safe=_PLAIN)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest, False) if revisit else None),
        ("WARC-Refers-To-Date", DATE if revisit else None),
        ("Row-Key", key),
        ("Row-Refers-To", refers_to),
        ("Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def parse_header(head: bytes) -> dict[str, str] | None:
    """The fields of a WARC header, names in lower case; None if it isn't one."""
    lines = head.split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        return None
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return out if out.get("content-length", "").isdigit() and "warc-type" in out else None


# -- writing ---------------------------------------------------------------------------------------


def plan_records(df: DataFrame, key: str, target: str, payload: str) -> DataFrame:
    """``(key, target, payload binary, digest, revisit boolean, refers_to)`` for each row."""
    rows = df.select(
        F.col(key).cast("long").alias("key"), F.col(target).cast("string").alias("target"), F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary")).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("key").alias("first"))
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return rows.join(firsts, "digest", "left").select("key", "target", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned records under ``folder``; returns ``(path, bytes, records)`` of the archives, itself kept as a table there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        queue = (part for batch in batches for part in slices(batch, 2))
        part = next(queue, None)
        while part is not None:
            path = f"{folder}/part-{context.partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
            size = count = 0
            with open_write(path) as out:
                while part is not None and size < archive_bytes:
                    for key, target, payload, digest, revisit, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        member = encode_record(key, target, payload, digest, refers_to, revisit)
                        out.write(member)
                        size, count = size + len(member), count + 1
                    part = next(queue, None)
            done.append((path, size, count))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return materialise(records.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


# -- reading ---------------------------------------------------------------------------------------


def _member(f: BinaryIO, at: int, whole: bool) -> tuple[bytes, int] | None:
    """What the gzip member at ``at`` holds and where it ends; with ``whole`` False the header only (end -1). None if no WARC record decodes there."""
    unpack = zlib.decompressobj(31)
    f.seek(at)
    out = bytearray()
    read, end = 0, -1
    while True:
        chunk = f.read(_CHUNK if whole else 4096)
        if not chunk:
            return None
        read += len(chunk)
        before = len(out)
        try:
            out += unpack.decompress(chunk)
        except zlib.error:
            return None
        if not b"WARC/1.".startswith(out[:7]) and out[:7] != b"WARC/1.":
            return None
        if end < 0:
            end = out.find(b"\r\n\r\n", max(0, before - 3))
            if end >= 0 and parse_header(bytes(out[:end])) is None:
                return None
        if not whole and end >= 0:
            return bytes(out), -1
        if unpack.eof:
            return (bytes(out), at + read - len(unpack.unused_data)) if end >= 0 else None


def _starts_member(f: BinaryIO, at: int) -> bool:
    f.seek(at)
    head = f.read(3)
    return not head or head == MAGIC and _member(f, at, False) is not None


def records_of(raw: bytes) -> list[tuple[dict[str, str], bytes]] | None:
    """The records of an unpacked member, header fields and block; None if what it holds is something else."""
    out, at = [], 0
    while at < len(raw):
        split = raw.find(b"\r\n\r\n", at)
        fields = parse_header(raw[at:split]) if split >= 0 else None
        if fields is None:
            return None
        end = split + 4 + int(fields["content-length"])
        if end > len(raw):
            return None
        out.append((fields, raw[split + 4 : end]))
        at = end
        while raw[at : at + 2] == b"\r\n":
            at += 2
    return out


def read_range(f: BinaryIO, start: int, end: int) -> Iterator[tuple[int, dict[str, str] | None, bytes]]:
    """``(place, header fields, block)`` of the records of members that start in ``[start, end)``; fields None: a damaged member."""
    at = start
    known = start == 0  # whether a member is known to start here
    while at < end:
        f.seek(at)
        window = f.read(min(_CHUNK, end - at) + 2)
        if not window:
            return
        hit = 0 if known and window.startswith(MAGIC) else window.find(MAGIC)
        known &= hit == 0
        if hit < 0 or at + hit >= end:
            at, known = at + max(1, len(window) - 2), False
            continue
        place = at + hit
        got = _member(f, place, True) if known or _member(f, place, False) else None
        records = records_of(got[0]) if got else None
        if records is None or not known and not _starts_member(f, got[1]):
            if known:
                yield place, None, b""
            at, known = place + 1, False
            continue
        at, known = got[1], True
        for fields, block in records:
            yield place, fields, block


def ranges(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, start, end)``: byte ranges that cover the archives of ``(path, bytes)``."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    return archives.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start")).select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("end"))


def read(archives: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of archives given as ``(path, bytes)``.

    Returns path, place, key, target, record_type, refers_to, payload_bytes,
    payload_digest (both of the full payload: of a response as computed from what
    was read, of a revisit as its header says), damaged (then all else but path and place is null) and,
    if asked for, payload.
    """
    schema = "path string, place long, key long, target string, record_type string, refers_to long, payload_bytes long, payload_digest string, damaged boolean, payload binary"
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def row(path: str, place: int, fields: dict[str, str] | None, block: bytes) -> tuple:
        if fields is None:
            return path, place, *[None] * 6, True, None
        number = lambda name: int(fields[name]) if name in fields else None
        target = unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None
        kind = fields["warc-type"]
        if kind == "response":
            body = block.partition(b"\r\n\r\n")[2]
            size, digest = len(body), hashlib.sha256(body).hexdigest()
        else:
            body, size, digest = b"", number("payload-length"), fields.get("warc-payload-digest", "").removeprefix("sha256:")
        return path, place, number("row-key"), target, kind, number("row-refers-to"), size, digest, False, body if payloads else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                held = 0
                with open_read(path) as f:
                    for place, fields, block in read_range(f, start, end):
                        rows.append(row(path, place, fields, block))
                        held += len(block) + 200
                        if held > 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                yield pack(rows)

    cut = ranges(archives, range_bytes)
    dealt = cut.repartition(max(archives.sparkSession.sparkContext.defaultParallelism, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = dealt.mapInArrow(run, schema)
    return out if payloads else out.drop("payload")


def round_trip(spark: SparkSession, pages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every page written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    ensure_importable(spark)
    archives = write(plan_records(pages, "page_id", "url", "html"), scratch_path(spark, "warc"))
    # a damaged archive would have a row without a page
    return read(archives, range_bytes, payloads=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     f AS (SELECT body, min(page_id) AS first FROM p WHERE strlen(body) >= 100 GROUP BY body)
SELECT p.page_id AS page_id,
       CAST(strlen(p.body) AS BIGINT) AS payload_bytes,
       sha256(p.body) AS payload_digest,
       CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.body = f.body
"""
