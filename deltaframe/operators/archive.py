"""CPIO archives and file manifests: scanning, eligibility, normalisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..codes import (
    COLOR_ELF32, COLOR_ELF64, FLAG_CONFIG, FLAG_GHOST, FLAG_MISSINGOK, MODE_BLK, MODE_CHR, MODE_LNK, MODE_MASK, MODE_REG, MOST_COPY, VERIFY_FILESIZE, VERIFY_MD5, DeltaError, Status,
)

HEADER = 110
TRAILER = "TRAILER!!!"
MAGIC = b"070701"
FIELDS = "ino mode uid gid nlink mtime filesize devmajor devminor rdevmajor rdevminor namesize".split()


def pad(n: int, align: int = 4) -> int:
    return -n % align


@dataclass
class Entry:
    """An entry of an archive: header fields by name, its name, its content and where its header starts."""

    fields: dict[str, int]
    name: bytes
    content: bytes
    offset: int = 0


def header(fields: dict[str, int]) -> bytes:
    return MAGIC + b"".join(b"%08x" % (fields.get(f, 0) & 0xFFFFFFFF) for f in FIELDS) + b"0" * 8


def pack(fields: dict[str, int], name: bytes, content: bytes = b"") -> bytes:
    """Header, name and content, each part padded to four bytes."""
    head = header({**fields, "filesize": len(content), "namesize": len(name) + 1}) + name + b"\0"
    return head + bytes(pad(len(head))) + content + bytes(pad(len(content)))


def entries(data: bytes) -> Iterator[Entry]:
    """Entries up to and without the trailer."""
    at = 0
    while True:
        head = data[at : at + HEADER]
        if len(head) < HEADER or head[:6] != MAGIC:
            raise DeltaError(Status.FORMAT, "no archive header")
        try:
            values = [int(head[6 + 8 * i : 14 + 8 * i], 16) for i in range(len(FIELDS))]
        except ValueError as e:
            raise DeltaError(Status.FORMAT, "archive header is not in hex digits") from e
        fields = dict(zip(FIELDS, values, strict=True))
        begin = at + HEADER + fields["namesize"]
        name = data[at + HEADER : begin - 1]
        if name == TRAILER.encode():
            return
        begin += pad(HEADER + fields["namesize"])
        end = begin + fields["filesize"]
        if end > len(data):
            raise DeltaError(Status.FORMAT, "the archive is cut")
        yield Entry(fields, name, data[begin:end], at)
        at = end + pad(fields["filesize"])


def scan(archives: DataFrame, key: str, data: str) -> DataFrame:
    """``(key, pos, name, mode, size, offset, content)`` of every entry; an archive that cannot be read is an error."""
    kind = archives.schema[key].dataType.simpleString()
    schema = f"key {kind}, pos int, name string, mode long, size long, offset long, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(entries(batch.column(1)[i].as_py() or b""))
                columns = [
                    pa.array([x.name.decode("utf-8", "replace") for x in found], pa.string()), pa.array([x.fields["mode"] for x in found], pa.int64()),
                    pa.array([x.fields["filesize"] for x in found], pa.int64()), pa.array([x.offset for x in found], pa.int64()), pa.array([x.content for x in found], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(found), pa.int64())), pa.array(range(len(found)), pa.int32()), *columns], names=[x.split()[0] for x in schema.split(", ")])

    return archives.select(F.col(key).alias("key"), F.col(data).alias("data")).mapInArrow(run, schema).withColumnRenamed("key", key)


# -- relational forms ---------------------------------------------------------------------------------


def plain_name(name: Column) -> Column:
    """A name without a leading ./ or /."""
    return F.regexp_replace(name, r"^(\./|/)", "")


def is_kind(mode: Column, kind: int) -> Column:
    return mode.bitwiseAND(F.lit(MODE_MASK)) == kind


def eligible(name: Column, mode: Column, entry_size: Column, size: Column, flags: Column, verify: Column, color: Column) -> Column:
    """Whether the content of an entry may be taken from the installed file: only if it is sure to be unchanged there."""
    elf = color.bitwiseAND(F.lit(COLOR_ELF32 | COLOR_ELF64)) != 0
    library = name.contains("lib/") | name.contains("lib32/") | name.contains("lib64/")
    skipped = (
        (entry_size != size)
        | (flags.bitwiseAND(F.lit(FLAG_CONFIG | FLAG_MISSINGOK | FLAG_GHOST)) != 0)
        | (verify.bitwiseAND(F.lit(VERIFY_MD5 | VERIFY_FILESIZE)) != VERIFY_MD5 | VERIFY_FILESIZE)
        | F.coalesce(elf & ~library, F.lit(False))
    )
    return ~(is_kind(mode, MODE_REG) & skipped)


def join_manifest(found: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Entries with the manifest row of their name (the first one); entries without one are dropped."""
    first = Window.partitionBy(key, "path").orderBy("ord")
    rows = manifest.withColumn("path", plain_name(F.col("name"))).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "name")
    return found.withColumn("path", plain_name(F.col("name"))).join(rows, [key, "path"])


def is_unpatched(files: DataFrame, printed: DataFrame, patched: DataFrame, key: str = "name") -> DataFrame:
    """``files (name, md5)`` with ``unpatched``: marked so by the print ``(name, mark)``, and by the patch ``(name, md5)`` either not listed or with another digest."""
    p = printed.select(key, "mark").dropDuplicates([key])
    q = patched.select(key, F.col("md5").alias("patch_md5")).dropDuplicates([key])
    both = files.join(p, key, "left").join(q, key, "left")
    other = F.col("patch_md5").isNull() | (F.col("patch_md5") != F.col("md5"))
    return both.withColumn("unpatched", F.coalesce(F.col("mark"), F.lit(False)) & other).drop("mark", "patch_md5")


def entry_offsets(found: DataFrame, key: str, order: str, header_len: str = "header_len", content_len: str = "content_len") -> DataFrame:
    """Entries with ``offset``, the sum of the lengths of those before."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("offset", F.coalesce(F.sum(F.col(header_len) + F.col(content_len)).over(before), F.lit(0)))


# -- normalisation --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class File:
    """A row of a package's manifest."""

    name: str
    mode: int
    size: int = 0
    flags: int = 0
    md5: str = ""
    rdev: int = 0
    verify: int = VERIFY_MD5 | VERIFY_FILESIZE
    linkto: str = ""
    color: int | None = None


@dataclass
class Normalised:
    """An archive as it can be made again from installed files."""

    data: bytes
    positions: list[int] = field(default_factory=list)
    #: Pairs (altered position, original position) where the two drift apart.
    shifts: list[tuple[int, int]] = field(default_factory=list)


def may_use(file: File, entry_size: int) -> bool:
    """``eligible`` for one file."""
    if file.mode & MODE_MASK != MODE_REG:
        return True
    elf = file.color is not None and file.color & (COLOR_ELF32 | COLOR_ELF64)
    return not (
        entry_size != file.size
        or file.flags & (FLAG_CONFIG | FLAG_MISSINGOK | FLAG_GHOST)
        or file.verify & (VERIFY_MD5 | VERIFY_FILESIZE) != VERIFY_MD5 | VERIFY_FILESIZE
        or elf and not any(x in file.name for x in ("lib/", "lib32/", "lib64/"))
    )


def manifest_header(file: File) -> bytes:
    """The header (with name and padding) that a manifest row stands for."""
    kind = file.mode & MODE_MASK
    device = kind in (MODE_BLK, MODE_CHR)
    size = file.size if kind == MODE_REG else len(file.linkto.encode()) if kind == MODE_LNK else 0
    name = b"./" + file.name.lstrip("/").encode()
    fields = {"mode": file.mode, "nlink": 1, "filesize": size, "namesize": len(name) + 1, "rdevmajor": file.rdev >> 8 if device else 0, "rdevminor": file.rdev & 0xFF if device else 0}
    out = header(fields) + name + b"\0"
    return out + bytes(pad(len(out)))


def normalise(data: bytes, files: list[File], unpatched: frozenset[str] = frozenset()) -> Normalised:
    """Only entries that installed files give back, under headers made from the manifest."""
    strip = lambda name: name.removeprefix("./").removeprefix("/")
    number = {}
    for i, f in enumerate(files):
        number.setdefault(strip(f.name), i)
    out = Normalised(b"")
    parts: list[bytes] = []
    size = 0
    for e in entries(data):
        i = number.get(strip(e.name.decode("utf-8", "surrogateescape")))
        if i is None or strip(files[i].name) in unpatched and files[i].mode & MODE_MASK == MODE_REG or not may_use(files[i], e.fields["filesize"]):
            continue
        kind = files[i].mode & MODE_MASK
        content = e.content if kind == MODE_REG else files[i].linkto.encode() if kind == MODE_LNK else b""
        head = manifest_header(files[i])
        before = out.shifts[-1] if out.shifts else (0, 0)
        if size - before[0] != e.offset - before[1]:
            out.shifts.append((size, e.offset))
        body = content + bytes(pad(len(content)))
        parts += [head, body]
        size += len(head) + len(body)
        out.positions.append(i)
    parts.append(pack({"nlink": 1}, TRAILER.encode()))
    out.data = b"".join(parts)
    return out


def shift_deltas(shifts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Shifts as pairs (distance to the shift before, change of the difference), none of them beyond 31 bits."""
    out, position, drift = [], 0, 0
    for altered, original in shifts:
        distance, change = altered - position, original - altered - drift
        while distance > MOST_COPY:
            out.append((MOST_COPY, 0))
            distance -= MOST_COPY
        while abs(change) > MOST_COPY:
            part = MOST_COPY if change > 0 else -MOST_COPY
            out.append((distance, part))
            distance, change = 0, change - part
        out.append((distance, change))
        position, drift = altered, original - altered
    return out
