"""Packages: lead, signature, header and archive."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, replace

from ..codes import DIGEST_CODES, PAYLOAD_COMPRESSORS, PAYLOAD_FORMATS, RPM_MAGIC, Compression, DeltaError, Digest, PayloadFormat, Status

LEAD = 96
HEADER_MAGIC = bytes.fromhex("8eade801") + bytes(4)
# Tags of header and signature, and data types by their number.
NAME, VERSION, RELEASE, EPOCH, ARCH, SOURCERPM = 1000, 1001, 1002, 1003, 1022, 1044
FILESIZES, FILEMODES, FILERDEVS, FILEDIGESTS, FILELINKTOS, FILEFLAGS, FILEVERIFY = 1028, 1030, 1033, 1035, 1036, 1037, 1045
DIRINDEXES, BASENAMES, DIRNAMES, PAYLOADFORMAT, PAYLOADCOMPRESSOR, PAYLOADFLAGS, FILECOLORS, FILEDIGESTALGO = 1116, 1117, 1118, 1124, 1125, 1126, 1140, 5011
SIG_SIZE, SIG_MD5 = 1000, 1004
_CHAR, _INT8, _INT16, _INT32, _INT64, _STRING, _BIN, _STRINGS, _I18N = range(1, 10)
_SIZES = {_CHAR: 1, _INT8: 1, _INT16: 2, _INT32: 4, _INT64: 8}

Value = bytes | str | list[str] | list[int]


@dataclass(frozen=True)
class Header:
    """A tagged structure: (type, value) by tag."""

    tags: dict[int, tuple[int, Value]]

    @staticmethod
    def parse(data: bytes, at: int = 0) -> tuple[Header, int]:
        """The header at a place and the place after it."""
        if data[at : at + 8] != HEADER_MAGIC or len(data) < at + 16:
            raise DeltaError(Status.FORMAT, "no header")
        count, size = struct.unpack(">II", data[at + 8 : at + 16])
        store = at + 16 + 16 * count
        if store + size > len(data):
            raise DeltaError(Status.FORMAT, "the header is cut")
        tags: dict[int, tuple[int, Value]] = {}
        for i in range(count):
            tag, kind, place, n = struct.unpack(">IIII", data[at + 16 + 16 * i : at + 32 + 16 * i])
            tags[tag] = kind, _value(data[store : store + size], kind, place, n)
        return Header(tags), store + size

    def encode(self) -> bytes:
        index, store = [], bytearray()
        for tag, (kind, value) in sorted(self.tags.items()):
            store += bytes(-len(store) % _SIZES.get(kind, 1))
            index.append(struct.pack(">IIII", tag, kind, len(store), _count(kind, value)))
            store += _bytes(kind, value)
        return HEADER_MAGIC + struct.pack(">II", len(index), len(store)) + b"".join(index) + bytes(store)

    def get(self, tag: int) -> Value | None:
        return self.tags[tag][1] if tag in self.tags else None

    def text(self, tag: int) -> str | None:
        value = self.get(tag)
        return value[0] if isinstance(value, list) and value else value if isinstance(value, str) else None

    def put(self, tag: int, kind: int, value: Value) -> Header:
        return Header({**self.tags, tag: (kind, value)})


def _value(store: bytes, kind: int, at: int, n: int) -> Value:
    if kind in (_STRING, _STRINGS, _I18N):
        parts = store[at:].split(b"\0", n)
        if len(parts) <= n:
            raise DeltaError(Status.FORMAT, "a string without an end")
        texts = [p.decode("utf-8", "surrogateescape") for p in parts[:n]]
        return texts[0] if kind == _STRING else texts
    if kind == _BIN:
        return store[at : at + n]
    if kind not in _SIZES or at + n * _SIZES[kind] > len(store):
        raise DeltaError(Status.FORMAT, "a value outside the header")
    width = _SIZES[kind]
    return [int.from_bytes(store[at + width * i : at + width * (i + 1)], "big") for i in range(n)]


def _count(kind: int, value: Value) -> int:
    return 1 if kind == _STRING else len(value)


def _bytes(kind: int, value: Value) -> bytes:
    if kind == _STRING:
        return value.encode("utf-8", "surrogateescape") + b"\0"
    if kind in (_STRINGS, _I18N):
        return b"".join(v.encode("utf-8", "surrogateescape") + b"\0" for v in value)
    return bytes(value) if kind == _BIN else b"".join(v.to_bytes(_SIZES[kind], "big") for v in value)


@dataclass(frozen=True)
class Package:
    lead: bytes
    signature: Header
    header: Header
    archive: bytes = b""

    @staticmethod
    def parse(data: bytes, archive: bool = True) -> Package:
        data = bytes(data)
        if len(data) < LEAD or data[:4] != RPM_MAGIC:
            raise DeltaError(Status.FORMAT, "no package")
        signature, at = Header.parse(data, LEAD)
        header, at = Header.parse(data, at + -at % 8)
        return Package(data[:LEAD], signature, header, data[at:] if archive else b"")

    @staticmethod
    def make(name: str, version: str, release: str, archive: bytes = b"", epoch: int | None = None, arch: str = "noarch", compressor: str = "none", source: bool = False, files: dict[int, tuple[int, Value]] | None = None) -> Package:
        """A small package, with a signature of size and MD5."""
        tags: dict[int, tuple[int, Value]] = {NAME: (_STRING, name), VERSION: (_STRING, version), RELEASE: (_STRING, release), ARCH: (_STRING, arch), PAYLOADFORMAT: (_STRING, "cpio"), PAYLOADCOMPRESSOR: (_STRING, compressor), PAYLOADFLAGS: (_STRING, "9")}
        if epoch is not None:
            tags[EPOCH] = _INT32, [epoch]
        if not source:
            tags[SOURCERPM] = _STRING, f"{name}-{version}-{release}.src.rpm"
        return Package(RPM_MAGIC + bytes(LEAD - 4), Header({}), Header({**tags, **(files or {})})).with_archive(archive)

    def lead_and_signature(self) -> bytes:
        raw = self.lead + self.signature.encode()
        return raw + bytes(-len(raw) % 8)

    def encode(self, archive: bool = True) -> bytes:
        return self.lead_and_signature() + self.header.encode() + (self.archive if archive else b"")

    def size(self) -> int:
        """Bytes of lead, signature, padding and header."""
        return len(self.encode(archive=False))

    def with_archive(self, archive: bytes) -> Package:
        """Another archive, under a signature of nothing but size and MD5."""
        head = self.header.encode()
        digest = hashlib.md5(head + archive).digest()
        return replace(self, archive=archive, signature=Header({SIG_SIZE: (_INT32, [len(head) + len(archive)]), SIG_MD5: (_BIN, digest)}))

    def with_payload_format(self, name: str) -> Package:
        return replace(self, header=self.header.put(PAYLOADFORMAT, _STRING, name))

    def signature_md5(self) -> bytes | None:
        return self.signature.get(SIG_MD5)

    def nevr(self) -> str:
        epoch = self.header.get(EPOCH)
        h = self.header.text
        return f"{h(NAME)}-{f'{epoch[0]}:' if epoch else ''}{h(VERSION)}-{h(RELEASE)}"

    def is_source(self) -> bool:
        return SOURCERPM not in self.header.tags

    def compressor(self) -> Compression:
        name = self.header.text(PAYLOADCOMPRESSOR) or "gzip"
        if name not in PAYLOAD_COMPRESSORS:
            raise DeltaError(Status.FORMAT, f"unknown compressor {name}")
        return PAYLOAD_COMPRESSORS[name]

    def level(self) -> int | None:
        """The level of the payload's compression: up to two digits, None if there are none."""
        flags = self.header.text(PAYLOADFLAGS) or ""
        digits = flags[:2] if flags[:2].isdigit() else flags[:1] if flags[:1].isdigit() else ""
        return int(digits) if digits else None

    def digest_algorithm(self) -> Digest:
        code = self.header.get(FILEDIGESTALGO)
        if not code:
            return Digest.MD5
        if code[0] not in DIGEST_CODES:
            raise DeltaError(Status.FORMAT, f"unknown digest {code[0]}")
        return DIGEST_CODES[code[0]]

    def payload_format(self) -> PayloadFormat:
        name = self.header.text(PAYLOADFORMAT)
        if name not in PAYLOAD_FORMATS:
            raise DeltaError(Status.FORMAT, f"unknown payload format {name}")
        return PAYLOAD_FORMATS[name]

    def payload_format_offset(self) -> int:
        """Where in the header the payload format stands."""
        raw = self.header.encode()
        count = struct.unpack(">I", raw[8:12])[0]
        for i in range(count):
            tag, _, place, _ = struct.unpack(">IIII", raw[16 + 16 * i : 32 + 16 * i])
            if tag == PAYLOADFORMAT:
                return 16 + 16 * count + place
        raise DeltaError(Status.FORMAT, "no payload format")

    def files(self) -> list:
        """The manifest, row by row from its parallel arrays; none if they are missing."""
        from ..operators.archive import File

        names = self.header.get(BASENAMES)
        if not names:
            return []
        dirs, which = self.header.get(DIRNAMES) or [], self.header.get(DIRINDEXES) or []
        arrays = [self.header.get(t) for t in (FILEMODES, FILESIZES, FILEFLAGS, FILEDIGESTS, FILERDEVS, FILEVERIFY, FILELINKTOS)]
        if any(a is None or len(a) != len(names) for a in [*arrays, which]):
            raise DeltaError(Status.FORMAT, "the arrays of the manifest differ in length")
        colors = self.header.get(FILECOLORS) or [None] * len(names)
        return [File(dirs[d] + n, *row, color=c) for d, n, c, *row in zip(which, names, colors, *arrays, strict=True)]


def manifest_tags(files: list) -> dict[int, tuple[int, Value]]:
    """The tags of a manifest."""
    split = [f.name.rpartition("/") for f in files]
    dirs = sorted({d + s for d, s, _ in split})
    return {
        BASENAMES: (_STRINGS, [n for _, _, n in split]), DIRNAMES: (_STRINGS, dirs), DIRINDEXES: (_INT32, [dirs.index(d + s) for d, s, _ in split]),
        FILEMODES: (_INT16, [f.mode for f in files]), FILESIZES: (_INT32, [f.size for f in files]), FILEFLAGS: (_INT32, [f.flags for f in files]),
        FILEDIGESTS: (_STRINGS, [f.md5 for f in files]), FILERDEVS: (_INT16, [f.rdev for f in files]), FILEVERIFY: (_INT32, [f.verify for f in files]), FILELINKTOS: (_STRINGS, [f.linkto for f in files]),
    }
