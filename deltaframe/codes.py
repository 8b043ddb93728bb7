"""Codes of the delta format and its options.

Fixed values: the numbers are part of the format and of its public interface.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import IntEnum


class Status(IntEnum):
    OK = 0
    MEMORY = 1
    ARGS = 2
    IO = 3
    FORMAT = 4
    CONFIG = 5
    OTHER = 6
    OVERFLOW = 7
    PROG = 8
    MISMATCH = 9
    NOINSTALL = 10


class DeltaError(ValueError):
    """An error with one of the status codes."""

    def __init__(self, status: Status, detail: str = "") -> None:
        super().__init__(detail or MESSAGES[status])
        self.status = status


MESSAGES = {
    Status.OK: "no error",
    Status.MEMORY: "memory allocation error",
    Status.ARGS: "bad arguments",
    Status.IO: "I/O error",
    Status.FORMAT: "wrong file format",
    Status.CONFIG: "misconfigured external library",
    Status.OTHER: "unspecified/unknown error",
    Status.OVERFLOW: "file too large",
    Status.PROG: "internal programming error",
    Status.MISMATCH: "file changed",
    Status.NOINSTALL: "old RPM not installed",
}
UNKNOWN_STATUS = "(undefined error value)"


class DeltaType(IntEnum):
    STANDARD = 0
    RPMONLY = 1


class Compression(IntEnum):
    NONE = 0
    GZIP = 1
    BZIP2 = 2
    LZMA = 3
    XZ = 4
    LZIP = 5
    ZSTD = 6


class CheckMode(IntEnum):
    NONE = 0
    FULL = 1
    FILESIZES = 2


class Digest(IntEnum):
    MD5 = 0
    SHA256 = 1


class PayloadFormat(IntEnum):
    DELTA = 0
    CPIO = 1
    XAR = 2


class Tag(IntEnum):
    """Fields of a delta that the typed getters accept."""

    FILENAME = 0
    VERSION = 1
    TYPE = 2
    COMP = 3
    SEQUENCE = 4
    SRCNEVR = 5
    TGTNEVR = 6
    TGTSIZE = 7
    TGTMD5 = 8
    TGTCOMP = 9
    TGTCOMPPARAM = 10
    TGTHEADERLEN = 11
    ADJELEMS = 12
    TGTLEAD = 13
    PAYLOADFMTOFF = 14
    INTCOPIES = 15
    EXTCOPIES = 16
    EXTDATALEN = 17
    INTDATALEN = 18


# Compression codes in the file (low byte; the level is in the next one).
DISK_CODES = {0: Compression.NONE, 1: Compression.GZIP, 2: Compression.BZIP2, 3: Compression.GZIP, 4: Compression.BZIP2, 5: Compression.LZMA, 6: Compression.XZ, 7: Compression.ZSTD}
TO_DISK = {Compression.NONE: 0, Compression.GZIP: 1, Compression.BZIP2: 2, Compression.LZMA: 5, Compression.XZ: 6, Compression.ZSTD: 7}
# Levels that stand for "default".
DEFAULT_LEVELS = {Compression.NONE: 0, Compression.GZIP: 9, Compression.BZIP2: 9, Compression.LZMA: 2, Compression.XZ: 3, Compression.LZIP: 0, Compression.ZSTD: 19}

RPM_MAGIC = bytes.fromhex("edabeedb")
DELTA_MAGIC = b"drpm"
LIST_MAGIC = b"RPML"
DIGEST_CODES = {1: Digest.MD5, 8: Digest.SHA256}
PAYLOAD_FORMATS = {"drpm": PayloadFormat.DELTA, "cpio": PayloadFormat.CPIO, "xar": PayloadFormat.XAR}
PAYLOAD_COMPRESSORS = {"none": Compression.NONE, "gzip": Compression.GZIP, "bzip2": Compression.BZIP2, "lzma": Compression.LZMA, "xz": Compression.XZ, "lzip": Compression.LZIP, "zstd": Compression.ZSTD}

# File kinds, file flags and verify flags of a manifest.
MODE_MASK, MODE_DIR, MODE_REG, MODE_LNK, MODE_BLK, MODE_CHR = 0o170000, 0o040000, 0o100000, 0o120000, 0o060000, 0o020000
FLAG_CONFIG, FLAG_MISSINGOK, FLAG_GHOST = 1 << 0, 1 << 3, 1 << 6
VERIFY_MD5, VERIFY_FILESIZE = 1 << 0, 1 << 1
COLOR_ELF32, COLOR_ELF64 = 1 << 0, 1 << 1
#: A copy is split at this length.
MOST_COPY = 2**31 - 1


def strerror(code: int) -> str:
    return MESSAGES.get(code, UNKNOWN_STATUS)


def on_disk(comp: int, level: int) -> int:
    """A compression and its level as one number; one without a code in the file is an error."""
    if comp not in TO_DISK:
        raise DeltaError(Status.PROG, f"compression {comp} has no code in the file")
    return TO_DISK[Compression(comp)] | level << 8


def from_disk(number: int) -> tuple[Compression, int]:
    if number & 0xFF not in DISK_CODES:
        raise DeltaError(Status.FORMAT, f"unknown compression {number & 0xFF}")
    return DISK_CODES[number & 0xFF], number >> 8


def _level(level: int) -> int:
    if not 0 <= level <= 9:
        raise DeltaError(Status.ARGS, "a level is 1 to 9, or 0 for the default")
    return level


@dataclass(frozen=True)
class MakeOptions:
    """How to make a delta; every ``with_`` method returns changed options."""

    type: DeltaType = DeltaType.STANDARD
    version: int = 3
    comp_from_rpm: bool = True
    comp: Compression = Compression.GZIP
    comp_level: int = 0
    addblk: bool = True
    addblk_comp: Compression = Compression.BZIP2
    addblk_level: int = 0
    seqfile: str | None = None
    patches: tuple[str, str] | None = None

    def with_type(self, kind: int) -> MakeOptions:
        if kind not in tuple(DeltaType):
            raise DeltaError(Status.ARGS, "unknown type of delta")
        return replace(self, type=DeltaType(kind))

    def with_version(self, version: int) -> MakeOptions:
        if version not in (1, 2, 3):
            raise DeltaError(Status.ARGS, "versions are 1 to 3")
        return replace(self, version=version)

    def with_delta_comp(self, comp: int, level: int = 0) -> MakeOptions:
        if comp not in tuple(Compression):
            raise DeltaError(Status.ARGS, "unknown compression")
        return replace(self, comp=Compression(comp), comp_level=_level(level), comp_from_rpm=False)

    def with_comp_from_rpm(self) -> MakeOptions:
        return replace(self, comp_from_rpm=True)

    def without_addblk(self) -> MakeOptions:
        return replace(self, addblk=False)

    def with_addblk_comp(self, comp: int, level: int = 0) -> MakeOptions:
        if comp not in tuple(Compression):
            raise DeltaError(Status.ARGS, "unknown compression")
        return replace(self, addblk=True, addblk_comp=Compression(comp), addblk_level=_level(level))

    def with_seqfile(self, path: str | None) -> MakeOptions:
        return replace(self, seqfile=path)

    def with_patches(self, rpmprint: str | None, patchrpm: str | None) -> MakeOptions:
        if (rpmprint is None) != (patchrpm is None):
            raise DeltaError(Status.ARGS, "both lists or neither")
        return replace(self, patches=None if rpmprint is None else (rpmprint, patchrpm))

    def check(self) -> None:
        if self.type == DeltaType.RPMONLY and self.version < 3:
            raise DeltaError(Status.ARGS, "an rpm-only delta needs version 3")
