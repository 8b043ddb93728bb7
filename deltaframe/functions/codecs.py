"""Compression codecs, sniffing, and their columns."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import zlib
from collections.abc import Callable

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codes import DEFAULT_LEVELS, Compression, DeltaError, Status

# The magic numbers by which streams are told apart.
MAGIC = (
    (b"\x1f\x8b", Compression.GZIP),
    (b"BZh", Compression.BZIP2),
    (b"\xfd7zXZ\x00", Compression.XZ),
    (b"\x5d\x00\x00", Compression.LZMA),
    (b"LZIP", Compression.LZIP),
    (b"\x28\xb5\x2f\xfd", Compression.ZSTD),
)
SNIFF_BYTES = 8

def _lzip_filter(dictionary: int, preset: int = 6) -> list[dict]:
    return [{"id": lzma.FILTER_LZMA1, "preset": preset, "dict_size": dictionary, "lc": 3, "lp": 0, "pb": 2}]


def _lzip(data: bytes, level: int) -> bytes:
    """One lzip member: magic, version, coded dictionary size; a raw stream with end marker; CRC, size and member size."""
    power = 16  # the dictionary is of 64 KiB at every level
    body = lzma.compress(data, lzma.FORMAT_RAW, filters=_lzip_filter(1 << power, level or 6))
    return b"LZIP\x01" + bytes([power]) + body + struct.pack("<IQQ", zlib.crc32(data), len(data), len(body) + 26)


def _unlzip(data: bytes) -> bytes:
    """All members of an lzip file; what a member's trailer says is checked."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 5] != b"LZIP\x01" or len(data) < at + 26:
            raise ValueError("no lzip member")
        power, eighths = data[at + 5] & 31, data[at + 5] >> 5
        if not 12 <= power <= 29:
            raise ValueError("no dictionary size")
        reader = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=_lzip_filter((1 << power) - eighths * (1 << power >> 4)))
        part = reader.decompress(data[at + 6 :])
        if not reader.eof or len(reader.unused_data) < 20:
            raise ValueError("the lzip member is cut")
        crc, size, whole = struct.unpack("<IQQ", reader.unused_data[:20])
        if (crc, size, whole) != (zlib.crc32(part), len(part), len(data) - at - len(reader.unused_data) + 20):
            raise ValueError("the lzip member is damaged")
        out.append(part)
        at += whole
    return b"".join(out)


_COMPRESS: dict[int, Callable[[bytes, int], bytes]] = {
    Compression.NONE: lambda data, level: data,
    Compression.GZIP: lambda data, level: gzip.compress(data, level, mtime=0),
    Compression.BZIP2: bz2.compress,
    Compression.LZMA: lambda data, level: lzma.compress(data, lzma.FORMAT_ALONE, preset=level),
    Compression.XZ: lambda data, level: lzma.compress(data, lzma.FORMAT_XZ, lzma.CHECK_SHA256, preset=level),
    Compression.LZIP: _lzip,
    Compression.ZSTD: lambda data, level: zstandard.ZstdCompressor(level=level).compress(data),
}
_DECOMPRESS: dict[int, Callable[[bytes], bytes]] = {
    Compression.NONE: bytes,
    Compression.GZIP: gzip.decompress,
    Compression.BZIP2: bz2.decompress,
    Compression.LZMA: lambda data: lzma.decompress(data, lzma.FORMAT_ALONE),
    Compression.XZ: lambda data: lzma.decompress(data, lzma.FORMAT_XZ),
    Compression.LZIP: _unlzip,
    Compression.ZSTD: lambda data: zstandard.ZstdDecompressor().decompressobj().decompress(data),
}


def compress(data: bytes, comp: int, level: int = 0) -> bytes:
    if comp not in _COMPRESS:
        raise DeltaError(Status.CONFIG, f"no library for compression {comp}")
    return _COMPRESS[comp](data, level or DEFAULT_LEVELS[Compression(comp)])


def sniff(data: bytes) -> Compression:
    """The codec of a stream by its first bytes; a stream shorter than the sniffed bytes is an error."""
    if len(data) < SNIFF_BYTES:
        raise DeltaError(Status.FORMAT, "too short to tell its compression")
    return next((comp for magic, comp in MAGIC if data.startswith(magic)), Compression.NONE)


def decompress(data: bytes, comp: int | None = None) -> bytes:
    comp = sniff(data) if comp is None else comp
    if comp not in _DECOMPRESS:
        raise DeltaError(Status.CONFIG, f"no library for compression {comp}")
    try:
        return _DECOMPRESS[comp](bytes(data))
    except (OSError, EOFError, ValueError, lzma.LZMAError, zlib.error, zstandard.ZstdError) as e:
        raise DeltaError(Status.FORMAT, str(e)) from e


def compressed(data: Column, comp: int, level: int = 0) -> Column:
    """A binary column compressed, null where it is null."""

    @F.pandas_udf("binary")
    def run(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: None if x is None else compress(bytes(x), comp, level))

    return run(data)


def decompressed(data: Column, comp: int | None = None) -> Column:
    """A binary column decompressed, by its magic number unless a codec is named."""

    @F.pandas_udf("binary")
    def run(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: None if x is None else decompress(bytes(x), comp))

    return run(data)


def sniffed(data: Column) -> Column:
    """The codec number of a binary column; null where it is too short. No Python."""
    head = F.hex(F.substring(data, 1, SNIFF_BYTES))
    out = F.lit(int(Compression.NONE))
    for magic, comp in reversed(MAGIC):
        out = F.when(F.startswith(head, F.lit(magic.hex().upper())), int(comp)).otherwise(out)
    return F.when(F.octet_length(data) >= SNIFF_BYTES, out)
