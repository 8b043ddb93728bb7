"""Binary encodings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVR = r"^(.+)-(?:([0-9]+):)?([^-:]+)-([^-]+)$"


def be(number: Column, bytes_: int = 4) -> Column:
    """Big-endian bytes of a non-negative long."""
    return F.unhex(F.substring(F.lpad(F.hex(number.cast("long")), 16, "0"), 17 - 2 * bytes_, 2 * bytes_))


def from_be(data: Column) -> Column:
    """The unsigned number of up to 7 big-endian bytes (8 give the signed long)."""
    return F.conv(F.hex(data), 16, -10).cast("long")


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    """Bytes of pairs of hex digits; an odd last digit is left out, other characters give null."""
    even = F.substring(text, F.lit(1), (F.length(text) / 2).cast("int") * 2)
    return F.when(even.rlike("^[0-9A-Fa-f]*$"), F.unhex(even))


def padding(offset: Column, align: int) -> Column:
    """Bytes from an offset to the next multiple of ``align``."""
    return F.pmod(-offset, F.lit(align))


def sign_magnitude(value: Column) -> Column:
    """A signed number below 2^31 in size as the unsigned one on disk: the top bit is the sign."""
    return F.when(value < 0, -value + F.lit(2**31)).otherwise(value)


def from_sign_magnitude(number: Column) -> Column:
    return F.when(number >= 2**31, -(number - F.lit(2**31))).otherwise(number)


def raw_u32(value: Column) -> Column:
    """The two's complement of a signed number, as the public getter shows it."""
    return F.when(value < 0, value + F.lit(2**32)).otherwise(value)


def block_id(offset: Column, size: int = 8192) -> Column:
    return F.floor(offset / size).cast("long")


def nevr(text: Column) -> Column:
    """struct<name, epoch, version, release>; null where the text is none."""
    part = lambda i: F.regexp_extract(text, NEVR, i)
    return F.when(
        text.rlike(NEVR), F.struct(part(1).alias("name"), F.nullif(part(2), F.lit("")).alias("epoch"), part(3).alias("version"), part(4).alias("release"))
    )


def cpio_field(header: Column, number: int) -> Column:
    """Field 0-12 (after the magic) of an ASCII CPIO header, 8 hex digits each."""
    digits = F.substring(header.cast("string"), 7 + 8 * number, 8)
    return F.conv(digits, 16, 10).cast("long")


def cpio_header(fields: list[Column]) -> Column:
    """A CPIO header of 12 fields and a checksum of zero."""
    return F.concat(F.lit("070701"), *[F.lower(F.lpad(F.hex(f.cast("long")), 8, "0")) for f in fields], F.lit("00000000"))
