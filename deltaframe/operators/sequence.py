"""Sequences: which files of a manifest a delta was made from, in which order, with a digest over them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..codes import MODE_BLK, MODE_CHR, MODE_LNK, MODE_MASK, MODE_REG, DeltaError, Status
from ..functions.binary import be, hex_lower


# -- file order as bytes --------------------------------------------------------------------------


def runs(positions: list[int]) -> list[tuple[int, int]]:
    """(first, length) of stretches of rising neighbours."""
    out: list[tuple[int, int]] = []
    for p in positions:
        if out and p == sum(out[-1]):
            out[-1] = out[-1][0], out[-1][1] + 1
        else:
            out.append((p, 1))
    return out


def encode_order(positions: list[int]) -> bytes:
    """Alternating run lengths and gaps in base 8, low digit first, one digit and a continuation bit per nibble.

    A step that is no gap ahead (backwards, or at the very start) is a zero and
    the absolute position.
    """
    numbers: list[int] = []
    end = 0
    for k, (first, length) in enumerate(runs(positions)):
        if k == 0 and first == 0:
            numbers.append(length)
        else:
            numbers += [first - end, length] if k and first > end else [0, first, length]
        end = first + length
    nibbles: list[int] = []
    for n in numbers:
        digits = [n & 7]
        while n := n >> 3:
            digits.append(n & 7)
        nibbles += [d | 8 for d in digits[:-1]] + digits[-1:]
    if len(nibbles) % 2:
        nibbles.append(0)
    return bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))


def decode_order(data: bytes, files: int) -> list[int]:
    """Positions from bytes; positions outside the manifest and cut numbers are format errors."""
    numbers: list[int] = []
    value = shift = 0
    for nibble in (x for byte in data for x in (byte >> 4, byte & 15)):
        value |= (nibble & 7) << shift
        shift += 3
        if not nibble & 8:
            numbers.append(value)
            value = shift = 0
    if shift:
        raise DeltaError(Status.FORMAT, "the sequence ends within a number")
    out: list[int] = []
    position, expect = 0, "run"
    for n in numbers:
        if expect == "absolute":
            position, expect = n, "run"
        elif n == 0:  # padding, or an absolute position follows
            expect = "absolute"
        elif expect == "gap":
            position, expect = position + n, "run"
        else:
            if position + n > files or len(out) + n > files + 1:
                raise DeltaError(Status.FORMAT, "a position outside the manifest")
            out.extend(range(position, position + n))
            position, expect = position + n, "gap"
    return out


def order_bytes(positions: Column) -> Column:
    """Positions (array of int) as sequence bytes."""
    @F.pandas_udf("binary")
    def run(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: None if x is None else encode_order([int(v) for v in x]))

    return run(positions)


def order_positions(data: Column, files: Column) -> Column:
    """Positions of sequence bytes; null where they are malformed."""
    @F.pandas_udf("array<int>")
    def run(cells: pd.Series, counts: pd.Series) -> pd.Series:
        def one(x: bytes | None, n: int | None) -> list[int] | None:
            try:
                return None if x is None or n is None else decode_order(bytes(x), int(n))
            except DeltaError:
                return None

        return pd.Series([one(x, n) for x, n in zip(cells, counts, strict=True)])

    return run(data, files)


def file_runs(kept: DataFrame, key: str, position: str) -> DataFrame:
    """``(key, first, n)``: stretches of neighbouring positions."""
    group = F.col(position) - F.row_number().over(Window.partitionBy(key).orderBy(position))
    return kept.withColumn("group", group).groupBy(key, "group").agg(F.min(position).alias("first"), F.count(F.lit(1)).alias("n")).drop("group")


def expand_runs(found: DataFrame, key: str) -> DataFrame:
    """``(key, position)`` of stretches ``(key, first, n)``."""
    return found.select(key, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("position"))


# -- digest -------------------------------------------------------------------------------------------


def file_entry(name: Column, mode: Column, size: Column, rdev: Column, linkto: Column, digest: Column) -> Column:
    """What a file adds to the sequence digest: its name without the first slash; device numbers of devices only."""
    kind = mode.bitwiseAND(F.lit(MODE_MASK))
    zero = F.lit("00").cast("string")
    tail = F.when(kind == MODE_LNK, F.concat(F.encode(linkto, "utf-8"), F.unhex(zero))).when((kind == MODE_REG) & (size > 0), digest).otherwise(F.unhex(F.lit("")))
    length = F.when(kind == MODE_LNK, F.octet_length(linkto)).when(kind == MODE_REG, size).otherwise(F.lit(0))
    device = F.when(kind.isin(MODE_BLK, MODE_CHR), rdev).otherwise(F.lit(0))
    return F.concat(F.encode(F.regexp_replace(name, "^/", ""), "utf-8"), F.unhex(zero), be(mode), be(length), be(device), tail)


def digest_by(entries: DataFrame, key: str, order: str, entry: str) -> DataFrame:
    """``(key, digest)``: lower-case hex MD5 over a key's entries in order."""
    return entries.groupBy(key).agg(F.expr(f"md5(listagg({entry}) within group (order by {order}))").alias("digest"))


def sequence_id(src_nevr: Column, sequence: Column) -> Column:
    """The text form: nevr, a dash, hex digits."""
    return F.concat(src_nevr, F.lit("-"), hex_lower(sequence))


def split_sequence_id(text: Column) -> Column:
    """struct<nevr, sequence>, the sequence as hex digits; null if there are fewer than 32."""
    parts = r"^(.+)-([0-9A-Fa-f]{32,})\s*$"
    return F.when(text.rlike(parts), F.struct(F.regexp_extract(text, parts, 1).alias("nevr"), F.lower(F.regexp_extract(text, parts, 2)).alias("sequence")))
