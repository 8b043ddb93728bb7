"""Algebra of copy lists: encoding, absolute offsets, validation, and replay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..codes import MOST_COPY


def ext_copies(segments: Column, most: int = MOST_COPY) -> Column:
    """Segments as pairs (adj, len): adj is the distance from the end of the copy before; longer copies are split."""
    split = F.flatten(
        F.transform(
            F.filter(segments, lambda s: s["old_len"] > 0),
            lambda s: F.transform(
                F.sequence(F.lit(0).cast("long"), s["old_len"] - 1, F.lit(most).cast("long")),
                lambda at: F.struct((s["old_off"] + at).alias("off"), F.least(F.lit(most), s["old_len"] - at).cast("long").alias("len")),
            ),
        )
    )
    end = lambda p: p["off"] + p["len"]
    return F.transform(split, lambda s, i: F.struct((s["off"] - F.when(i > 0, end(F.get(split, i - 1))).otherwise(0)).alias("adj"), s["len"].alias("len")))


def int_copies(segments: Column, most: int = MOST_COPY) -> Column:
    """Insertions as pairs (copies since the insertion before, len); copies after the last one make a pair of length zero."""
    pieces = lambda s: F.ceil(s["old_len"] / F.lit(most))
    total = F.aggregate(segments, F.lit(0).cast("long"), lambda n, s: n + pieces(s))
    one = F.filter(segments, lambda s: s["new_len"] > 0)
    # with split copies the running count of pieces takes the place of the count of copies
    extra = lambda s: F.aggregate(F.filter(segments, lambda x: (x["copies"] <= s["copies"]) & (x["old_len"] > most)), F.lit(0).cast("long"), lambda n, x: n + pieces(x) - 1)
    marked = F.transform(one, lambda s: F.struct((s["copies"] + extra(s)).alias("n"), s["new_len"].alias("len")))
    pairs = F.transform(marked, lambda s, i: F.struct((s["n"] - F.when(i > 0, F.get(marked, i - 1)["n"]).otherwise(0)).alias("n_ext"), s["len"].alias("len")))
    last = F.coalesce(F.element_at(F.transform(marked, lambda s: s["n"]), F.when(F.size(marked) > 0, F.lit(-1)).otherwise(F.lit(None))), F.lit(0))
    return F.when(total > last, F.concat(pairs, F.array(F.struct((total - last).cast("long").alias("n_ext"), F.lit(0).cast("long").alias("len"))))).otherwise(pairs)


def offsets(copies: DataFrame, key: str, order: str) -> DataFrame:
    """``(key, order, adj, len)`` with ``off``, the absolute offset of each copy."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return copies.withColumn("off", F.col("adj") + F.coalesce(F.sum(F.col("adj") + F.col("len")).over(before), F.lit(0)))


def valid(copies: DataFrame, key: str, order: str, size: Column) -> DataFrame:
    """``(key, ok)``: whether all copies of a key lie within 0 .. size and none ends at zero."""
    placed = offsets(copies, key, order).withColumn("end", F.col("off") + F.col("len"))
    return placed.groupBy(key).agg(F.bool_and((F.col("off") >= 0) & (F.col("end") > 0) & (F.col("end") <= size)).alias("ok"))


def adjustments(placed: DataFrame, key: str, order: str) -> DataFrame:
    """``(key, order, off, len)`` with ``adj``, the distance from the end of the copy before."""
    return placed.withColumn("adj", F.col("off") - F.coalesce(F.lag(F.col("off") + F.col("len")).over(Window.partitionBy(key).orderBy(order)), F.lit(0)))


def sessions(steps: DataFrame, key: str, order: str, insert: Column) -> DataFrame:
    """``(key, n_ext, group)``: copies up to each insertion; copies after the last one make a group of their own."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    grouped = steps.withColumn("group", F.coalesce(F.sum(insert.cast("long")).over(before), F.lit(0)))
    return grouped.groupBy(key, "group").agg(F.sum((~insert).cast("long")).alias("n_ext"))


def last_copies(copies: DataFrame, key: str, order: str, block: int) -> DataFrame:
    """``(key, block, last)``: the last copy that needs each block of the old bytes."""
    blocks = F.sequence(F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("len") - 1) / block))
    return copies.where("len > 0").select(key, order, F.explode(blocks).alias("block")).groupBy(key, "block").agg(F.max(order).alias("last"))


def delta_rows(diffs: DataFrame) -> DataFrame:
    """Diffs as deltas: int_copies, ext_copies, int_data, ext_data_len, int_data_len, added.  Array functions only, no shuffle."""
    s = F.col("segments")
    return diffs.select(
        "pair_id",
        int_copies(s).alias("int_copies"),
        ext_copies(s).alias("ext_copies"),
        F.col("literals").alias("int_data"),
        F.aggregate(s, F.lit(0).cast("long"), lambda m, x: F.greatest(m, x["old_off"] + x["old_len"])).alias("ext_data_len"),
        F.octet_length("literals").cast("long").alias("int_data_len"),
        "added",
    )


def rebuild(old: bytes, int_pairs: list[tuple[int, int]], ext_pairs: list[tuple[int, int]], int_data: bytes, added: bytes | None = None) -> bytes:
    """The new bytes from the old ones and a delta's lists."""
    out: list[bytes] = []
    off = ext = lit = plus = 0
    for n_ext, size in int_pairs:
        for adj, length in ext_pairs[ext : ext + n_ext]:
            off += adj
            if off < 0 or off + length > len(old):
                raise ValueError("a copy lies outside the old artifact")
            piece = old[off : off + length]
            if added is not None:
                piece = (np.frombuffer(piece, np.uint8) + np.frombuffer(added, np.uint8, length, plus)).tobytes()
                plus += length
            out.append(piece)
            off += length
        ext += n_ext
        out.append(int_data[lit : lit + size])
        lit += size
    if ext != len(ext_pairs) or lit != len(int_data):
        raise ValueError("the lists of a delta do not agree")
    return b"".join(out)


def replay(olds: DataFrame, deltas: DataFrame) -> DataFrame:
    """``(pair_id, new binary)`` from ``(pair_id, old)`` and delta rows."""
    joined = deltas.join(olds.select("pair_id", F.col("old").cast("binary").alias("old")), "pair_id").select("pair_id", "old", "int_copies", "ext_copies", "int_data", "added")
    kind = joined.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                new = [
                    rebuild(old or b"", [(p["n_ext"], p["len"]) for p in ints], [(p["adj"], p["len"]) for p in exts], data, added)
                    for old, ints, exts, data, added in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.binary())], names=["pair_id", "new"])

    return joined.mapInArrow(run, f"pair_id {kind}, new binary")


def replay_relational(olds: DataFrame, deltas: DataFrame) -> DataFrame:
    """Like ``replay`` for deltas without an add block, as windows, ranges and an ordered concatenation."""
    ext = offsets(deltas.select("pair_id", F.posexplode("ext_copies").alias("ord", "c")).select("pair_id", "ord", "c.adj", "c.len"), "pair_id", "ord")
    until = Window.partitionBy("pair_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    ints = deltas.select("pair_id", F.posexplode("int_copies").alias("ord", "c"), "int_data").select("pair_id", "ord", "c.n_ext", "c.len", "int_data")
    ints = ints.withColumn("first", F.coalesce(F.sum("n_ext").over(until), F.lit(0))).withColumn("at", F.coalesce(F.sum("len").over(until), F.lit(0)))
    cut = lambda data: F.expr(f"substring({data}, cast(at + 1 as int), cast(len as int))")
    literal = ints.where("len > 0").select("pair_id", F.col("ord").alias("major"), F.lit(2**40).alias("minor"), cut("int_data").alias("piece"))
    ranges = ints.where("n_ext > 0").select("pair_id", F.col("ord").alias("major"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_ext") - 1)).alias("ord"))
    old = olds.select("pair_id", F.col("old").cast("binary").alias("old"))
    copied = ext.join(ranges, ["pair_id", "ord"]).join(old, "pair_id").withColumn("at", F.col("off")).select("pair_id", "major", F.col("ord").cast("long").alias("minor"), cut("old").alias("piece"))
    whole = literal.unionByName(copied).groupBy("pair_id").agg(F.expr("listagg(piece) within group (order by major, minor)").alias("new"))
    return deltas.select("pair_id").join(whole, "pair_id", "left").select("pair_id", F.coalesce("new", F.lit("").cast("binary")).alias("new"))
