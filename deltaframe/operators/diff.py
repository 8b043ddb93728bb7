"""Finding what a new artifact has in common with an old one.

The old bytes are indexed by their aligned 16-byte blocks, first occurrence first.
All windows of the new bytes are looked up at once; only places with a hit are
visited, from left to right.  A hit is extended both ways and taken if it is long
enough, unless it merely continues the copy before it.  With an add block, copies
also reach over differing bytes as long as that pays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import byte_slices

BLOCK = 16
LEAST = 32

SEGMENT = "array<struct<old_off:bigint,old_len:bigint,new_off:bigint,new_len:bigint,copies:bigint>>"


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 4
    return n


def _keys(data: np.ndarray, step: int) -> np.ndarray:
    """A 64-bit mix of the block at every ``step``-th place."""
    if len(data) < BLOCK:
        return np.zeros(0, np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(data, BLOCK)[::step]
    halves = np.ascontiguousarray(windows).view("<u8")
    return halves[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (halves[:, 1] + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)


def block_hits(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``new`` whose 16 bytes are an aligned block of ``old``, and the first such block's offset."""
    known, first = np.unique(_keys(old, BLOCK), return_index=True)
    asked = _keys(new, 1)
    if not len(known) or not len(asked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    at = np.flatnonzero(known[place] == asked)
    offset = first[place[at]] * BLOCK
    same = (np.lib.stride_tricks.sliding_window_view(new, BLOCK)[at] == np.lib.stride_tricks.sliding_window_view(old, BLOCK)[offset]).all(axis=1)
    return at[same], offset[same]


def exact_matches(old: np.ndarray, new: np.ndarray) -> list[tuple[int, int, int]]:
    """``(old offset, new offset, length)`` of copies worth making, by place in ``new`` and without overlap."""
    at, offset = block_hits(old, new)
    out: list[tuple[int, int, int]] = []
    done = 0  # bytes of new that are dealt with
    shift = None  # old minus new offset of the last copy
    k = 0
    while k < len(at):
        n, o = int(at[k]), int(offset[k])
        if n < done:
            k = int(np.searchsorted(at, done))
            continue
        back = common_prefix(old[max(0, o - (n - done)) : o][::-1], new[done:n][::-1])
        length = back + common_prefix(old[o:], new[n:])
        start, size = n - back, length
        if shift is not None and start + shift >= 0:  # does the copy before simply go on here?
            along = common_prefix(old[start + shift :], new[start:])
            if along >= size:
                o, size = start + shift + back, along
        if size >= LEAST:
            out.append((o - back, start, size))
            done, shift = start + size, o - back - start
            k = int(np.searchsorted(at, done))
        else:
            k += 1
    return out


def best_reach(same: np.ndarray) -> int:
    """How far a copy may go over differing bytes: the last length that ends on an equal byte with the most of 2 * equal - length, if that is not negative."""
    if not len(same):
        return 0
    length = np.arange(1, len(same) + 1)
    score = np.where(same, 2 * np.cumsum(same) - length, -1)
    best = int(score.max())
    return len(score) - int(score[::-1].argmax()) if best >= 0 else 0


def best_split(forward: np.ndarray, backward: np.ndarray) -> int:
    """Bytes of an overlap that go to the copy before: the first split with the most equal bytes."""
    gain = np.concatenate(([0], np.cumsum(forward.astype(int) - backward.astype(int))))
    return int(gain.argmax())


def segments(old: bytes, new: bytes, addblk: bool = False) -> list[tuple[int, int, int, int]]:
    """``(old_off, old_len, new_off, new_len)``: copy that part of old, then insert that part of new."""
    a, b = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    copies = [list(c) for c in exact_matches(a, b)]
    if addblk:
        copies = _reach_out(a, b, copies)
    out: list[tuple[int, int, int, int]] = []
    if not copies or copies[0][1] > 0:
        out.append((0, 0, 0, copies[0][1] if copies else len(b)))
    for k, (o, n, size) in enumerate(copies):
        end = n + size
        out.append((o, size, end, (copies[k + 1][1] if k + 1 < len(copies) else len(b)) - end))
    return [s for s in out if s[1] or s[3]]


def _reach_out(a: np.ndarray, b: np.ndarray, exact: list[list[int]]) -> list[list[int]]:
    """Copies extended into the gaps between them."""
    copies = [[0, 0, 0], *exact] if not exact or exact[0][1] else list(exact)
    for k, (o, n, size) in enumerate(copies):
        end, old_end = n + size, o + size
        following = copies[k + 1] if k + 1 < len(copies) else None
        gap = (following[1] if following else len(b)) - end
        if gap <= 0:
            continue
        room = min(gap, len(a) - old_end)
        ahead = a[old_end : old_end + room] == b[end : end + room]
        forward = best_reach(ahead)
        backward = 0
        if following:
            room = min(gap, following[0])
            behind = (a[following[0] - room : following[0]] == b[following[1] - room : following[1]])[::-1]
            backward = best_reach(behind)
            over = forward + backward - gap
            if over > 0:
                shared = slice(gap - backward, forward)
                keep = best_split(ahead[shared], behind[::-1][len(behind) - backward :][:over])
                forward, backward = forward - over + keep, backward - keep
            following[0] -= backward
            following[1] -= backward
            following[2] += backward
        copies[k][2] += forward
    return [c for c in copies if c[2]]


def difference(old: bytes, new: bytes, found: list[tuple[int, int, int, int]]) -> bytes:
    """The add block: new minus old, byte by byte modulo 256, for all copied bytes."""
    a, b = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    out, at = [], 0
    for o, size, n, inserted in found:
        out.append(b[at : at + size] - a[o : o + size])
        at = n + inserted if inserted else at + size
    return b"".join(x.tobytes() for x in out)


def diff_pairs(pairs: DataFrame, addblk: bool = False) -> DataFrame:
    """``(pair_id, segments, literals, added)`` of ``(pair_id, old, new)``, binary cells; a null side is empty.

    One task diffs whole pairs; nothing is shuffled.  ``copies`` counts the copies
    up to and with a segment.
    """
    kind = pairs.schema["pair_id"].dataType.simpleString()
    fields = ("old_off", "old_len", "new_off", "new_len", "copies")
    item = pa.list_(pa.struct([(f, pa.int64()) for f in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1, 2):
                rows, literals, added = [], [], []
                for old, new in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    old, new = old or b"", new or b""
                    found = segments(old, new, addblk)
                    copies = np.cumsum([s[1] > 0 for s in found]).tolist()
                    rows.append([dict(zip(fields, (*s, c), strict=True)) for s, c in zip(found, copies, strict=True)])
                    literals.append(b"".join(new[n : n + size] for _, _, n, size in found))
                    added.append(difference(old, new, found) if addblk else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, item), pa.array(literals, pa.binary()), pa.array(added, pa.binary())], names=["pair_id", "segments", "literals", "added"])

    binary = pairs.select("pair_id", F.col("old").cast("binary").alias("old"), F.col("new").cast("binary").alias("new"))
    return binary.mapInArrow(run, f"pair_id {kind}, segments {SEGMENT}, literals binary, added binary")


def hit_rows(pairs: DataFrame) -> DataFrame:
    """``(pair_id, new_off, old_off)``: every place of new whose 16 bytes are an aligned block of old, and that block's first offset."""
    kind = pairs.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1, 2, most_bytes=1 << 20):
                found = [block_hits(np.frombuffer(a or b"", np.uint8), np.frombuffer(b or b"", np.uint8)) for a, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                owner = np.repeat(np.arange(len(found)), [len(at) for at, _ in found])
                at, offset = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(at), pa.array(offset)], names=["pair_id", "new_off", "old_off"])

    binary = pairs.select("pair_id", F.col("old").cast("binary").alias("old"), F.col("new").cast("binary").alias("new"))
    return binary.mapInArrow(run, f"pair_id {kind}, new_off long, old_off long")


def prefix_lengths(pairs: DataFrame) -> DataFrame:
    """``(pair_id, length)``: the longest common prefix of old and new in bytes."""
    kind = pairs.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            lengths = [common_prefix(np.frombuffer(a or b"", np.uint8), np.frombuffer(b or b"", np.uint8)) for a, b in sides]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["pair_id", "length"])

    return pairs.select("pair_id", F.col("old").cast("binary"), F.col("new").cast("binary")).mapInArrow(run, f"pair_id {kind}, length long")


def difference_histogram(pairs: DataFrame) -> DataFrame:
    """``(difference, n)``: how often new minus old modulo 256 takes each value, over the bytes that both have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for old, new in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = min(len(old or b""), len(new or b""))
                if n:
                    total += np.bincount(np.frombuffer(new, np.uint8, n) - np.frombuffer(old, np.uint8, n), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total)], names=["difference", "n"])

    parts = pairs.select(F.col("old").cast("binary"), F.col("new").cast("binary")).mapInArrow(run, "difference int, n long")
    return parts.groupBy("difference").agg(F.sum("n").alias("n")).where("n > 0")


def suffix_order(data: bytes) -> np.ndarray:
    """Order of all suffixes by prefix doubling."""
    rank = np.frombuffer(data, np.uint8).astype(np.int64)
    n, step = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while n and step < 2 * n:
        after = np.full(n, -1)
        after[: max(0, n - step)] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.concatenate(([0], np.cumsum((rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1]))))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


def longest_match(old: bytes, order: np.ndarray, wanted: bytes) -> tuple[int, int]:
    """Offset and length of the longest prefix of ``wanted`` in ``old``, by search in its suffix order."""
    lo, hi = 0, len(order)
    while lo < hi:
        mid = (lo + hi) // 2
        if old[order[mid] : order[mid] + len(wanted)] < wanted:
            lo = mid + 1
        else:
            hi = mid
    a, b = np.frombuffer(old, np.uint8), np.frombuffer(wanted, np.uint8)
    near = [(common_prefix(a[order[i] :], b), -int(order[i])) for i in (lo - 1, lo) if 0 <= i < len(order)]
    length, offset = max(near, default=(0, 0))
    return -offset, length
