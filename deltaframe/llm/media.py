"""Cropped and edited copies of images by local descriptors.

An image is a PNG or binary PGM/PPM cell.  Corners are found by their structure
tensor at several scales; around each a patch is turned to its own orientation and
read by binary intensity tests, 96 bits in three words.  All corners are searched, so that
a small part of a large image is found as well.  Three of the twelve bytes at a time are joined as
24 Hamming tables: descriptors that differ in at most three bits agree in one of them, and most
that differ in some more.  The queries' descriptors lie in blocks in the shared folder; a task holds
whole images against a block after the other, so that descriptors that agree by chance are never rows.
Matches of a query and an image count if enough of them agree on one rotation,
scale and shift.

Equal images are one class, known by its least key; only one image of a class is
indexed, so that many copies cost no more than one.

Cases: null or undecodable images have no corners and match nothing (a null has
no class); images without corners are found by their class only; equal rows each
give a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, open_read, open_write, scratch_path, slices, tidied

#: Strongest corners that describe() gives unless told otherwise.
CORNERS = 32
#: Image sizes relative to the original.
SCALES = (1, 2)
RADIUS = 9
BITS = 96
#: Bytes of a descriptor that a table joins, each turned twelve times.
TABLES = ((0, 1, 2), (0, 2, 7))
#: Most bits in which a match may differ, least matches that agree, and how closely (pixels, degrees).
MOST_BITS = 18
LEAST_INLIERS = 4
SLACK = 5.0
TURN = 20.0
#: Classes whose digests and ids, some 100 bytes each, may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Descriptors of queries in a block, of images held against a block at once, and pairs of them looked at together.
BLOCK_CORNERS = 1 << 17
HELD_CORNERS = 1 << 18
PAIRS_AT_ONCE = 1 << 21
_ANGLES = 36
_PNG = b"\x89PNG\r\n\x1a\n"


# -- images -----------------------------------------------------------------------------------------


def encode_png(grey: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    h, w = grey.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.zeros((h, w + 1), np.uint8)
    rows[:, 1:] = grey
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey values of a PNG (8 bits, not interlaced) or a binary PGM or PPM; None for anything else."""
    try:
        if raw and raw.startswith(_PNG):
            return _decode_png(raw)
        if raw and raw[:2] in (b"P5", b"P6"):
            parts = raw.split(None, 4)
            w, h, top = int(parts[1]), int(parts[2]), int(parts[3])
            channels = 1 if raw[:2] == b"P5" else 3
            if top > 255 or w < 1 or h < 1:
                return None
            return _grey(np.frombuffer(raw[len(raw) - w * h * channels :], np.uint8).reshape(h, w, channels))
    except (ValueError, IndexError, KeyError, zlib.error, struct.error):
        pass
    return None


def _grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] < 3:
        return np.ascontiguousarray(pixels[:, :, 0])
    return np.round(pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _decode_png(raw: bytes) -> np.ndarray | None:
    at, body, head = 8, b"", (0, 0, 0, 0, 0, 0, 0)
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        part = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR" and len(part) == 13:
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    w, h, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 8 or interlaced or w < 1 or h < 1:
        return None
    size = h * (w * channels + 1)  # what is packed beyond that is not unpacked
    rows = np.frombuffer(zlib.decompressobj().decompress(body, size), np.uint8).reshape(h, w * channels + 1)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.uint8)
    for y in range(h):
        out[y] = above = _unfilter(int(rows[y, 0]), rows[y, 1:], above, channels)
    return _grey(out.reshape(h, w, channels))


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out = np.zeros(len(line), np.uint8)
    for i in range(len(line)):
        a, c = (int(out[i - step]), int(above[i - step])) if i >= step else (0, 0)
        b = int(above[i])
        if kind == 3:
            guess = (a + b) // 2
        elif kind == 4:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        else:
            raise ValueError("unknown filter")
        out[i] = (int(line[i]) + guess) & 255
    return out


# -- corners and descriptors -------------------------------------------------------------------------


def _box(x: np.ndarray, reach: int) -> np.ndarray:
    """Sums over squares of side 2 * reach + 1, zero beyond the border."""
    n = 2 * reach + 1
    padded = np.pad(x, ((reach + 1, reach), (reach + 1, reach)))
    total = padded.cumsum(0).cumsum(1)
    return total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]


def _tests() -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the compared pixels for each angle, drawn once by a fixed generator."""
    rng = np.random.default_rng(20240)
    points = np.clip(rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS + 2, RADIUS - 2)
    points /= np.maximum(1, np.hypot(points[..., 0], points[..., 1]) / (RADIUS - 1))[..., None]
    out = []
    for k in range(_ANGLES):
        a = 2 * np.pi * k / _ANGLES
        turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        out.append(np.round(points @ turn.T).astype(int))
    offsets = np.array(out)
    return offsets[:, :, 0], offsets[:, :, 1]


_FIRST, _SECOND = _tests()
_DY, _DX = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_DX**2 + _DY**2 <= RADIUS**2).astype(float)


def describe(grey: np.ndarray | None, most: int | None = CORNERS) -> list[tuple[float, float, float, float, int, int, int]]:
    """``(x, y, angle in degrees, scale, word 0, word 1, word 2)`` of the strongest corners, or of all with ``most`` None, in pixels of the image."""
    if grey is None or min(grey.shape) <= 2 * RADIUS + 2:
        return []
    found = []
    image = grey.astype(float)
    for scale in SCALES:
        h, w = image.shape[0] // scale, image.shape[1] // scale
        if min(h, w) <= 2 * RADIUS + 2:
            continue
        level = image[: h * scale, : w * scale].reshape(h, scale, w, scale).mean((1, 3))
        gy, gx = np.gradient(level)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = strength[RADIUS + 1 : -RADIUS - 1, RADIUS + 1 : -RADIUS - 1]
        if not inner.size:
            continue
        around = np.lib.stride_tricks.sliding_window_view(strength, (5, 5))[RADIUS - 1 : RADIUS - 1 + inner.shape[0], RADIUS - 1 : RADIUS - 1 + inner.shape[1]]
        y, x = np.nonzero((inner >= around.max((2, 3))) & (inner > 1e-3))
        found.append((inner[y, x], y + RADIUS + 1, x + RADIUS + 1, scale, level))
    # strengths fall with the fourth power of contrast: rank within an image only
    ranked = sorted(((-s, scale, y, x) for ss, ys, xs, scale, _ in found for s, y, x in zip(ss.tolist(), ys.tolist(), xs.tolist(), strict=True)))[:most]
    out = []
    for _, _, _, scale, level in found:
        mine = np.array([(y, x) for _, s, y, x in ranked if s == scale], int).reshape(-1, 2)
        smooth = _box(level, 1)
        middle = (scale - 1) / 2
        for at in range(0, len(mine), 4096):
            out += _read_patches(level, smooth, *mine[at : at + 4096].T, scale, middle)
    return out


def _read_patches(level: np.ndarray, smooth: np.ndarray, ys: np.ndarray, xs: np.ndarray, scale: int, middle: float) -> list[tuple[float, float, float, float, int, int, int]]:
    patch = np.lib.stride_tricks.sliding_window_view(level, (2 * RADIUS + 1, 2 * RADIUS + 1))[ys - RADIUS, xs - RADIUS] * _DISC
    angle = np.arctan2((patch * _DY).sum((1, 2)), (patch * _DX).sum((1, 2)))
    k = np.round(angle / (2 * np.pi) * _ANGLES).astype(int) % _ANGLES
    first = smooth[ys[:, None] + _FIRST[k][..., 1], xs[:, None] + _FIRST[k][..., 0]]
    second = smooth[ys[:, None] + _SECOND[k][..., 1], xs[:, None] + _SECOND[k][..., 0]]
    words = np.packbits(first < second, axis=1).view(">u4").astype(np.int64)
    return [(float(xs[i] * scale + middle), float(ys[i] * scale + middle), float(np.degrees(angle[i])), float(scale), *words[i].tolist()) for i in range(len(ys))]


def consensus(matches: np.ndarray) -> tuple[int, float, float, float, float]:
    """Largest set of matches under one similarity: (inliers, degrees, scale, shift x, shift y).

    Columns: x, y, angle and scale in the query, then in the image.  Each match
    proposes a transform; those that map their corner nearby, with a like turn and
    scale, agree.  A corner counts once on either side.
    """
    qx, qy, qa, qs, ix, iy, ia, i_s = matches.T
    turn, grow = np.radians(ia - qa), i_s / qs
    best = (0, 0.0, 1.0, 0.0, 0.0)
    for k in range(len(matches)):
        c, s = np.cos(turn[k]) * grow[k], np.sin(turn[k]) * grow[k]
        x, y = c * (qx - qx[k]) - s * (qy - qy[k]) + ix[k], s * (qx - qx[k]) + c * (qy - qy[k]) + iy[k]
        # the angle of a corner is not exact: allow for it in proportion to the distance
        far = np.hypot(qx - qx[k], qy - qy[k]) * grow[k]
        near = np.hypot(x - ix, y - iy) <= SLACK + 0.12 * far
        near &= (np.abs((np.degrees(turn - turn[k]) + 180) % 360 - 180) <= TURN) & (np.abs(np.log2(grow / grow[k])) < 0.6)
        n = min(len(set(zip(qx[near], qy[near], strict=True))), len(set(zip(ix[near], iy[near], strict=True))))
        if n > best[0]:
            best = n, float(np.degrees(turn[k]) % 360), float(grow[k]), float(ix[k] - c * qx[k] + s * qy[k]), float(iy[k] - s * qx[k] - c * qy[k])
    return best


# -- tables ---------------------------------------------------------------------------------------------

_CORNER = ("x", "y", "angle", "scale", "w0", "w1", "w2")
_CORNER_TYPES = (pa.float32(), pa.float32(), pa.float32(), pa.float32(), pa.int64(), pa.int64(), pa.int64())


def corners(df: DataFrame, key: str, image: str) -> DataFrame:
    """``(key, x, y, angle, scale, w0, w1, w2)``: the corners of each image as arrays.  No shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4 << 20, 256):
                rows = [describe(decode(x), None) for x in part.column(1).to_pylist()]
                ends = pa.array(np.cumsum([0, *(len(r) for r in rows)]), pa.int32())
                flat = [r for rs in rows for r in rs]
                columns = [pa.ListArray.from_arrays(ends, pa.array([r[i] for r in flat], t)) for i, t in enumerate(_CORNER_TYPES)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["key", *_CORNER])

    arrays = ", ".join(f"{c} array<{'long' if c[0] == 'w' else 'float'}>" for c in _CORNER)
    return df.select(F.col(key).alias("key"), F.col(image).alias("image")).mapInArrow(tidied(run), f"key {kind}, {arrays}")


def classes(df: DataFrame, key: str, image: str) -> DataFrame:
    """``(digest, class_id, members)``: equal images, known by their least key."""
    return df.where(F.col(image).isNotNull()).select(F.col(key).alias("key"), F.sha2(image, 256).alias("digest")).groupBy("digest").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("members"))


def table_entries(words: np.ndarray) -> np.ndarray:
    """The entry in each table of descriptors of three words: the table's number, then three bytes."""
    octets = words.astype(">u4").view(np.uint8).reshape(len(words), BITS // 8).astype(np.int64)
    entries = [[octets[:, (t + i) % 12] for i in three] for three in TABLES for t in range(12)]
    return np.stack([number << 24 | a << 16 | b << 8 | c for number, (a, b, c) in enumerate(entries)], 1)


class Corners:
    """The corners of some images, and the number of its image for each."""

    def __init__(self, batch: pa.RecordBatch | pa.Table) -> None:
        batch = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
        lists = {c: batch.column(c).combine_chunks() for c in _CORNER}
        flat = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
        self.owner = np.repeat(np.arange(batch.num_rows), lists["x"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        self.place = np.stack([flat[c] for c in _CORNER[:4]], 1)
        self.words = np.stack([flat[c] for c in _CORNER[4:]], 1)
        self.entries = table_entries(self.words).T


class Asked:
    """A block of queries: their keys, their corners, and for each table its entries in order."""

    def __init__(self, rows: pa.Table) -> None:
        self.corners = Corners(rows)
        named = rows.column("key").combine_chunks().dictionary_encode()
        self.keys = named.dictionary  # rows of one key are one query; those without one, too
        self.query = named.indices.fill_null(len(self.keys)).to_numpy(zero_copy_only=False)[self.corners.owner].astype(np.int64)
        self.order = [np.argsort(e, kind="stable") for e in self.corners.entries]
        self.sorted = [e[o] for e, o in zip(self.corners.entries, self.order, strict=True)]

    def matches(self, images: Corners, most_bits: int) -> np.ndarray:
        """Pairs of corners, the query's times the number of the images' plus the image's, that agree in a table and differ in few bits."""
        n, found = max(1, len(images.owner)), []
        for own, order, entries in zip(images.entries, self.order, self.sorted, strict=True):
            low = np.searchsorted(entries, own)
            some = np.flatnonzero(entries[np.minimum(low, len(entries) - 1)] == own) if len(entries) else low[:0]
            low = low[some]
            many = np.searchsorted(entries, own[some], side="right") - low
            upto, start = np.cumsum(many), 0
            while start < len(some):
                stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS_AT_ONCE, side="right")))
                k = many[start:stop]
                i = np.repeat(some[start:stop], k)
                q = order[np.repeat(low[start:stop] - np.cumsum(k) + k, k) + np.arange(len(i))]
                near = np.bitwise_count(self.corners.words[q] ^ images.words[i]).sum(1) <= most_bits
                found.append(q[near] * n + i[near])
                start = stop
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def agreeing(self, images: Corners, least: int, most_bits: int) -> Iterator[tuple[int, int, tuple[int, float, float, float, float]]]:
        """Number of the query and of the image, and their consensus, of those with enough matches that agree."""
        q, i = np.divmod(self.matches(images, most_bits), max(1, len(images.owner)))
        both = self.query[q] * (len(images.owner) + 1) + images.owner[i]
        order = np.argsort(both, kind="stable")
        cuts = np.flatnonzero(np.diff(both[order], prepend=-1))
        ends = np.append(cuts[1:], len(order))[: len(cuts)]
        large = ends - cuts >= least
        for a, b in zip(cuts[large].tolist(), ends[large].tolist(), strict=True):
            some = order[a:b]
            matches = np.unique(np.concatenate((self.corners.place[q[some]], images.place[i[some]]), 1).astype(np.float64), axis=0)
            if len(matches) >= least and (best := consensus(matches))[0] >= least:
                yield int(self.query[q[some[0]]]), int(images.owner[i[some[0]]]), best


def query_blocks(queries: DataFrame, block_corners: int = BLOCK_CORNERS) -> list[str]:
    """Files in the shared folder that hold all queries with corners, whole ones in each."""
    asked = queries.where(F.size("x") > 0)
    n = max(1, -(-(asked.agg(F.sum(F.size("x"))).first()[0] or 0) // block_corners))
    folder = scratch_path(queries.sparkSession, "media-asked")

    def write(rows: pa.Table) -> pa.Table:
        path = f"{folder}/block-{uuid.uuid4().hex}.parquet"
        with open_write(path) as out:
            pq.write_table(rows.select(["key", *_CORNER]), out)
        return pa.table({"path": [path]})

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n)))
    # written once: a task that is run again leaves a file that is not listed
    return sorted(r.path for r in materialise(dealt.groupBy("block").applyInArrow(write, "path string"), "media-blocks").collect())


def search(queries: DataFrame, found: DataFrame, least: int = LEAST_INLIERS, most_bits: int = MOST_BITS, block_corners: int = BLOCK_CORNERS) -> DataFrame:
    """Images that hold what a query shows, both given by their corners: query_id, class_id, inliers, degrees, scale, shift_x, shift_y.  The images are not dealt."""
    paths = query_blocks(queries, block_corners)
    names = ["query_id", "class_id", "inliers", "degrees", "scale", "shift_x", "shift_y"]
    kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64())

    def through(held: list[pa.RecordBatch], kept: list[Asked]) -> Iterator[pa.RecordBatch]:
        images = pa.Table.from_batches(held)
        seen, keys = Corners(images), images.column("key")
        for path in paths:
            if not kept or len(paths) > 1:
                with open_read(path) as f:
                    kept[:] = [Asked(pq.read_table(pa.py_buffer(f.read())))]
            rows = list(kept[0].agreeing(seen, least, most_bits))
            asked = kept[0].keys.take(pa.array([None if q == len(kept[0].keys) else q for q, _, _ in rows], pa.int64()))
            owner = keys.take(pa.array([i for _, i, _ in rows], pa.int64())).combine_chunks()
            yield pa.RecordBatch.from_arrays([asked, owner, *(pa.array([r[2][k] for r in rows], t) for k, t in enumerate(kinds))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        kept: list[Asked] = []
        size = 0
        for batch in batches:
            ends = np.cumsum(batch.column("x").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + HELD_CORNERS - size, side="right")))
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                start = stop
                if size >= HELD_CORNERS or start < batch.num_rows:
                    yield from through(held, kept)
                    held, size = [], 0
        if held:
            yield from through(held, kept)

    kind = queries.schema["key"].dataType.simpleString(), found.schema["key"].dataType.simpleString()
    rows = found.mapInArrow(tidied(run), f"query_id {kind[0]}, class_id {kind[1]}, inliers int, degrees double, scale double, shift_x double, shift_y double")
    # an image that is there twice, or another of the same key
    best = rows.groupBy("query_id", "class_id").agg(F.max(F.struct(*names[2:])).alias("best"))
    return best.select("query_id", "class_id", "best.*")


def find_copies(images: DataFrame, queries: DataFrame, key: str, image: str) -> DataFrame:
    """Every row's class, and for each query the classes whose image it was cut or edited from.

    Rows: ``kind`` "member" (key, class_id, members) or "match" (key of the query,
    class_id, members and the transform from the query to the class's image).
    """
    named = materialise(classes(images, key, image), "media-classes")
    members = images.select(F.col(key).alias("id"), F.sha2(image, 256).alias("digest")).join(named, "digest", "left")
    # rows that repeat the image of least key give the same corners again, which count once
    least = named.select("digest", "class_id")
    least = F.broadcast(least) if least.count() <= BROADCAST_ROWS else least
    one = images.select(F.col(key).alias("class_id"), F.col(image).alias("image"), F.sha2(image, 256).alias("digest")).join(least, ["digest", "class_id"], "left_semi")
    index = materialise(corners(one, "class_id", "image"), "media-index")
    asked = materialise(corners(queries, key, image), "media-queries")
    matched = search(asked, index).join(named.select("class_id", "members"), "class_id")
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("inliers", "int"), ("degrees", "double"), ("scale", "double"), ("shift_x", "double"), ("shift_y", "double"))]
    left = members.select(F.lit("member").alias("kind"), F.col("id").alias(key), "class_id", "members", *blank)
    right = matched.select(F.lit("match").alias("kind"), F.col("query_id").alias(key), "class_id", "members", "inliers", "degrees", "scale", "shift_x", "shift_y")
    return left.unionByName(right)


# -- the test tables hold no images: they are drawn from vectors ------------------------------------------

SIDE = 80
CROP = 60


def draw(vector: list[float] | None) -> np.ndarray:
    """A grey image of a vector: its values as a coarse grid under a texture that its bytes seed."""
    values = np.nan_to_num(np.array([0.0 if v is None else v for v in vector or [0.0]], "<f4"))
    rng = np.random.default_rng(zlib.crc32(values.tobytes()))
    side = int(np.ceil(np.sqrt(len(values))))
    grid = np.resize(values, (side, side))
    at = np.arange(SIDE) * side // SIDE
    coarse = grid[at][:, at]
    spread = float(np.ptp(coarse)) or 1.0
    noise = _box(rng.normal(size=(SIDE, SIDE)), 1)
    mixed = 110 + 20 * (coarse - coarse.min()) / spread + 55 * noise / (np.abs(noise).max() or 1)
    return np.clip(mixed, 0, 255).astype(np.uint8)


def edit(grey: np.ndarray, number: int) -> np.ndarray:
    """A crop of the image, turned by a quarter for every other number, with other contrast and brightness."""
    rng = np.random.default_rng(number & 0xFFFFFFFF)
    y, x = rng.integers(0, SIDE - CROP + 1, 2)
    out = np.rot90(grey[y : y + CROP, x : x + CROP], number // 20 % 2)
    return np.clip(out * rng.uniform(0.75, 1.1) + rng.uniform(-15, 25), 0, 255).astype(np.uint8)


def drawn(vectors: DataFrame, edited: bool = False) -> DataFrame:
    """``(vec_id, image binary)``: PNG images of the vectors; ``edited`` gives the copies that are searched for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, vectors_ = part.column(0).to_pylist(), part.column(1).to_pylist()
                cells = [encode_png(edit(draw(v), i) if edited else draw(v)) for i, v in zip(ids, vectors_, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells, pa.binary())], names=["vec_id", "image"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, "vec_id long, image binary")


def vector_images(vectors: DataFrame) -> DataFrame:
    """All of ``embeddings`` as images; edited copies of those whose id is divisible by 20 searched among all."""
    queries = vectors.where(F.col("vec_id").isNotNull() & (F.col("vec_id") % 20 == 0))
    return find_copies(drawn(vectors), drawn(queries, edited=True), "vec_id", "image")
