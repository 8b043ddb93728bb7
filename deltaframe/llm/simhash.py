"""Near-duplicate documents by SimHash fingerprints and vantage-point trees.

Fingerprints that differ in at most ``RADIUS`` bits are linked; documents are in
one component if links lead from one to the other.  Distinct fingerprints are
dealt to shards, the leaves of a vantage-point tree built from a bounded sample:
each has one home leaf and is also sent as a query to every leaf that a triangle
bound cannot rule out.  Within a shard a local tree is walked for all queries at
once.  A shard returns a spanning forest of its links instead of all pairs, so a
group of copies costs a row per member.

Cases: a null or empty text has fingerprint zero, linked like any other; equal
rows each give a row; a null doc_id is never a component's id unless all ids of
the component are null; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialise, slices, tidied

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints from which the tree over shards is built on the driver.
SAMPLE = 8192
#: Fingerprints at home in one shard, about, and bounds of the number of shards.
SHARD = 32_768
SHARDS = (48, 8192)
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(raw: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``width`` words of a text, repeats included; of all words where there are fewer."""
    words = raw.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[bytes | None], width: int = SHINGLE) -> np.ndarray:
    """A 64-bit fingerprint per text: the bits set in over half of its hashes (uint64)."""
    return majorities([np.array(shingle_hashes(t, width) if t else [], np.uint64) for t in texts])


def majorities(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array of hashes the bits set in over half of them (uint64)."""
    out = np.zeros(len(hashes), np.uint64)
    counts = np.array([len(h) for h in hashes])
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    flat = np.concatenate(hashes)
    # runs of at most 255 hashes: eight counters of a byte fit into a word
    starts, run_of = [], []
    at = 0
    for k, i in enumerate(full.tolist()):
        for a in range(0, int(counts[i]), 255):
            starts.append(at + a)
            run_of.append(k)
        at += int(counts[i])
    first = np.flatnonzero(np.diff(run_of, prepend=-1))
    for shift in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(shift)) & _LANES, starts)
        per_run = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(per_run, first, axis=0)
        most = 2 * total > counts[full][:, None]
        for byte in range(8):
            out[full[most[:, byte]]] |= np.uint64(1 << (8 * byte + shift))
    return out


def fingerprint_rows(df: DataFrame, key: str, text: str, width: int = SHINGLE) -> DataFrame:
    """``(key, fp long)``: the fingerprint of each row as a signed long.  No shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                prints = fingerprints(part.column(1).to_pylist(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], names=["key", "fp"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(tidied(run), f"key {kind}, fp long").withColumnRenamed("key", key)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


# -- the tree over shards -------------------------------------------------------------------


@dataclass
class Router:
    """A vantage-point tree as arrays: node i goes to ``inside[i]`` up to ``bound[i]`` from ``point[i]``, else to ``outside[i]``; a leaf ~k is shard k."""

    point: list[int] = field(default_factory=list)
    bound: list[int] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)
    outside: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)  # by leaf: the blocks its own fingerprints are dealt to
    root: int = -1

    def home(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root)
        if not self.point:
            return ~at
        point, bound = np.array(self.point, np.uint64), np.array(self.bound)
        inside, outside = np.array(self.inside), np.array(self.outside)
        while len(open_ := np.flatnonzero(at >= 0)):
            n = at[open_]
            at[open_] = np.where(distance(points[open_], point[n]) <= bound[n], inside[n], outside[n])
        return ~at

    def reached(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in points, leaf) of all leaves that may hold a point within the radius."""
        done: list[tuple[np.ndarray, int]] = []
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, which = todo.pop()
            if not len(which):
                continue
            if node < 0:
                done.append((which, ~node))
                continue
            d = distance(points[which], np.uint64(self.point[node])).astype(np.int64)
            todo.append((self.inside[node], which[d <= self.bound[node] + radius]))
            todo.append((self.outside[node], which[d > self.bound[node] - radius]))
        return np.concatenate([w for w, _ in done]), np.concatenate([np.full(len(w), k) for w, k in done])


def build_router(sample: np.ndarray, shards: int) -> Router:
    """Split the sample until a leaf holds its share; a leaf that no distance splits is dealt to blocks."""
    router = Router()
    most = max(1, len(sample) // shards)
    rng = np.random.default_rng(7)

    def grow(points: np.ndarray, depth: int) -> int:
        best = None
        if len(points) > most and depth < 40:
            for v in points[rng.integers(0, len(points), 8)]:
                d = distance(points, v).astype(np.int64)
                mu = int(np.median(d))
                mu = mu if (d > mu).any() else mu - 1
                # few fingerprints near the bound: fewer are sent to both sides
                score = (np.abs(d - mu - 0.5) < RADIUS).mean() + abs((d <= mu).mean() - 0.5)
                if (d <= mu).any() and (best is None or score < best[0]):
                    best = score, v, mu, d
        if best is None:
            router.blocks.append(max(1, -(-len(points) // (2 * most))))
            return ~(len(router.blocks) - 1)
        _, v, mu, d = best
        node = len(router.point)
        router.point.append(int(v))
        router.bound.append(mu)
        router.inside.append(0)
        router.outside.append(0)
        router.inside[node] = grow(points[d <= mu], depth + 1)
        router.outside[node] = grow(points[d > mu], depth + 1)
        return node

    router.root = grow(sample, 0)
    return router


def route(prints: DataFrame, router: Router, radius: int) -> DataFrame:
    """``(shard long, fp long, home boolean)``: home rows are searched, all rows of a shard are queries."""
    blocks = np.array(router.blocks, np.int64)
    first = np.concatenate(([0], np.cumsum(blocks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 15):
                points = batch.column(0).slice(at, 1 << 15).to_numpy(zero_copy_only=False).view(np.uint64)
                home = router.home(points)
                block = ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
                which, leaf = router.reached(points, radius)
                copies = blocks[leaf]
                which, leaf = np.repeat(which, copies), np.repeat(leaf, copies)
                inner = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
                mine = (home[which] == leaf) & (block[which] % blocks[leaf] == inner)
                yield pa.RecordBatch.from_arrays([pa.array(first[leaf] + inner), pa.array(points[which].view(np.int64)), pa.array(mine)], names=["shard", "fp", "home"])

    return prints.select("fp").mapInArrow(tidied(run), "shard long, fp long, home boolean")


# -- within a shard ---------------------------------------------------------------------------


class Forest:
    """Components of points 0..n-1 by links that come in arrays."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, low, high = a[apart], b[apart], np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(self.parent, high, low)


def shard_forest(points: np.ndarray, home: np.ndarray, radius: int, cell: int = 1 << 18) -> np.ndarray:
    """Component label of each of the shard's distinct points, by links with at least one end at home.

    The local tree is walked for all queries at once: a node splits its home
    points at the median distance from one of them and sends queries to a side
    unless the triangle bound rules it out.  Points within the radius of that
    point are linked through it, so pairs among them are not looked at.
    """
    forest = Forest(len(points))
    rng = np.random.default_rng(11)
    todo = [(np.flatnonzero(home), np.arange(len(points)))]
    while todo:
        own, asks = todo.pop()
        if not len(own) or not len(asks):
            continue
        if len(own) * len(asks) <= cell or len(own) <= 24:
            rows = max(1, cell // len(own))
            for at in range(0, len(asks), rows):
                some = asks[at : at + rows]
                q, i = np.nonzero(distance(points[some][:, None], points[own][None, :]) <= radius)
                forest.link(some[q], own[i])
            continue
        v = own[rng.integers(0, len(own))]
        d_own, d_asks = (distance(points[x], points[v]).astype(np.int64) for x in (own, asks))
        near_own, near_asks = own[d_own <= radius], asks[d_asks <= radius]
        forest.link(near_own, np.full(len(near_own), v))
        forest.link(near_asks, np.full(len(near_asks), v))
        if len(near_own) > 1:
            todo.append((near_own[near_own != v], asks[(d_asks > radius) & (d_asks <= 2 * radius)]))
        rest = d_own > radius
        own, d_own = own[rest], d_own[rest]
        if not len(own):
            continue
        mu = int(np.median(d_own))
        mu = mu if (d_own > mu).any() else mu - 1
        todo.append((own[d_own <= mu], asks[d_asks <= mu + radius]))
        todo.append((own[d_own > mu], asks[d_asks > mu - radius]))
    return forest.roots()


def links(routed: DataFrame, radius: int) -> DataFrame:
    """``(u, v)``: a spanning forest of each shard's links, as fingerprints."""

    def run(rows: pa.Table) -> pa.Table:
        prints = rows.column("fp").to_numpy().view(np.uint64)
        points, place = np.unique(prints, return_inverse=True)
        home = np.zeros(len(points), bool)
        home[place[rows.column("home").to_numpy(zero_copy_only=False).astype(bool)]] = True
        root = shard_forest(points, home, radius)
        linked = np.flatnonzero(root != np.arange(len(points)))
        signed = points.view(np.int64)
        return pa.table({"u": signed[linked], "v": signed[root[linked]]})

    return routed.groupBy("shard").applyInArrow(run, "u long, v long")


def linked_prints(distinct: DataFrame, name: str, radius: int = RADIUS) -> DataFrame:
    """``(u, v)``: spanning forests of the links of distinct fingerprints, shard by shard."""
    n = distinct.count()
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toArrow().column("fp").to_numpy().view(np.uint64)
    shards = min(SHARDS[1], max(SHARDS[0], -(-n // SHARD)))
    return materialise(links(route(distinct, build_router(sample, shards), radius), radius).distinct(), f"{name}-links")


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """``(key, fp long, component_id)``: component_id is the least key reachable by links, the row's own included."""
    prints = materialise(fingerprint_rows(docs, key, text, width), "simhash-prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min(key).alias("low")), "simhash-distinct")
    linked = connected_components(linked_prints(distinct, "simhash", radius), "simhash")
    groups = distinct.join(linked, distinct.fp == linked.vertex, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    low = groups.groupBy("component").agg(F.min("low").alias("component_id"))
    labels = groups.join(low, "component").select("fp", "component_id")
    return prints.join(labels, "fp").select(key, "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``documents`` with fingerprint (hex) and component."""
    return cluster(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of least doc_id of each component, with the columns of ``documents``.

    Rows are told apart by id and text: of equal ones one stays, and of several of a component's least id that of
    least text hash; rows without an id are left as they are.
    """
    known = docs.where(F.col("doc_id").isNotNull()).select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("key"), "text")
    kept = cluster(known, "key").select(F.col("component_id").alias("key")).distinct().select("key.*")
    return _rows_of(docs, kept)


def _rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row for each ``(doc_id, hash)``, and all rows without an id."""
    named = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row")).withColumn("doc_id", F.col("row.doc_id")).withColumn("hash", F.xxhash64("row.text"))
    one = named.join(kept, ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"])
    return one.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))


# -- near copies: candidates by wider fingerprints, decided by shingle similarity ----------------

#: Bits of 128 in which texts at similarity 0.8 may differ: 19.4 on average with a deviation of 4.1 (unlike ones: 64, 5.7).
WIDE = 38
#: How many tables there are: ``_TABLES`` agree on average on texts whose bits are the same with this probability. By calculation
#: a pair at similarity 0.8 (0.85 of the bits the same) is then missed once in 19,000 with 8 bits an entry and once in 6000 with 11.
_SAME = 0.79
_TABLES = 8.5
#: Fingerprints that one entry of a table holds, about, and the least bits of an entry.
_HELD = 8192
_LEAST_BITS = 8
#: Bytes of shingle sets that a task that compares them keeps at hand.
_SETS_HELD = 64 << 20
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(raw: bytes | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(raw or b"", width), np.uint64))


def _again(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, for the second word of a fingerprint."""
    hashes = (hashes ^ hashes >> np.uint64(32)) * _MIX
    hashes = (hashes ^ hashes >> np.uint64(29)) * _MIX
    return hashes ^ hashes >> np.uint64(32)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, hash, digest, size, fp, fp2)``: a hash of the text, what names a text's set of shingles, their number, and the set's SimHash of 128 bits.  No shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                sets = [shingle_set(t, width) for t in part.column(2).to_pylist()]
                digest = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
                words = [digest, majorities(sets), majorities([_again(s) for s in sets])]
                digest, fp, fp2 = (pa.array(x.view(np.int64)) for x in words)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), digest, pa.array([len(s) for s in sets], pa.int32()), fp, fp2], names=["doc_id", "hash", "digest", "size", "fp", "fp2"])

    return docs.select("doc_id", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text")).mapInArrow(tidied(run), f"doc_id {kind}, hash long, digest long, size int, fp long, fp2 long")


def sampled_bits(n: int) -> np.ndarray:
    """For ``n`` fingerprints the bits, of 128, that each table reads: a row a table, drawn by a fixed generator.

    More fingerprints get longer entries and more tables, so that an entry's fingerprints are about as many.
    """
    bits = max(_LEAST_BITS, int(np.ceil(np.log2(max(1, n) / _HELD))))
    rng = np.random.default_rng(29)
    return np.stack([rng.permutation(128)[:bits] for _ in range(int(np.ceil(_TABLES / _SAME**bits)))])


def entries(prints: DataFrame, tables: np.ndarray) -> DataFrame:
    """``(key, digest, size, fp, fp2, own)``: a row for each fingerprint and table, ``key`` being the table's number and the bits that it reads."""
    names = ["digest", "size", "fp", "fp2", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.int64(1) << np.arange(tables.shape[1])
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                words = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "fp2")], 1)
                bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)
                keys = np.stack([bits[:, table] @ power + (k << tables.shape[1]) for k, table in enumerate(tables)], 1)
                rows = part.take(pa.array(np.repeat(np.arange(len(keys)), len(tables))))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *rows.columns], names=["key", *names])

    return prints.select(*names).mapInArrow(tidied(run), "key long, digest long, size int, fp long, fp2 long, own long")


def close_prints(prints: DataFrame, tables: np.ndarray, similarity: float, leaders: bool, cell: int = 1 << 18) -> DataFrame:
    """Pairs ``(a, b)`` of digests that share an entry, have different ``own`` and fingerprints within ``WIDE``, and sizes that allow the similarity.

    ``leaders``: only those with the entry's first digest, a row at most for each digest.  Else all pairs but those of
    the entry's most frequent ``own``.
    """

    def pairs(key: np.ndarray, digest: np.ndarray, size: np.ndarray, fp: np.ndarray, fp2: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        left, right = [], []
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if stop - start < 2:
                continue
            at = np.arange(start, stop)
            if leaders:
                at[[0, digest[at].argmin()]] = at[[digest[at].argmin(), 0]]
                first = 1
            else:
                labels, which, many = np.unique(own[at], return_inverse=True, return_counts=True)
                if len(labels) == 1:
                    continue
                apart = which != many.argmax()
                at, first = np.concatenate((at[apart], at[~apart])), int(apart.sum())
            rows = max(1, cell // len(at))
            for begin in range(0, first, rows):
                i, j = at[begin : min(first, begin + rows), None], at[None, begin:]
                near = distance(fp[i], fp[j]) + distance(fp2[i], fp2[j]) <= WIDE
                near &= (own[i] != own[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
                x, y = np.nonzero(near)
                left.append(digest[i[x, 0]])
                right.append(digest[j[0, y]])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def whole() -> Iterator[pa.RecordBatch]:
            if held:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                held.clear()
                yield from pairs(*columns[:3], columns[3].view(np.uint64), columns[4].view(np.uint64), columns[5])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cuts = np.flatnonzero(np.append(held and columns[0][0] != held[-1][0][-1], columns[0][1:] != columns[0][:-1]))
            if len(cuts):  # entries are whole up to where the last one of this batch starts
                held.append([c[: cuts[-1]] for c in columns])
                yield from whole()
                columns = [c[cuts[-1] :] for c in columns]
            held.append(columns)
        yield from whole()

    return entries(prints, tables).repartition("key").sortWithinPartitions("key").mapInArrow(tidied(run), "a long, b long").distinct()


def tree_pairs(sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of digests that the trees link: equal fingerprints, and a spanning forest of those within ``RADIUS``."""
    distinct = materialise(sets.groupBy("fp").agg(F.min("digest").alias("low")), "near-prints")
    named = lambda side: distinct.select(F.col("fp").alias(side), F.col("low").alias("a" if side == "u" else "b"))
    forest = linked_prints(distinct, "near").join(named("u"), "u").join(named("v"), "v").select("a", "b")
    return forest.unionByName(sets.select("fp", "digest").join(distinct, "fp").where("digest <> low").select(F.col("digest").alias("a"), F.col("low").alias("b")))


def alike(docs: DataFrame, sets: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links ``(u, v)`` of digests whose shingle sets are similar enough, compared as they are: a spanning forest of each task's pairs."""
    pairs = materialise(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "near-pairs")
    wanted = pairs.select(F.col("u").alias("digest")).unionByName(pairs.select(F.col("v").alias("digest"))).distinct()
    holders = sets.join(wanted, "digest", "left_semi").select("digest", F.col("low").alias("doc_id"), F.col("hash").alias("t"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text")).join(holders, ["doc_id", "t"])
    texts = materialise(texts.select("digest", "text").dropDuplicates(["digest"]), "near-texts")
    both = pairs.join(texts.select(F.col("digest").alias("u"), F.col("text").alias("left")), "u").join(texts.select(F.col("digest").alias("v"), F.col("text").alias("right")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        held = 0
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = x = above.get(up, up)
            return x

        for batch in batches:
            keep = []
            for k, ends in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                roots = [root(x) for x in ends]
                if roots[0] == roots[1]:  # linked through others that this task has compared
                    keep.append(False)
                    continue
                for x, side in zip(ends, (2, 3), strict=True):
                    if x not in made:
                        made[x] = shingle_set(batch.column(side)[k].as_py(), width)
                        held += made[x].nbytes + 200
                a, b = (made[x] for x in ends)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(bool(shared >= similarity * (len(a) + len(b) - shared) - 1e-9))
                if keep[-1]:
                    above[roots[0]] = roots[1]
                if held > _SETS_HELD:
                    made.clear()
                    held = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "left", "right").mapInArrow(tidied(run), "u long, v long")


def keep_unlike(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row, that of least doc_id, of each group linked by Jaccard similarity of runs of ``width`` words.

    Candidates are found by SimHash and compared by their whole shingle sets.  The trees give those within
    ``RADIUS`` of 64 bits.  At similarity 0.8 fingerprints differ in more bits than a tree can prune, so that the rest
    is found by tables of sampled bits of a SimHash of 128 bits: first with one leader of each
    entry, then among all that are not yet of one component.  Texts without words are equal.
    Rows are told apart by id and text: of equal ones one stays; rows without an id are left as they are.
    """
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    prints = materialise(sketches(known, width), "near-sketches")
    sets = materialise(prints.groupBy("digest").agg(F.min_by(F.struct("hash", "size", "fp", "fp2"), F.struct("doc_id", "hash")).alias("one"), F.min("doc_id").alias("low")).select("digest", "low", "one.*"), "near-sets")
    some = sets.where("size > 0")
    tables = sampled_bits(some.count())
    to_leader = close_prints(some.withColumn("own", F.col("digest")), tables, similarity, leaders=True)
    found = materialise(alike(known, sets, tree_pairs(some).unionByName(to_leader), width, similarity), "near-links")
    own = connected_components(found, "near").select(F.col("vertex").alias("digest"), F.col("component").alias("own"))
    placed = materialise(some.join(own, "digest", "left").select("digest", "size", "fp", "fp2", F.coalesce("own", "digest").alias("own")), "near-placed")
    others = close_prints(placed, tables, similarity, leaders=False)
    linked = connected_components(found.unionByName(alike(known, sets, others, width, similarity)), "near")
    groups = sets.join(linked, sets.digest == linked.vertex, "left").select("digest", "low", "hash", F.coalesce("component", "digest").alias("component"))
    kept = groups.groupBy("component").agg(F.min(F.struct(F.col("low").alias("doc_id"), "hash")).alias("key")).select("key.*")
    return _rows_of(docs, kept)
