"""Exact repeats of byte strings across documents by a distributed sparse suffix array.

Every string of ``length`` bytes has an anchor: the place of least hash among its
runs of ``GRAM`` bytes.  Equal strings have equal anchors, so it is enough to sort
the suffixes (and reversed prefixes) at anchors.  Anchors whose run of bytes occurs
in one document only are left out first.  The others are range-partitioned by
their leading bytes at splitters taken from a sample; each bucket sorts them by
multikey quicksort, compares neighbours, and knows from the common prefixes which
strings are equal and which document has them first.  Suffixes with equal runs
are never apart, so nothing has to be compared across a boundary of buckets.

The answer to a part is one bit for each string: whether it starts in a document of
smaller id.  Bytes that such a string covers are removed.

Cases: a null text is an empty one; texts shorter than ``length`` keep all bytes;
rows of one id do not repeat each other; a null id is larger than all others; equal rows
each give a row; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scatter

LENGTH = 50
GRAM = 20
#: Documents whose anchors give the splitters.
SAMPLE_DOCS = 256
_BLOCK = 1 << 20
_U = np.uint64


# -- anchors --------------------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each run of GRAM = 20 bytes, built from runs of 1, 2, 4, 8 and 16."""
    base = 0x9E3779B1
    h1 = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA77)
    h1 ^= h1 >> np.uint32(15)
    join = lambda a, b, n: a[: len(b)] * np.uint32(pow(base, n, 1 << 32)) + b
    h2 = join(h1, h1[1:], 1)
    h4 = join(h2, h2[2:], 2)
    h8 = join(h4, h4[4:], 4)
    h16 = join(h8, h8[8:], 8)
    h = join(h16, h4[16:], 4)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    held, span = keys, 1
    while 2 * span <= width:
        held = np.minimum(held[:-span], held[span:])
        span *= 2
    rest = width - span
    return np.minimum(held[: len(held) - rest], held[rest:]) if rest else held


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts that lie end to end: (first string start, last string start, place) of each.

    ``ends`` are the texts' ends.  Strings lie within one text; each belongs to
    exactly one anchor, the leftmost place of least hash in it.
    """
    out = []
    starts = np.concatenate(([0], ends[:-1]))
    at = 0
    while at < len(ends):  # blocks of whole texts
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, side="right")))
        a, z = int(starts[at]), int(ends[to - 1])
        if z - a >= length:
            keys = (_gram_hashes(data[a:z]).astype(_U) << _U(32)) | np.arange(z - a - GRAM + 1, dtype=_U)
            place = (_sliding_least(keys, length - GRAM + 1) & _U(0xFFFFFFFF)).astype(np.int64)
            inside = np.ones(len(place) + 1, bool)
            inside[-1] = False
            cut = ends[at:to] - a
            sizes = np.minimum(length - 1, cut - (starts[at:to] - a))
            bad = np.repeat(cut - sizes, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            inside[bad[bad < len(place)]] = False
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] != place[:-1]) | ~inside[: len(place) - 1]
            low = np.flatnonzero(new & inside[:-1])
            if len(low):
                stop = np.flatnonzero((new | ~inside[:-1]))
                after = np.append(stop, len(place))[np.searchsorted(stop, low, side="right")]
                out.append((low + a, after - 1 + a, place[low] + a))
        at = to
    if not out:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def gram_names(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 20 bytes at each place."""
    out = np.zeros(len(places), _U)
    for at in range(0, len(places), 1 << 18):
        some = places[at : at + (1 << 18)]
        raw = np.lib.stride_tricks.sliding_window_view(data, GRAM)[some]
        a, b, c = (np.ascontiguousarray(raw[:, k : k + 8]).view("<u8").ravel().astype(_U) for k in (0, 8, 12))
        h = (a ^ (b * _U(0x9E3779B97F4A7C15))) * _U(0xBF58476D1CE4E5B9)
        h ^= (h >> _U(29)) ^ (c * _U(0x94D049BB133111EB))
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        out[at : at + len(some)] = h ^ (h >> _U(32))
    return out


# -- sorting ------------------------------------------------------------------------------------------


def multikey_order(words: np.ndarray, small: int = 4096) -> np.ndarray:
    """Order of rows of big-endian words by multikey quicksort.

    A segment is split in three at a pivot word; the middle goes on with the next
    word.  Small segments are sorted word by word at once.
    """
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        a, z, depth = todo.pop()
        if z - a < 2 or depth == words.shape[1]:
            continue
        here = order[a:z]
        if z - a <= small:
            order[a:z] = here[np.lexsort(words[here, depth:].T[::-1])]
            continue
        word = words[here, depth]
        pivot = np.partition(word[:: max(1, len(word) // 255)], -1 - len(word[:: max(1, len(word) // 255)]) // 2)[-1 - len(word[:: max(1, len(word) // 255)]) // 2]
        less, more = word < pivot, word > pivot
        same = ~(less | more)
        order[a:z] = np.concatenate((here[less], here[same], here[more]))
        b = a + int(less.sum())
        c = b + int(same.sum())
        todo += [(a, b, depth), (b, c, depth + 1), (c, z, depth)]
    return order


def _sorted_with_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and each one's common prefix with the one before it (0 for the first)."""
    n, wide = rows.shape
    padded = np.zeros((n, -(-wide // 8) * 8), np.uint8)
    padded[:, :wide] = rows
    order = multikey_order(padded.view(">u8").astype(_U))
    prefix = np.zeros(n, np.int64)
    for at in range(1, n, 1 << 16):
        differ = rows[order[at : at + (1 << 16)]] != rows[order[at - 1 : min(n, at + (1 << 16)) - 1]]
        prefix[at : at + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    return order, prefix


def smaller_elsewhere(context: np.ndarray, first: np.ndarray, size: np.ndarray, place: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each record a mask of its strings that start in a document of smaller id.

    Record i's context is ``context[first[i] : first[i] + size[i]]`` with its
    anchor ``place[i]`` bytes in; its strings start at bytes 0 .. size - length of it;
    bit k of the mask stands for the string at byte k.
    """
    n = len(first)
    masks = np.zeros(n, np.uint32)
    if not n:
        return masks
    reach = length - GRAM  # a string starts at most so many bytes before its anchor
    tail = np.concatenate((context, np.zeros(length, np.uint8)))
    right = np.lib.stride_tricks.sliding_window_view(tail, length)[first + place].copy()
    right[np.arange(length) >= (size - place)[:, None]] = 0
    left = np.concatenate((np.zeros(reach, np.uint8), context))
    left = np.lib.stride_tricks.sliding_window_view(np.concatenate((left, np.zeros(1, np.uint8))), reach)[first + place][:, ::-1].copy()
    left[np.arange(reach) >= place[:, None]] = 0
    right_order, right_prefix = _sorted_with_prefixes(right)
    left_order, left_prefix = _sorted_with_prefixes(left)
    right_class, left_class = np.zeros(n, _U), np.zeros(n, _U)
    for back in range(reach + 1):  # strings that start so many bytes before the anchor
        held = np.flatnonzero((place >= back) & (size - place >= length - back))
        if not len(held):
            continue
        right_class[right_order] = np.cumsum(right_prefix < length - back).astype(_U)
        left_class[left_order] = np.cumsum(left_prefix < back).astype(_U) if back else _U(0)
        name = (left_class[held] << _U(32)) | right_class[held]
        order = np.argsort(name, kind="stable")
        runs = np.flatnonzero(np.diff(name[order], prepend=name[order[:1]] ^ _U(1)))
        least = np.repeat(np.minimum.reduceat(owner[held][order], runs), np.diff(np.append(runs, len(order))))
        later = held[order[least < owner[held][order]]]
        masks[later] |= (np.uint32(1) << (place[later] - back).astype(np.uint32)).astype(np.uint32)
    return masks


# -- steps ---------------------------------------------------------------------------------------------


class Part:
    """A part's texts end to end with their anchors, always the same for the same rows."""

    def __init__(self, rows: pa.Table, length: int) -> None:
        keys, null, texts = scatter.documents_of(rows)
        self.number, self.keys, self.null, self.texts, self.length = rows.column("part")[0].as_py(), keys, null, texts, length
        # ids in order, null last
        self.owner = np.where(null, np.iinfo(np.int64).max, keys)
        self.ends = np.cumsum([len(t) for t in texts])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.low, self.high, self.place = anchors(self.data, self.ends, length)
        self.doc = np.searchsorted(self.ends, self.low, side="right")
        name = gram_names(self.data, self.place)
        self.names, self.name = np.unique(name, return_inverse=True)

    def spread(self, buckets: int) -> np.ndarray:
        """The bucket of each distinct name; it rises with the name."""
        return ((self.names >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)

    def shared(self, elsewhere: np.ndarray) -> np.ndarray:
        """Anchors whose name other parts have, or another id of this part."""
        least = np.full(len(self.names), np.iinfo(np.int64).max)
        most = np.full(len(self.names), np.iinfo(np.int64).min)
        owner = self.owner[self.doc]
        np.minimum.at(least, self.name, owner)
        np.maximum.at(most, self.name, owner)
        return np.flatnonzero((elsewhere | (least != most))[self.name])

    def records(self, elsewhere: np.ndarray, splitters: list[bytes]) -> list[tuple[int, np.ndarray, dict]]:
        """By bucket: (bucket, anchors, context number of each, contexts): equal contexts of a part are sent once, for their least id."""
        picked = self.shared(elsewhere)
        raw = self.data.tobytes()
        low, high, place = self.low[picked].tolist(), self.high[picked].tolist(), self.place[picked].tolist()
        cut = np.array(splitters, f"S{GRAM}")
        grams = np.array([raw[p : p + GRAM] for p in place], f"S{GRAM}")
        bucket = np.searchsorted(cut, grams, side="right") if len(grams) else np.zeros(0, np.int64)
        out = []
        order = np.argsort(bucket, kind="stable")
        for b, start, stop in scatter.runs(bucket[order]):
            here = order[start:stop]
            number: dict[tuple[bytes, int], int] = {}
            which = np.fromiter((number.setdefault((raw[low[i] : high[i] + self.length], place[i] - low[i]), len(number)) for i in here.tolist()), np.int64, len(here))
            least = np.full(len(number), np.iinfo(np.int64).max)
            np.minimum.at(least, which, self.owner[self.doc[picked[here]]])
            out.append((b, picked[here], which, {"contexts": list(number), "least": least}))
        return out


def _elsewhere(part: Part, answers: pa.Table, buckets: int) -> np.ndarray:
    out = np.zeros(len(part.names), bool)
    ends = np.searchsorted(part.spread(buckets), np.arange(buckets), side="right")
    for bucket, data in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True):
        a, z = int(ends[bucket - 1]) if bucket else 0, int(ends[bucket])
        out[a:z] = np.unpackbits(np.frombuffer(data, np.uint8), count=z - a).astype(bool)
    return out


def sent_by_several(sent: list[np.ndarray]) -> list[np.ndarray]:
    """For each part's names whether another part has sent them too; a message costs no more than its own names."""
    whole = np.sort(np.concatenate([np.unique(x) for x in sent]))
    twice = np.unique(whole[1:][whole[1:] == whole[:-1]])
    if not len(twice):
        return [np.zeros(len(x), bool) for x in sent]
    return [twice[np.minimum(np.searchsorted(twice, x), len(twice) - 1)] == x for x in sent]


def repeated_strings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, part_bytes: int = scatter.PART_BYTES) -> DataFrame:
    """``(key long, n_bytes, n_removed, n_spans, kept binary)`` for each row of ``docs``."""
    if not GRAM <= length <= GRAM + 31:
        raise ValueError(f"length {length}: a mask holds the strings of an anchor for {GRAM} to {GRAM + 31} bytes")
    parts = scatter.deal(docs, key, text, part_bytes)
    buckets = parts.count
    splitters = sample_splitters(docs, key, text, length, buckets)

    def names(rows: pa.Table) -> pa.Table:
        part = Part(rows, length)
        spread = part.spread(buckets)
        short = (part.names & _U(0xFFFFFFFF)).astype("<u4")
        return scatter.messages((part.number, b, short[a:z].tobytes()) for b, a, z in scatter.runs(spread))

    def several(rows: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, "<u4") for x in rows.column("data").to_pylist()]
        return scatter.messages(
            (p, b, np.packbits(x).tobytes()) for p, b, x in zip(rows.column("part").to_pylist(), rows.column("bucket").to_pylist(), sent_by_several(sent), strict=True)
        )

    def contexts(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return scatter.messages(())
        part = Part(rows, length)

        def made():
            for b, _, _, found in part.records(_elsewhere(part, answers, buckets), splitters):
                texts = [c for c, _ in found["contexts"]]
                head = np.array([len(texts)], "<i8").tobytes()
                sizes = np.array([len(c) for c in texts], np.uint8).tobytes()
                place = np.array([p for _, p in found["contexts"]], np.uint8).tobytes()
                yield part.number, b, head + found["least"].astype("<i8").tobytes() + sizes + place + b"".join(texts)

        return scatter.messages(made())

    def compared(rows: pa.Table) -> pa.Table:
        owner, size, place, body, counts = [], [], [], [], []
        for data in rows.column("data").to_pylist():
            n = int(np.frombuffer(data, "<i8", 1)[0])
            counts.append(n)
            owner.append(np.frombuffer(data, "<i8", n, 8))
            size.append(np.frombuffer(data, np.uint8, n, 8 + 8 * n))
            place.append(np.frombuffer(data, np.uint8, n, 8 + 9 * n))
            body.append(np.frombuffer(data, np.uint8, offset=8 + 10 * n))
        size = np.concatenate(size).astype(np.int64)
        masks = smaller_elsewhere(np.concatenate(body), np.cumsum(size) - size, size, np.concatenate(place).astype(np.int64), np.concatenate(owner), length)
        cut = np.split(masks, np.cumsum(counts)[:-1])
        return scatter.messages((p, b, m.astype("<u4").tobytes()) for p, b, m in zip(rows.column("part").to_pylist(), rows.column("bucket").to_pylist(), cut, strict=True))

    def applied(rows: pa.Table, answers: pa.Table) -> pa.Table:
        part = Part(rows, length) if rows.num_rows else None
        marks = {b: np.frombuffer(x, "<u4") for b, x in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True) if b >= 0}
        first = {-1 - b: x for b, x in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True) if b < 0}
        if part is None:
            return _result([])
        known = pa.table({"bucket": pa.array(list(first), pa.int64()), "data": pa.array(list(first.values()), pa.binary())})
        change = np.zeros(len(part.data) + 1, np.int64)
        bits = np.arange(32, dtype=np.uint32)
        for b, which_anchor, which_context, found in part.records(_elsewhere(part, known, buckets), splitters):
            mask = marks[b][which_context]
            later = part.owner[part.doc[which_anchor]] > found["least"][which_context]
            low, high = part.low[which_anchor], part.high[which_anchor]
            np.add.at(change, low[later], 1)
            np.add.at(change, high[later] + length, -1)
            i, k = np.nonzero((mask[~later][:, None] >> bits) & np.uint32(1))
            start = low[~later][i] + k
            np.add.at(change, start, 1)
            np.add.at(change, start + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = []
        begin = 0
        for key_, null, end, raw in zip(part.keys.tolist(), part.null.tolist(), part.ends.tolist(), part.texts, strict=True):
            here = gone[begin:end]
            n = int(here.sum())
            spans = int(np.count_nonzero(np.diff(here.view(np.int8), prepend=0) == 1)) if n else 0
            kept = part.data[begin:end][~here].tobytes() if n else raw
            out.append((None if null else key_, end - begin, n, spans, kept))
            begin = end
        return _result(out)

    asked = scatter.ask(parts, names)
    told = scatter.answer(asked, several)
    sent = scatter.hear(parts, told, contexts, scatter.MESSAGE)
    judged = scatter.answer(sent, compared)
    # the first answers come along once more, under negative numbers
    again = told.select("part", (-1 - F.col("bucket")).alias("bucket"), "data")
    return scatter.hear(parts, judged.unionByName(again), applied, "key long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("key", key)


def _result(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["key", "n_bytes", "n_removed", "n_spans", "kept"])


def sample_splitters(docs: DataFrame, key: str, text: str, length: int, buckets: int) -> list[bytes]:
    """Bounds between buckets: quantiles of the runs of bytes at the anchors of at most SAMPLE_DOCS documents."""
    # hashes alone are ranked; only the texts of those that are picked leave their tasks
    named = docs.where(F.col(text).isNotNull()).withColumns({"__h": F.xxhash64(F.col(key), F.octet_length(text)), "__t": F.col(text).cast("binary")}).select("__h", "__t")
    picked = [r["__h"] for r in named.select("__h").distinct().orderBy("__h").limit(SAMPLE_DOCS).collect()]
    rows = named.where(F.col("__h").isin(picked)).dropDuplicates(["__h"]).orderBy("__h").collect() if picked else []
    texts = [bytes(r["__t"]) for r in rows]
    data = np.frombuffer(b"".join(texts), np.uint8)
    _, _, place = anchors(data, np.cumsum([len(t) for t in texts]), length) if texts else (None, None, [])
    raw = data.tobytes()
    grams = sorted({raw[p : p + GRAM] for p in np.asarray(place, int).tolist()})
    return sorted({grams[i * len(grams) // buckets] for i in range(1, buckets)}) if grams else []


def digests(docs: DataFrame) -> DataFrame:
    """``documents`` without repeated strings, as counts and the digest of what stays."""
    return repeated_strings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


DIGESTS_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
     w AS (SELECT doc_id, i, b[i + 1 : i + 50] AS s FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 49)) AS i FROM d WHERE octet_length(b) >= 50)),
     f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
     r AS (SELECT w.doc_id, w.i FROM w JOIN f ON w.s = f.s WHERE f.first < w.doc_id),
     g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM r),
     n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
     x AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS z FROM n GROUP BY doc_id, span),
     k AS (SELECT x.doc_id, x.a, x.z, hex(d.b) AS h, coalesce(lag(x.z) OVER (PARTITION BY x.doc_id ORDER BY x.a), 0) AS after,
                  lead(x.a) OVER (PARTITION BY x.doc_id ORDER BY x.a) AS more, octet_length(d.b) AS total
           FROM x JOIN d ON x.doc_id = d.doc_id),
     s AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans,
                  string_agg(substr(h, 2 * after + 1, 2 * (a - after)) || CASE WHEN more IS NULL THEN substr(h, 2 * z + 1, 2 * (total - z)) ELSE '' END, '' ORDER BY a) AS kept
           FROM k GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(octet_length(d.b) AS BIGINT) AS n_bytes, CAST(coalesce(s.gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(s.spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN s.doc_id IS NULL THEN d.b ELSE unhex(s.kept) END) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
