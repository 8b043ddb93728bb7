"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

Items and documents are reduced to lower-case words of letters and digits with
one space between.  An item may occur with as many edits as ``ERROR_RATE`` of its
length; it is cut into one piece more than that, so that one piece at least
occurs unchanged.  An automaton finds the pieces in a document.  From a piece the
match is verified upwards: two neighbouring pieces may have one edit, four three,
and so on up to the whole item; Myers' bit-parallel algorithm counts the edits.

Items of fewer than ``LEAST_CHARS`` reduced characters must occur exactly, between word bounds.

Items are dealt to blocks of about ``BLOCK_BYTES``.  One block travels with the tasks; several lie in
the shared folder, and a task holds what it has read of the documents, some ``HELD_BYTES`` at a time, against
one block after the other, so that documents are read once however many items there are.

Cases: null and empty texts hold nothing, an item without a letter or digit is never found; equal rows each give
their own rows; items of one id but several texts count with the closest; a null id is kept as it is; other
columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, open_read, open_write, scratch_path, slices, text_bytes, tidied

ERROR_RATE = 0.1
LEAST_CHARS = 25
BLOCK_BYTES = 4 << 20
HELD_BYTES = 32 << 20
_GAPS = re.compile(r"[\W_]+")


def reduce_text(text: str | None) -> str:
    return _GAPS.sub(" ", text.lower()).strip() if text else ""


def letter_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def closest(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of length m to any stretch of the text, and the first end of such a stretch."""
    ones = (1 << m) - 1
    top = 1 << m - 1
    plus, minus, score = ones, 0, m
    best, end = m, 0
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ones & ~(diagonal | plus)
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        up <<= 1
        plus = (down << 1 | ~(vertical | up)) & ones
        minus = up & vertical
    return best, end


def shortest(masks: dict[str, int], m: int, text: str, edits: int) -> int:
    """Length of the shortest start of ``text`` that is ``edits`` away from a pattern of length m."""
    ones = (1 << m) - 1
    top = 1 << m - 1
    plus, minus, score = ones, 0, m
    if score == edits:
        return 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ones & ~(diagonal | plus)
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        if score == edits:
            return j
        up = up << 1 | 1  # each letter of the text before the pattern is an edit
        plus = (down << 1 | ~(vertical | up)) & ones
        minus = up & vertical
    return len(text)


class Matcher:
    """All items of a block as one automaton over their pieces."""

    def __init__(self, items: list[tuple[object, str | None]], rate: float = ERROR_RATE, least: int = LEAST_CHARS) -> None:
        texts = sorted({(reduce_text(t), i) for i, t in items}, key=str)
        self.items = [(i, t) for t, i in texts if t]
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        self.budget = [int(rate * len(t)) for _, t in self.items]
        pieces: dict[str, list[tuple[int, int, int, tuple]]] = {}
        for k, (_, t) in enumerate(self.items):
            if len(t) < least:
                self.budget[k] = 0
                pieces.setdefault(f" {t} ", []).append((k, 0, len(t), ()))
                continue
            n = self.budget[k] + 1
            cuts = [i * len(t) // n for i in range(n + 1)]
            for first, last, above in self._leaves(0, n, cuts, ()):
                a, z = cuts[first], cuts[last]
                pieces.setdefault(t[a:z], []).append((k, a, z, above))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.empty = not pieces
        if pieces:
            self.automaton.make_automaton()

    def _leaves(self, lo: int, hi: int, cuts: list[int], above: tuple) -> Iterator[tuple[int, int, tuple]]:
        """Pieces lo..hi-1 with the stretches above each, smallest first: (start, end, edits allowed)."""
        if hi - lo == 1:
            yield lo, hi, above
            return
        path = ((cuts[lo], cuts[hi], hi - lo - 1), *above)
        mid = (lo + hi) // 2
        yield from self._leaves(lo, mid, cuts, path)
        yield from self._leaves(mid, hi, cuts, path)

    def _closest(self, k: int, a: int, z: int, text: str) -> tuple[int, int]:
        if (k, a, z) not in self.masks:
            self.masks[k, a, z] = letter_masks(self.items[k][1][a:z])
        return closest(self.masks[k, a, z], z - a, text)

    def _hits(self, text: str, passed: dict[int, tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """``(item, edits, start, end)`` of what is within its budget; items that ``passed`` has without edits are not looked at again."""
        looked: dict[int, tuple[int, int]] = {}  # by item: the stretch that the whole item was last held against
        # pieces of words lie anywhere, short items between two spaces
        for end, (size, where) in () if self.empty or not text else self.automaton.iter(f" {text} "):
            start = end - size
            for k, a, z, above in where:
                if k in passed and passed[k][0] == 0:
                    continue
                edits, stop = 0, end
                if not self.budget[k]:
                    start, stop = start + (size > z - a), start + (size > z - a) + z - a
                most, whole = self.budget[k], start - a + len(self.items[k][1])
                if above and k in looked and looked[k][0] <= max(0, start - a - most) and min(len(text), whole + most) <= looked[k][1]:
                    continue
                for pa_, pz, allowed in above:
                    lo, hi = max(0, start - (a - pa_) - allowed), start + (pz - a) + allowed
                    if allowed == most:  # further pieces of the same occurrence need not look again
                        lo, hi = max(0, lo - most), hi + most
                        looked[k] = lo, hi
                    edits, stop = self._closest(k, pa_, pz, text[lo:hi])
                    stop += lo
                    if edits > allowed:
                        break
                else:
                    yield k, edits, start - a, stop

    def holds(self, raw: str | None) -> bool:
        """Whether any item occurs."""
        return next(self._hits(reduce_text(raw), {}), None) is not None

    def find(self, raw: str | None) -> list[tuple[object, int, int, int, int]]:
        """``(item id, edits, item length, start, end)`` of each item's closest occurrence in the reduced text."""
        text = reduce_text(raw)
        best: dict[int, tuple[int, int, int]] = {}
        for k, edits, start, stop in self._hits(text, best):
            if k not in best or (edits, stop) < (best[k][0], best[k][2]):
                best[k] = edits, start, stop
        out: dict[object, tuple[object, int, int, int, int]] = {}
        for k, (edits, _, stop) in best.items():
            ident, t = self.items[k]
            # the end is known: the start is the end of the reversed match
            back = text[max(0, stop - len(t) - edits) : stop][::-1]
            begin = stop - shortest(letter_masks(t[::-1]), len(t), back, edits)
            row = ident, edits, len(t), begin, stop
            if ident not in out or row[1:] < out[ident][1:]:
                out[ident] = row
        return sorted(out.values(), key=str)


@dataclass
class Blocks:
    """The items, as they are where they fit into one block, else by the files of their blocks."""

    items: list[tuple[object, str]] | None
    paths: list[str]
    rate: float

    def matchers(self) -> Iterator[Matcher]:
        if self.items is not None:
            yield Matcher(self.items, self.rate)
        for path in self.paths:
            with open_read(path) as f:
                yield Matcher(list(zip(*(c.to_pylist() for c in pq.read_table(pa.py_buffer(f.read())).columns), strict=True)), self.rate)


def item_blocks(benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """The items of ``(item_id, text)``: a block's worth comes to the driver, more is written to the shared folder."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    _, size = text_bytes(items, "text")
    n = max(1, -(-size // block_bytes))
    if n == 1:
        return Blocks([(r.item_id, r.text) for r in items.collect()], [], rate)
    dealt = items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block"), "item_id", "text").repartition(n, "block")
    folder = scratch_path(benchmark.sparkSession, "benchmark")
    places: list[str] = []

    def write(rows: pa.Table) -> pa.Table:
        path = f"{folder}/block-{uuid.uuid4().hex}.parquet"
        with open_write(path) as out:
            pq.write_table(rows.select(["item_id", "text"]), out)
        return pa.table({"path": [path]})

    places = [r.path for r in materialise(dealt.groupBy("block").applyInArrow(write, "path string"), "benchmark-blocks").collect()]
    return Blocks(None, sorted(places), rate)


def _matched(batches: Iterator[pa.RecordBatch], at: int, blocks: Blocks, look: Callable[[Matcher, str | None], list], held_bytes: int = HELD_BYTES) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Parts of the batches with what all blocks have found in each row."""
    if blocks.items is not None:
        matcher = next(blocks.matchers())
        for batch in batches:
            for part in slices(batch, at):
                yield part, [look(matcher, t) for t in part.column(at).to_pylist()]
        return
    held: list[pa.RecordBatch] = []

    def through() -> Iterator[tuple[pa.RecordBatch, list[list]]]:
        found: list[list[list]] = [[[] for _ in range(part.num_rows)] for part in held]
        for matcher in blocks.matchers():
            for part, rows in zip(held, found, strict=True):
                for row, t in zip(rows, part.column(at).to_pylist(), strict=True):
                    row += look(matcher, t)
        yield from zip(held, found, strict=True)
        held.clear()

    size = 0
    for batch in batches:
        for part in slices(batch, at):
            held.append(part)
            size += part.nbytes
            if size >= held_bytes:
                yield from through()
                size = 0
    if held:
        yield from through()


def find_items(df: DataFrame, key: str, text: str, blocks: Blocks, item_type: str) -> DataFrame:
    """``(key, hits array<struct<item_id, edits, item_chars, start, end>>)`` for each row.  No shuffle."""
    kind = df.schema[key].dataType.simpleString()
    hit = f"array<struct<item_id:{item_type},edits:int,item_chars:int,start:int,end:int>>"
    names = ("item_id", "edits", "item_chars", "start", "end")

    def closest_of(hits: list[tuple]) -> list[dict]:
        by_item: dict[object, tuple] = {}
        for hit in hits:
            by_item[hit[0]] = min(hit, by_item.get(hit[0], hit), key=lambda h: h[1:])
        return [dict(zip(names, h, strict=True)) for h in by_item.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.int64() if item_type == "bigint" else pa.string()
        struct = pa.struct([("item_id", item), *((n, pa.int32()) for n in names[1:])])
        for part, found in _matched(batches, 1, blocks, Matcher.find):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([closest_of(hits) for hits in found], pa.list_(struct))], names=["key", "hits"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), f"key {kind}, hits {hit}").withColumnRenamed("key", key)


def _items(benchmark: DataFrame) -> tuple[DataFrame, str]:
    whole = benchmark.schema["item_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    kind = "bigint" if whole else "string"
    return benchmark.select(F.col("item_id").cast(kind).alias("item_id"), F.col("text").cast("string").alias("text")), kind


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents that hold an item: doc_id, item_id, edits, item_chars, start, end (in the reduced text)."""
    items, kind = _items(benchmark)
    return find_items(docs, "doc_id", "text", item_blocks(items, rate, block_bytes), kind).select("doc_id", F.inline("hits"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no item, with the columns of ``documents``."""
    blocks = item_blocks(_items(benchmark)[0], rate, block_bytes)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _matched(batches, at, blocks, lambda matcher, t: [True] if matcher.holds(t) else []):
            yield part.filter(pa.array([not hits for hits in found], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
