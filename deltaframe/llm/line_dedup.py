"""Fuzzy deduplication of lines.

Lines are reduced to lower-case words of letters and digits.  Two lines are linked
if their edit similarity is at least ``SIMILARITY``.  Of each connected group the first
occurrence stays, in order of doc_id and place; equal lines are one group anyway.

Lines to compare are found by min-hashes of their word pairs, and of their runs of
``GRAM`` bytes where they have at most ``SHORT`` characters or hardly any words: lines that agree in three of
their least hashes, in one of the combinations ``AGREED``, share a bucket, and are compared if they agree in ``LEAST_AGREED`` hashes.  A SimHash
with pigeonhole blocks cannot find them: of lines at similarity 0.8 the SimHashes of 64 bits differ in 5 bits at the median and
9 at the ninth decile, so that a block would be 6 bits wide and a bucket hold a 64th of all lines.

Within a bucket all lines are first held against the bucket's leader, which costs
a row per line.  Components of these links are then contracted, and only lines
outside their leader's component are held against the rest of the bucket, so that
a large group of near copies is never paired with itself.  Where that would still be
more than ``PAIRS`` pairs a bucket, lines must agree in one more least hash, as all that are compared do.
Of what lines of a bucket are linked by a spanning forest is given, and lines that are linked already are not compared.

Lines are reduced, hashed and compared in Arrow batches: splitting words by a pattern and adding them up in SQL alone
takes more than all of this.  All else is joins and aggregates.  Lines of at most ``SHORT`` bytes travel with their
signatures and are read where they meet.  Of longer ones that meet in a bucket a row each is written, not a row a pair; their
texts, read at their first places, go to the bucket again, where each pair is compared in the first bucket that it shares.

Lines are known by 128 bits of XXH3 of their reduced text; links join the first 64.

Cases: lines without a letter or digit are left as they are; a null text stays
null and has no lines; an empty one has one, blank, line.  Rows of one doc_id count as one document
(a line kept at a place is kept there in each of them); rows without a doc_id
come after all others; other columns are not read and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, connected_components, materialise, slices, tidied
from .simhash import Forest

#: Least hashes of a line's word pairs (w) and runs (g), and which of them make a bucket together: the triples of
#: Steiner systems of nine points and, for runs, of which a changed letter spoils more, of thirteen.
MINIMA = {"w": 9, "g": 13}
AGREED = {
    "w": ((0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (1, 5, 6), (2, 3, 7), (0, 5, 7), (1, 3, 8), (2, 4, 6)),
    "g": tuple(tuple((k + i) % 13 for i in first) for first in ((0, 1, 4), (0, 2, 7)) for k in range(13)),
}
#: Characters of a run, and of a line whose runs are looked at.
GRAM = 4
SHORT = 80
#: Characters a word from which on a line hardly has words, as in scripts without spaces.
WORDLESS = 30
_FACTORS = {kind: np.random.default_rng(seed).integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for seed, (kind, n) in enumerate(MINIMA.items(), 41)}
#: What stands for a least hash that a line hasn't.
_NONE = 2**32 - 1
_SKETCH = [f"s{k}" for k in range((sum(MINIMA.values()) + 1) // 2)]
#: How often characters occur in a line of at most ``SHORT`` bytes, by the last four bits of their first byte, eight counts in a column;
#: of a longer one by the last three, four in a column.
_COUNTS = ["c0", "c1"]
#: The UTF-8 bytes of a line that has no more than ``SHORT`` of them, eight in a column; null for others.
_TEXT = [f"x{k}" for k in range(SHORT // 8)]
_RUNS = 4 * MINIMA["w"]  # where a signature has the last bytes of the hashes of runs, after all of those of word pairs
_HAS = _RUNS + MINIMA["g"]  # where it says which kinds of hashes a line has
_SIGNATURE = [f"z{k}" for k in range((_HAS + 2 + 16 + 7) // 8)]
#: The last bits of a bucket's key: the number of its combination, and one more than that of the hash that divides it, or 0.
_COMBINATION, _DIVIDED = 6, 4
_LOW = (1 << _COMBINATION + _DIVIDED) - 1
SIMILARITY = 0.8
#: Least hashes in which two lines of a bucket must agree to be read.
LEAST_AGREED = {"w": 4, "g": 4}
#: Pairs that the lines of a bucket may make once its leader's group is known; beyond, the bucket is divided.
PAIRS = 1 << 17
_AT_ONCE = 1 << 18
#: Rows of at most some 24 bytes that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_LAST = 2**63 - 1
_PLACES = 2**31
_GAPS = re.compile(r"[^\w\n]|_")
_ASCII_GAPS = {c: " " for c in range(128) if not chr(c).isalnum()}
#: Bytes of ASCII and of U+00C0 to U+024F in UTF-8.
_PLAIN = bytes([*range(0xC0), *range(0xC3, 0xCA)])
_WORD_BYTES = np.array([chr(c).isalnum() or c >= 128 for c in range(256)])
_BASE = 0x9E3779B97F4A7C15


def reduce_line(line: str) -> str:
    low = line.lower()
    return " ".join((low.translate(_ASCII_GAPS) if low.isascii() else _GAPS.sub(" ", low)).split())


def _lower_bytes(text: str) -> bytes:
    """A text in lower case, with spaces for what is no letter or digit beyond ASCII."""
    low = text.lower()
    raw = low.encode("utf-8", "surrogatepass")
    if raw.translate(None, _PLAIN) or b"\xc3\x97" in raw or b"\xc3\xb7" in raw:  # of U+00C0 to U+024F only two are no letters
        raw = _GAPS.sub(" ", low).encode("utf-8", "surrogatepass")
    return raw


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POWERS[k] = np.multiply.accumulate(factors)
    return _POWERS[0][:n], _POWERS[1][:n]


_POWERS = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


class Reduced:
    """The lines of some texts that have words, all at once: what they belong to, their bytes and their words."""

    def __init__(self, texts: list[str | None]) -> None:
        low = [None if t is None else _lower_bytes(t) for t in texts]
        n_lines = np.array([0 if t is None else t.count(b"\n") + 1 for t in low], np.int64)
        raw = np.frombuffer(b"\n".join([*(t for t in low if t is not None), b""]), np.uint8)
        word = _WORD_BYTES[raw]
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        number = np.cumsum(raw == 10)[starts]  # of a word's line, among all lines; every text ends with a line's end
        opens = np.diff(number, prepend=-1) != 0
        first = np.flatnonzero(opens)
        owner, place = np.repeat(np.arange(len(texts)), n_lines), np.arange(n_lines.sum()) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
        self.owner, self.pos = owner[number[first]], place[number[first]]
        # words with one space between, lines with one end
        kept = raw.copy()
        kept[ends] = 32
        kept[ends[np.append(first[1:], len(starts))[: len(first)] - 1]] = 10
        word[ends] = True
        self.bytes = kept[word]
        self.lines = self.bytes.tobytes().split(b"\n")[:-1]
        self.first, self.n_words = first, np.diff(np.append(first, len(starts)))
        self.line_of = np.cumsum(opens) - 1
        self._raw, self._starts, self._ends = raw, starts, ends

    def names(self) -> np.ndarray:
        """Two numbers of 64 bits for each line."""
        return np.frombuffer(b"".join(xxhash.xxh3_128_digest(line) for line in self.lines), ">i8").astype(np.int64).reshape(-1, 2)

    def word_hashes(self) -> np.ndarray:
        powers, inverse = _powers(len(self._raw) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self._raw.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)))
        return _mixed((total[self._ends] - total[self._starts]) * inverse[self._starts])

    def sketch(self) -> np.ndarray:
        """Least hashes of each line, those of word pairs first (uint32)."""
        n = len(self.lines)
        out = np.full((n, sum(MINIMA.values())), _NONE, np.uint32)
        if not n:
            return out
        size = np.array([len(x) for x in self.lines])
        chars = np.add.reduceat((self.bytes & 0xC0) != 0x80, np.concatenate(([0], np.cumsum(size + 1)[:-1]))) - 1
        # word pairs, one of them with nothing at either end
        words = np.zeros(len(self._starts) + n + 1, np.uint64)
        words[np.arange(len(self._starts)) + self.line_of + 1] = self.word_hashes()
        pairs = (_mixed(words[:-1] * np.uint64(3) + words[1:]) >> np.uint64(32)).astype(np.uint32)
        begin = self.first + np.arange(n)
        some = chars > SIMILARITY * SHORT
        for k, factor in enumerate(_FACTORS["w"]):
            out[some, k] = np.minimum.reduceat(pairs * factor, begin)[some]
        some = np.flatnonzero((chars <= SHORT) | (chars >= self.n_words * WORDLESS))
        if len(some):
            gap = bytes(GRAM - 1)
            body = np.frombuffer(gap + b"".join(self.lines[i] + gap for i in some), np.uint8).astype(np.uint64)
            runs = sum(body[k : len(body) - GRAM + 1 + k] << np.uint64(8 * k) for k in range(GRAM))
            runs = (_mixed(runs + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
            begin = np.concatenate(([0], np.cumsum(size[some] + GRAM - 1)[:-1]))
            for k, factor in enumerate(_FACTORS["g"]):
                out[some, MINIMA["w"] + k] = np.minimum.reduceat(runs * factor, begin)
        return out

    def counts(self) -> np.ndarray:
        """For each line how many characters have which last bits (two int64): a byte each for four bits where it has at most ``SHORT`` bytes, else two
        for three bits; zeros where these don't hold them."""
        n = len(self.lines)
        size = np.array([len(x) + 1 for x in self.lines], np.int64)
        leads = ((self.bytes & 0xC0) != 0x80) & (self.bytes != 10)
        line = np.repeat(np.arange(n), size)[leads]
        found = np.bincount(line * 16 + (self.bytes[leads] & 15), minlength=16 * n).reshape(n, 16)
        wide = found[:, :8] + found[:, 8:]
        wide[(wide >= 1 << 16).any(1)] = 0
        long = size > SHORT + 1
        out = np.where(long[:, None], 0, found).astype(np.uint8)
        out[long] = wide[long].astype("<u2").view(np.uint8)
        return out.view("<i8")

    def short(self) -> list[pa.Array]:
        """The bytes of each line that fits into the columns ``_TEXT``, filled up with zeros; else nulls."""
        wide = 8 * len(_TEXT)
        long = np.array([len(x) > wide for x in self.lines], bool)
        cells = np.frombuffer(b"".join(bytes(wide) if over else x.ljust(wide, b"\0") for x, over in zip(self.lines, long.tolist(), strict=True)), "<i8")
        return [pa.array(x, mask=long) for x in cells.reshape(-1, len(_TEXT)).T]


def occurrences(docs: DataFrame, sketched: bool) -> DataFrame:
    """``(d, t, pos, line, tag)`` of each line that has words; ``sketched``: with its least hashes, two in a column, counts and text if short.  No shuffle."""
    columns = [*_SKETCH, *_COUNTS, *_TEXT] if sketched else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 1 << 18):
                found = Reduced(part.column(2).to_pylist())
                names = found.names()
                packed = []
                if sketched:
                    least = np.ascontiguousarray(found.sketch())
                    packed = [*(pa.array(x) for x in (*least.view("<i8").T, *found.counts().T)), *found.short()]
                owner = pa.array(found.owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(owner), part.column(1).take(owner), pa.array(found.pos, pa.int32()), pa.array(names[:, 0]), pa.array(names[:, 1]), *packed], names=["d", "t", "pos", "line", "tag", *columns]
                )

    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), "d long, t long, pos int, line long, tag long" + "".join(f", {c} long" for c in columns))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """``(line, tag, first decimal, n, s0.., c0.., x0..)``: the first place of each distinct line, how often it occurs, its least hashes, counts and short text."""
    place = F.col("d").cast("decimal(38,0)") * F.lit(_PLACES).cast("decimal(18,0)") + F.col("pos").cast("decimal(10,0)")
    rows = occurrences(docs, True).select("line", "tag", place.cast("decimal(38,0)").alias("place"), *_SKETCH, *_COUNTS, *_TEXT)
    return rows.groupBy("line", "tag").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in (*_SKETCH, *_COUNTS, *_TEXT)])


def least_hashes(kind: str) -> list[Column]:
    """The least hashes of a kind, from where they are packed; null where there is none."""
    at = list(MINIMA).index(kind) and MINIMA["w"]
    cells = [F.shiftrightunsigned(_SKETCH[k // 2], 32 * (k % 2)).bitwiseAND(F.lit(_NONE)) for k in range(at, at + MINIMA[kind])]
    return [F.nullif(c, F.lit(_NONE)) for c in cells]


def _place_columns(first: str) -> tuple[Column, Column]:
    """Document and place of a packed first place."""
    per = F.lit(_PLACES).cast("decimal(18,0)")
    pos = F.pmod(F.col(first), per)
    return ((F.col(first) - pos) / per).cast("decimal(38,0)").cast("long"), pos.cast("int")


def _marked(key: Column, low: Column) -> Column:
    """A bucket's key with what is known of it in its last bits."""
    return key.bitwiseAND(F.lit(~_LOW)).bitwiseOR(low.cast("long"))


def keyed(lines: DataFrame) -> DataFrame:
    """``(key, line)``: the buckets each line is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.ascontiguousarray(np.stack(_numbers(batch, *_SKETCH), 1)).view("<u4").astype(np.uint64)
            line, at, number = batch.column("line"), 0, 0
            for kind, combinations in AGREED.items():
                some = np.flatnonzero(least[:, at] != _NONE)
                cells, names = least[some, at : at + MINIMA[kind]].T, line.take(pa.array(some))
                for number, (a, b, c) in enumerate(combinations, number):
                    key = _mixed(_mixed(cells[a] << np.uint64(32) | cells[b]) + cells[c]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key & ~_LOW | number), names], names=["key", "line"])
                at, number = at + MINIMA[kind], number + 1

    return lines.select("line", *_SKETCH).mapInArrow(tidied(run), "key long, line long")


def bucketed(lines: DataFrame) -> DataFrame:
    """``(key, line, leader, size)``: the lines of each bucket of more than one, its least line and how many it has."""

    def within(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, line = _numbers(batch, "key", "line")
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        shared = np.repeat(size > 1, size)
        columns = key, line, np.repeat(np.minimum.reduceat(line, first), size), np.repeat(size, size)
        yield pa.RecordBatch.from_arrays([pa.array(x[shared]) for x in columns], names=["key", "line", "leader", "size"])

    return _by_bucket(keyed(lines), within, "key long, line long, leader long, size long")


def divided(crowded: DataFrame, lines: DataFrame) -> DataFrame:
    """``(key, line, own, led)``: buckets parted by one more least hash of their kind, which is none of those that make them."""
    combination = F.col("key").bitwiseAND(F.lit((1 << _COMBINATION) - 1))
    further, first = [], 0
    for kind, combinations in AGREED.items():
        for k, value in enumerate(least_hashes(kind)):
            without = [first + c for c, agreed in enumerate(combinations) if k not in agreed]
            low = combination.bitwiseOR(F.lit(k + 1 << _COMBINATION))
            further.append(F.when(combination.isin(without) & value.isNotNull(), _marked(F.xxhash64("key", F.lit(k), value), low)))
        first += len(combinations)
    rows = crowded.select("key", "line", "own", "led").join(lines.select("line", *_SKETCH), "line")
    return rows.select(F.explode(F.array_compact(F.array(*further))).alias("key"), "line", "own", "led")


def _bounded(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def signatures(lines: DataFrame) -> DataFrame:
    """``(line, z0.., x0..)``: the least hashes of word pairs, the last eight bits of those of runs, which kinds there are, and the counts of characters, eight bytes in a column; short texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [c.to_numpy(zero_copy_only=False) for c in batch.columns[: 1 + len(_SKETCH) + len(_COUNTS)]]
            least = np.ascontiguousarray(np.stack(cells[1 : 1 + len(_SKETCH)], 1)).view("<u4")[:, : sum(MINIMA.values())]
            out = np.zeros((batch.num_rows, 8 * len(_SIGNATURE)), np.uint8)
            out[:, :_RUNS] = np.ascontiguousarray(least[:, : MINIMA["w"]]).view(np.uint8)
            out[:, _RUNS:_HAS] = least[:, MINIMA["w"] :]
            long = batch.column("x0").is_null().to_numpy(zero_copy_only=False)
            out[:, _HAS] = (least[:, 0] != _NONE) + 2 * long
            out[:, _HAS + 1] = least[:, MINIMA["w"]] != _NONE
            out[:, _HAS + 2 : _HAS + 18] = np.ascontiguousarray(np.stack(cells[1 + len(_SKETCH) :], 1)).view(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in np.ascontiguousarray(out).view("<i8").T), *batch.columns[1 + len(_SKETCH) + len(_COUNTS) :]], names=["line", *_SIGNATURE, *_TEXT])

    return lines.select("line", *_SKETCH, *_COUNTS, *_TEXT).mapInArrow(tidied(run), "line long" + "".join(f", {c} long" for c in (*_SIGNATURE, *_TEXT)))


class Signed:
    """The signatures of some lines."""

    def __init__(self, cells: np.ndarray) -> None:
        self.words = np.ascontiguousarray(cells[:, :_RUNS]).view("<u4")
        self.runs = np.ascontiguousarray(cells[:, _RUNS:_HAS])
        self.has = [cells[:, _HAS] & 1 > 0, cells[:, _HAS + 1] > 0]
        self.long = cells[:, _HAS] & 2 > 0
        self.fine = np.ascontiguousarray(cells[:, _HAS + 2 : _HAS + 18])
        wide = self.fine.view("<u2").astype(np.int32)
        self.coarse = np.where(self.long[:, None], wide, self.fine[:, :8].astype(np.int32) + self.fine[:, 8:])
        self.size = self.coarse.sum(1)  # characters; 0: not known


def agreed(left: Signed, i: np.ndarray, right: Signed, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In which hashes of word pairs lines agree, a bit each, and in how many of runs."""
    bits = np.zeros(len(i), np.int64)
    some = np.flatnonzero(left.has[0][i] & right.has[0][j])
    if len(some):
        bits[some] = (left.words[i[some]] == right.words[j[some]]) @ (1 << np.arange(MINIMA["w"]))
    runs = np.zeros(len(i), np.int64)
    some = np.flatnonzero(left.has[1][i] & right.has[1][j])
    if len(some):
        runs[some] = (left.runs[i[some]] == right.runs[j[some]]).sum(1)
    return bits, runs


def promising(left: Signed, i: np.ndarray, right: Signed, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pairs of lines agree in enough of their least hashes to be read, and in which they agree (see agreed()).

    A character that one of two lines has more often needs an edit: lines that need too many are not read.
    """
    a, b = left.size[i], right.size[j]
    most = (1 - similarity) * np.maximum(a, b) + 1e-9
    some = np.flatnonzero((np.minimum(a, b) == 0) | (np.abs(a - b) <= most))
    bits, runs = agreed(left, i[some], right, j[some])
    enough = (np.bitwise_count(bits) >= LEAST_AGREED["w"]) | (runs >= LEAST_AGREED["g"])
    some, bits, runs = some[enough], bits[enough], runs[enough]
    at, to = i[some], j[some]
    known = np.minimum(left.size[at], right.size[to]) > 0
    stay = np.ones(len(some), bool)
    fine = known & ~left.long[at] & ~right.long[to]
    for which, counts in ((fine, "fine"), (known & ~fine, "coarse")):
        if which.any():
            more = getattr(left, counts)[at[which]].astype(np.int32) - getattr(right, counts)[to[which]]
            stay[which] = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1)) <= most[some[which]]
    return some[stay], bits[stay], runs[stay]


def _first_places() -> tuple[np.ndarray, np.ndarray]:
    """By the hashes in which two lines agree, a bit each: the first combination they share, and for each combination one more than the first other hash."""
    n = MINIMA["w"]
    first, other = np.full(1 << n, len(AGREED["w"])), np.zeros((len(AGREED["w"]), 1 << n), np.int64)
    for bits in range(1 << n):
        for c, three in reversed(list(enumerate(AGREED["w"]))):
            if all(bits >> k & 1 for k in three):
                first[bits] = c
            other[c, bits] = next((k + 1 for k in range(n) if bits >> k & 1 and k not in three), 0)
    return first, other


_FIRST_SHARED, _FIRST_OTHER = _first_places()


def meet_here(key: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether this is the first bucket that the lines of a pair share.  Of buckets made by runs that isn't told: all are."""
    combination, by = key & (1 << _COMBINATION) - 1, key >> _COMBINATION & (1 << _DIVIDED) - 1
    out = combination >= len(AGREED["w"])
    some = np.flatnonzero(~out)
    c = combination[some]
    out[some] = (_FIRST_SHARED[bits[some]] == c) & ((by[some] == 0) | (_FIRST_OTHER[c, bits[some]] == by[some]))
    return out


def _signature_of(batch: pa.RecordBatch, names: list[str]) -> Signed:
    return Signed(np.ascontiguousarray(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], 1)).view(np.uint8))


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _characters_of(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of short lines, a row each with zeros at the end, and how many there are; 0 for lines without a text here."""
    raw = np.ascontiguousarray(np.stack([batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in names], 1)).view(np.uint8)
    size = (raw != 0).sum(1)
    beyond = np.flatnonzero((raw >= 128).any(1))
    if not len(beyond):
        return raw, size
    cells = raw.astype(np.uint32)
    cells[beyond] = 0
    for i in beyond.tolist():
        text = np.frombuffer(raw[i, : size[i]].tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        cells[i, : len(text)] = text
        size[i] = len(text)
    return cells.astype(np.uint16) if cells.max() < 1 << 16 else cells, size


def close_texts(cells: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair of texts is at most ``most``, exactly: ``cells`` holds a text's characters in a row."""
    out = np.zeros(len(i), bool)
    order = np.flatnonzero(np.abs(size[i] - size[j]) <= most)
    order = order[np.argsort(size[i[order]] + size[j[order]], kind="stable")]
    for at in range(0, len(order), 4096):
        some = order[at : at + 4096]
        out[some] = _banded(cells, size, i[some], j[some], most[some])
    return out


def _banded(cells: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """All tables of edits at once, an antidiagonal after the other, as far from the main diagonal as ``most`` allows.

    The pairs come in order of their sizes together.
    """
    n_left, n_right = size[i], size[j]
    total, height = n_left + n_right, int(max(n_left.max(), n_right.max()))
    left, right = (np.ascontiguousarray(cells[x, :height].T) for x in (i, j))
    reach = int(most.max())
    far = reach + 1  # stands for all that is more than any pair may have
    kind = np.uint8 if far < 255 else np.uint16
    most, end, alive = most.astype(kind), n_left - n_right + far, np.arange(len(i))
    # row far + d holds the cell (a, b) with a - b = d of this antidiagonal a + b, or of the one before it
    row = np.full((2 * far + 1, len(i)), far, kind)
    row[far] = 0
    out = total == 0
    for s in range(1, int(total[-1]) + 1):
        low, high = max(-reach, -s, s - 2 * height), min(reach, s, 2 * height - s)
        low, high = low + (s - low) % 2, high - (s - high) % 2
        if low > high:
            continue
        here = row[low + far : high + far + 1 : 2]
        near = np.minimum(row[low + far - 1 : high + far : 2], row[low + far + 1 : high + far + 2 : 2])
        near += near < far
        first, last = max(low, 2 - s), min(high, s - 2)
        if first <= last:  # cells that have one before them on the diagonal
            a, b, n = (s + first) // 2 - 1, (s - first) // 2 - 1, (last - first) // 2 + 1
            inner = slice((first - low) // 2, (first - low) // 2 + n)
            here[inner] += left[a : a + n] != right[b - n + 1 : b + 1][::-1]
            np.minimum(here[inner], near[inner], out=here[inner])
            if first > low:
                here[0] = near[0]
            if last < high:
                here[-1] = near[-1]
        else:
            here[:] = near
        np.minimum(here, far, out=here)
        done = slice(*np.searchsorted(total, [s, s + 1]).tolist())
        out[alive[done]] = row[end[done], np.arange(done.start, done.stop)] <= most[done]
        if s % 16 == 0:  # pairs that have too many edits already, or are done
            stay = (row.min(0) <= most) & (total > s)
            if not stay.any():
                break
            if stay.mean() < 0.8:
                left, right, row = left[:, stay], right[:, stay], row[:, stay]
                total, most, end, alive = total[stay], most[stay], end[stay], alive[stay]
    return out


def compared(cells: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of promising pairs stay, and which of those are sure: of pairs of lines whose texts are here only those similar enough do."""
    sure = (size[i] > 0) & (size[j] > 0)
    keep = ~sure
    if sure.any():
        most = ((1 - similarity) * np.maximum(size[i], size[j]) + 1e-9).astype(np.int64)
        keep[sure] = close_texts(cells, size, i[sure], j[sure], most[sure])
    return np.flatnonzero(keep), sure[keep]


def _pairs(a: np.ndarray, b: np.ndarray, sure: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, sure)], names=["a", "b", "sure"])


def promising_pairs(signed: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b, sure)`` of lines that are worth reading, or that are read."""
    side = lambda name: signed.select(F.col("line").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in (*_SIGNATURE, *_TEXT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.arange(batch.num_rows)
            left, right = (_signature_of(batch, [f"{x}_{c}" for c in _SIGNATURE]) for x in "ab")
            batch = batch.take(pa.array(promising(left, at, right, at, similarity)[0]))
            line = _numbers(batch, "a", "b")
            (left, n_left), (right, n_right) = (_characters_of(batch, [f"{x}_{c}" for c in _TEXT]) for x in "ab")
            at = np.arange(batch.num_rows)
            some, sure = compared(np.concatenate((left, right)), np.concatenate((n_left, n_right)), at, at + len(at), similarity)
            yield _pairs(line[0][some], line[1][some], sure)

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidied(run), "a long, b long, sure boolean")


def _by_bucket(dealt: DataFrame, within: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``within`` gives for whole buckets, some at a time."""

    def joined(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(rows).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(key[:1] != held[-1].column("key")[-1].as_py(), key[1:] != key[:-1])) if held else []
            if len(cuts):  # whole buckets end where the last one of this batch starts
                yield from within(joined([*held, batch.slice(0, int(cuts[-1]))]))
                held, batch = [], batch.slice(int(cuts[-1]))
            held.append(batch)
        if held:
            yield from within(joined(held))

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(tidied(run), schema)


def _rows_by_row(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket, a row with all that follow it, so many at a time that they fit into memory."""
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    follow = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(key)) - 1
    upto = np.cumsum(follow)
    start = 0
    while start < len(key):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + _AT_ONCE, side="right")))
        n = follow[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        start = stop


def pairs_within(dealt: DataFrame, similarity: float) -> DataFrame:
    """What lines of one bucket but different components, one of them outside its leader's, are linked, and which are to be read.

    Rows with ``sure`` are links ``(a, b)`` of short lines: a spanning forest of components; what they link is not looked at any more.
    The others are longer lines ``a`` that are worth reading beside one of their bucket: a row of each with its key, component and signature.
    ``dealt``: key, line, own, led, signatures and short texts.  Buckets of no more than ``PAIRS`` pairs, or divided ones, lie together in a sorted partition.
    """
    kept = ["key", "own", "led", *_SIGNATURE]

    def within(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, line, own, led = _numbers(batch, "key", "line", "own", "led")
        sign = _signature_of(batch, _SIGNATURE)
        cells, size = _characters_of(batch, _TEXT)
        labels, node = np.unique(own, return_inverse=True)
        forest = Forest(len(labels))
        met = np.zeros(len(key), bool)
        for i, j in _rows_by_row(key):
            root = forest.roots()[node]
            some = (root[i] != root[j]) & ((own[i] != led[i]) | (own[j] != led[j]))
            i, j = i[some], j[some]
            some, bits, runs = promising(sign, i, sign, j, similarity)
            i, j = i[some], j[some]
            read = (size[i] == 0) | (size[j] == 0)
            later = np.flatnonzero(read)
            later = later[meet_here(key[i[later]], bits[later])]
            met[i[later]] = met[j[later]] = True
            # those that agree in most hashes first: what they link need not be compared
            some = np.flatnonzero(~read)
            some = some[np.argsort(-(np.bitwise_count(bits[some]) + runs[some]), kind="stable")]
            i, j, n = i[some], j[some], 64
            while len(i):
                root = forest.roots()[node]
                some = root[i] != root[j]
                i, j = i[some], j[some]
                some, _ = compared(cells, size, i[:n], j[:n], similarity)
                forest.link(node[i[:n][some]], node[j[:n][some]])
                i, j, n = i[n:], j[n:], min(2 * n, _AT_ONCE)
        root = forest.roots()
        linked = np.flatnonzero(root != np.arange(len(root)))
        blank = [pa.nulls(len(linked), pa.int64())] * len(kept)
        yield pa.RecordBatch.from_arrays([pa.array(labels[linked]), pa.array(labels[root[linked]]), pa.array(np.ones(len(linked), bool)), *blank], names=["a", "b", "sure", *kept])
        rows = batch.filter(pa.array(met))
        n = rows.num_rows
        yield pa.RecordBatch.from_arrays([rows.column("line"), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, bool)), *(rows.column(c) for c in kept)], names=["a", "b", "sure", *kept])

    return _by_bucket(dealt.select("key", "line", "own", "led", *_SIGNATURE, *_TEXT), within, "a long, b long, sure boolean" + "".join(f", {c} long" for c in kept))


def read_within(met: DataFrame, similarity: float) -> DataFrame:
    """Links ``(u, v)`` of components by lines that pairs_within() tells to read, given with their reduced texts: a spanning forest."""

    def within(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, own, led = _numbers(batch, "key", "own", "led")
        sign, texts = _signature_of(batch, _SIGNATURE), batch.column("text")
        labels, node = np.unique(own, return_inverse=True)
        above = list(range(len(labels)))

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for i, j in _rows_by_row(key):
            some = (own[i] != own[j]) & ((own[i] != led[i]) | (own[j] != led[j])) & (sign.long[i] | sign.long[j])
            i, j = i[some], j[some]
            some, bits, runs = promising(sign, i, sign, j, similarity)
            i, j = i[some], j[some]
            here = np.flatnonzero(meet_here(key[i], bits))
            here = here[np.argsort(-(np.bitwise_count(bits[here]) + runs[here]), kind="stable")]
            i, j, n = i[here], j[here], 64
            text: dict[int, str] = {k: texts[k].as_py() for k in np.unique(np.concatenate((i, j))).tolist()}
            while len(i):
                root = np.array([top(k) for k in range(len(labels))])[node]
                some = root[i] != root[j]
                i, j = i[some], j[some]
                left, right = ([text[k] for k in x[:n].tolist()] for x in (i, j))
                far = far_apart(left, right, similarity).tolist()
                for a, b, p, q, no in zip(left, right, node[i[:n]].tolist(), node[j[:n]].tolist(), far, strict=True):
                    if not no and (p := top(p)) != (q := top(q)) and alike(a, b, similarity):
                        above[max(p, q)] = min(p, q)
                i, j, n = i[n:], j[n:], min(2 * n, _PIECES_AT_ONCE)
        linked = [k for k in range(len(labels)) if above[k] != k]
        yield pa.RecordBatch.from_arrays([pa.array(labels[linked] if linked else [], pa.int64()), pa.array(labels[[top(k) for k in linked]] if linked else [], pa.int64())], names=["u", "v"])

    return _by_bucket(met.select("key", "own", "led", *_SIGNATURE, "text"), within, "u long, v long")


def texts_of(docs: DataFrame, lines: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """``(line, text)``: the reduced texts of the wanted lines, read at their first places."""
    d, pos = _place_columns("first")
    places = scratch.keep(lines.join(wanted, "line", "left_semi").select(d.alias("d"), pos.alias("pos"), "line"), "line-places")
    holders = places.select("d").distinct()
    if places.count() <= BROADCAST_ROWS:
        places, holders = F.broadcast(places), F.broadcast(holders)
    # documents without a wanted line are not cut into lines
    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.split("text", "\n").alias("lines"))
    raw = rows.join(holders, "d", "left_semi").select("d", F.posexplode("lines").alias("pos", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                texts = [reduce_line(x) for x in part.column(1).to_pylist()]
                # rows that share a doc_id may hold other lines at this place
                names = [int.from_bytes(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))[:8], "big", signed=True) for t in texts]
                right = pa.array([a == b for a, b in zip(part.column(0).to_pylist(), names, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["line", "text"]).filter(right)

    return scratch.keep(raw.join(places, ["d", "pos"]).select("line", "text").mapInArrow(tidied(run), "line long, text string"), "line-texts")


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two texts is at most ``most``: Myers' algorithm, a column of the table in one number."""
    if abs(len(a) - len(b)) > most:
        return False
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return True
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    ones, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score, left = ones, 0, len(a), len(b)
    for c in b:
        eq = masks.get(c, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ones & ~(diagonal | plus)
        down = plus & diagonal
        left -= 1
        if up & top:
            score += 1
            if score - left > most:
                return False
        elif down & top:
            score -= 1
        up = up << 1 | 1
        plus = (down << 1 | ~(vertical | up)) & ones
        minus = up & vertical
    return score <= most


def _common_start(a: str, b: str) -> int:
    """Letters that two texts start with in common, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def aligned_edits(left: list[str], right: list[str], most: int) -> int:
    """Edits of a greedy alignment of words, at least the edit distance of the texts; more than ``most`` if they grow beyond.

    Where two words differ, the next two words of the right are looked at, then the next of the left; else
    one word becomes the other.
    """
    edits = j = 0
    n = len(right)
    for i, word in enumerate(left):
        there = right[j] if j < n else None
        if word == there:
            j += 1
            continue
        if j + 1 < n and word == right[j + 1]:
            edits += len(there) + 1
            j += 2
        elif there is None or i + 1 < len(left) and left[i + 1] == there:
            edits += len(word) + 1
        elif j + 2 < n and word == right[j + 2]:
            edits += len(there) + len(right[j + 1]) + 2
            j += 3
        else:
            edits += max(len(word), len(there))
            j += 1
        if edits > most:
            return edits
    return edits + sum(len(word) + 1 for word in right[j:])


#: Characters of a piece, the most edits and the least pairs for which pieces are looked up, and the pairs looked at together.
_PIECE, _PIECE_EDITS, _PIECE_PAIRS, _PIECES_AT_ONCE = 64, 512, 32, 2048


def far_apart(left: list[str], right: list[str], similarity: float) -> np.ndarray:
    """Pairs of texts that certainly differ in more edits than ``similarity`` allows; of the others nothing is said.

    Each piece of the left text needs as many edits as it differs from what is nearest to it in the right one, as far away as
    all the edits allow.  Myers' algorithm, a column of all tables at once; characters count as equal if their last five bits are.
    """
    size = [np.array([len(t) for t in texts], np.int64) for texts in (left, right)]
    flat = [np.append((np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4") & 31).astype(np.uint8), np.uint8(32)) for texts in (left, right)]
    start = [np.cumsum(n) - n for n in size]
    most = ((1 - similarity) * np.maximum(*size) + 1e-9).astype(np.int64)
    total, pieces = np.zeros(len(left), np.int64), size[0] // _PIECE
    order = np.flatnonzero((most <= _PIECE_EDITS) & (pieces > 0))
    order = order[np.argsort(most[order], kind="stable")]
    for at in range(0, len(order), _PIECES_AT_ONCE):
        some, p = order[at : at + _PIECES_AT_ONCE], 0
        while True:
            some = some[(total[some] <= most[some]) & (total[some] + (pieces[some] - p) * _PIECE > most[some])]
            if len(some) < _PIECE_PAIRS:
                break
            piece = flat[0][start[0][some][:, None] + p * _PIECE + np.arange(_PIECE)]
            place = p * _PIECE - most[some] + np.arange(_PIECE + 2 * int(most[some].max()))[:, None]
            window = flat[1][np.where((place >= 0) & (place < size[1][some]) & (place < (p + 1) * _PIECE + most[some]), start[1][some] + place, -1)]
            total[some] += _nearest(piece, window)
            p += 1
    return total > most


def _nearest(piece: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The least edits of each piece (a row) against any part of its window (a column)."""
    n = len(piece)
    masks, each = np.zeros((n, 33), np.uint64), np.arange(n)
    for k in range(_PIECE):
        masks[each, piece[:, k]] |= np.uint64(1 << k)
    masks[:, 32] = 0
    masks, base = masks.ravel(), each * 33
    plus, minus = np.full(n, 2**64 - 1, np.uint64), np.zeros(n, np.uint64)
    score = np.full(n, _PIECE, np.int64)
    least, one, top = score.copy(), np.uint64(1), np.uint64(63)
    for row in window:
        eq = masks[base + row]
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(diagonal | plus), plus & diagonal
        score += (up >> top).astype(np.int64)
        score -= (down >> top).astype(np.int64)
        np.minimum(least, score, out=least)
        vertical = eq | minus
        up <<= one
        plus, minus = down << one | ~(vertical | up), up & vertical
    return least


def all_alike(left: list[str], right: list[str], similarity: float) -> list[bool]:
    far = far_apart(left, right, similarity).tolist()
    return [not no and alike(a, b, similarity) for a, b, no in zip(left, right, far, strict=True)]


def alike(left: str, right: str, similarity: float) -> bool:
    most = int((1 - similarity) * max(len(left), len(right)) + 1e-9)
    if left == right or aligned_edits(left.split(" "), right.split(" "), most) <= most:
        return True
    at = _common_start(left, right)
    left, right = left[at:], right[at:]
    stop = _common_start(left[::-1], right[::-1])
    left, right = left[: len(left) - stop], right[: len(right) - stop]
    return max(len(left), len(right)) <= most or distance_within(left, right, most)


def verified(docs: DataFrame, lines: DataFrame, pairs: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Of promising pairs ``(a, b, sure)`` of lines those ``(u, v)`` whose edit similarity is large enough."""
    pairs = scratch.keep(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "sure").distinct(), "line-pairs")
    known, pairs = pairs.where("sure").select("u", "v"), pairs.where("not sure").select("u", "v")
    if pairs.isEmpty():
        return known
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("line")).distinct()
    texts = texts_of(docs, lines, wanted, scratch)
    both = pairs.join(texts.select(F.col("line").alias("u"), F.col("text").alias("left")), "u").join(texts.select(F.col("line").alias("v"), F.col("text").alias("right")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                near = all_alike(part.column(2).to_pylist(), part.column(3).to_pylist(), similarity)
                yield part.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    return known.unionByName(scratch.keep(both.select("u", "v", "left", "right").mapInArrow(tidied(run), "u long, v long"), "line-links"))


def _labelled(rows: DataFrame, vertex: str, components: DataFrame, name: str) -> DataFrame:
    """``rows`` with the component of a line, or the line itself, as a further column."""
    known = components.select(F.col("vertex").alias(vertex), F.col("component").alias("known"))
    return rows.join(known, vertex, "left").withColumn(name, F.coalesce("known", vertex)).drop("known")


def _merged(components: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after more links: those of the links between components, one after the other."""
    between = _labelled(_labelled(links, "u", components, "cu"), "v", components, "cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    above = connected_components(between, "lines")
    old = components.withColumnRenamed("component", "through").join(above.select(F.col("vertex").alias("through"), F.col("component").alias("top")), "through", "left")
    old = old.select("vertex", F.coalesce("top", "through").alias("component"))
    return scratch.keep(old.unionByName(above.join(components, "vertex", "left_anti")), "line-components")


def groups(docs: DataFrame, lines: DataFrame, similarity: float, scratch: Scratch, pairs: int = PAIRS) -> DataFrame:
    """``(vertex, component)`` of the lines that are linked to another one."""
    members = scratch.keep(bucketed(lines), "line-buckets")
    led = members.where(F.col("line") != F.col("leader")).select(F.col("line").alias("a"), F.col("leader").alias("b"))
    signed = scratch.keep(signatures(lines), "line-signatures")
    to_leader = promising_pairs(signed, led, similarity)
    components = scratch.keep(connected_components(verified(docs, lines, to_leader, similarity, scratch), "lines"), "line-components")
    # two lines are a pair already
    placed = scratch.keep(_labelled(_labelled(members.where("size > 2"), "line", components, "own"), "leader", components, "led").select("key", "line", "own", "led", "size"), "line-placed")
    apart = scratch.keep(placed.where("own <> led").groupBy("key").agg(F.count(F.lit(1)).alias("apart")), "line-apart")
    if apart.isEmpty():
        return components
    placed = placed.join(_bounded(apart), "key").withColumn("many", F.col("apart") * F.col("size") > pairs)
    # promising lines agree in one more hash at least of the kind that their bucket is made of
    dealt = placed.where("not many").select("key", "line", "own", "led").unionByName(divided(placed.where("many"), lines).select("key", "line", "own", "led"))
    found = scratch.keep(pairs_within(dealt.join(signed, "line"), similarity), "line-met")
    links = found.where("sure").select(F.col("a").alias("u"), F.col("b").alias("v"))
    met = found.where("not sure").withColumnRenamed("a", "line").drop("b", "sure")
    if not met.isEmpty():
        texts = texts_of(docs, lines, met.select("line").distinct(), scratch)
        links = links.unionByName(scratch.keep(read_within(met.join(texts, "line"), similarity), "line-links"))
    return _merged(components, links, scratch)


def removals(docs: DataFrame, similarity: float = SIMILARITY, pairs: int = PAIRS) -> DataFrame:
    """``(d, t, gone array<int>)``: places of the lines that go, for each document that loses any."""
    scratch = Scratch(docs.sparkSession)
    lines = scratch.keep(distinct_lines(docs), "line-distinct")
    linked = groups(docs, lines, similarity, scratch, pairs)
    # a line that occurs once and is linked to none needs no decision
    lines = lines.select("line", "tag", "first", "n")
    alone = lines.where("n = 1").join(linked, lines.line == linked.vertex, "left_semi").unionByName(lines.where("n > 1"))
    grouped = scratch.keep(_labelled(alone, "line", linked, "component"), "line-grouped")
    keepers = grouped.groupBy("component").agg(F.min("first").alias("keeper"))
    kept_d, kept_pos = _place_columns("keeper")
    decided = grouped.select("line", "tag", "component").join(keepers.select("component", kept_d.alias("kept_d"), kept_pos.alias("kept_pos")), "component").drop("component")
    decided = _bounded(scratch.keep(decided, "line-decided"))
    going = occurrences(docs, False).join(decided, ["line", "tag"]).where(~((F.col("d") == F.col("kept_d")) & (F.col("pos") == F.col("kept_pos"))))
    gone = materialise(going.groupBy("d", "t").agg(F.collect_set("pos").alias("gone")), "line-gone")
    scratch.clear()
    return gone


def _apply(docs: DataFrame, similarity: float, pairs: int) -> DataFrame:
    """Each row of ``docs`` as struct ``row`` with its lines and those that stay."""
    gone = removals(docs, similarity, pairs)
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    rows = whole.withColumn("d", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_LAST))).withColumn("t", F.xxhash64("row.text"))
    if (gone.agg(F.sum(F.size("gone") + 4)).first()[0] or 0) <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    joined = rows.join(gone, ["d", "t"], "left").withColumn("lines", F.split("row.text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return joined.withColumn("stay", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i))))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, pairs: int = PAIRS) -> DataFrame:
    """Every document without its repeated lines: doc_id, n_lines, n_removed, text."""
    out = _apply(docs, similarity, pairs)
    n = F.coalesce(F.size("lines"), F.lit(0))
    n = F.when(F.col("row.text").isNull(), 0).otherwise(n)
    removed = F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines") - F.size("stay"))
    return out.select(F.col("row.doc_id").alias("doc_id"), n.cast("int").alias("n_lines"), removed.cast("int").alias("n_removed"), F.array_join("stay", "\n").alias("text"))


def keep_first_lines(docs: DataFrame, similarity: float = SIMILARITY, pairs: int = PAIRS) -> DataFrame:
    """``documents`` with the remaining text (n_chars counted anew) and all other columns as they were."""
    out = _apply(docs, similarity, pairs).withColumn("kept", F.array_join("stay", "\n"))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
