"""Language-model scores of texts by a weighted backoff automaton.

The model is a bigram model of words, interpolated with the additively smoothed
unigram model; the weight of the interpolation depends on how often the history
occurs (one weight for each power of two) and is the one under which the training
text, each token held out of its own counts, is likeliest.

Counts cover all training texts.  Texts stay in parts (see ``scatter``): a part
asks for the counts of the words and bigrams it holds, gets them back, and so
builds the part of the automaton that its own texts can reach.  A state is a
history; an arc carries the log-probability of a seen continuation; a failure arc
carries the backoff weight and leads to the shorter history.  All documents of a
part are read from left to right at once, each carrying its state.

Words are known by XXH64; bigrams by their bucket and 48 further bits of a hash.

Cases: a null or empty text is one end token; equal rows all count; rows with a
null id belong to the training text; an empty table gives an empty result, and
without any training text all words are equally unknown; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scatter

END = b" "  # no word holds a space
#: Weights that the interpolation may take, and bins of histories by the power of two of their count.
WEIGHTS = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97])
BINS = 40
_U = np.uint64


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Texts:
    """A part's documents as token numbers: every word, then one end."""

    def __init__(self, rows: pa.Table) -> None:
        self.part = rows.column("part")[0].as_py()
        keys, self.null, texts = scatter.documents_of(rows)
        self.keys = keys
        names = ["" if null else str(k) for k, null in zip(keys.tolist(), self.null.tolist(), strict=True)]
        self.held_out = np.array([not null and _held_out(n) for n, null in zip(names, self.null.tolist(), strict=True)], bool)
        numbers = _Numbers({END: 0})
        number = numbers.__getitem__
        tokens = []
        for text in texts:
            words = text.lower().split()
            words.append(END)
            tokens.append(np.fromiter(map(number, words), np.int32, len(words)))
        self.size = np.array([len(t) for t in tokens])
        self.start = np.cumsum(self.size) - self.size
        self.tokens = np.concatenate(tokens)
        self.trained = np.repeat(~self.held_out, self.size)
        self.names = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), _U, len(numbers))
        self.order = np.argsort(self.names)  # words as they are asked for

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigrams, in the order in which they are asked for: histories, words, names, training counts."""
        follows = np.ones(len(self.tokens), bool)
        follows[self.start] = False
        at = np.flatnonzero(follows)
        code = self.tokens[at - 1].astype(np.int64) * len(self.names) + self.tokens[at]
        known, inverse = np.unique(code, return_inverse=True)
        counts = np.bincount(inverse, self.trained[at], len(known)).astype(np.int64)
        history, word = known // len(self.names), known % len(self.names)
        h = self.names[history] * _U(0x9E3779B97F4A7C15) ^ self.names[word]
        h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
        h ^= h >> _U(32)
        order = np.argsort(h)
        return history[order], word[order], h[order], counts[order]


def _held_out(name: str) -> bool:
    import zlib

    return zlib.crc32(name.encode()) % 5 == 1


def _spread(names: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets within sorted names."""
    return np.searchsorted((names >> _U(32)) * _U(buckets) >> _U(32), np.arange(buckets + 1, dtype=_U))


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(arrays[0])], "<i8").tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def shrink(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more follow in full."""
    large = counts[counts >= 255]
    return np.array([len(counts), len(large)], "<i8").tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype("<i8").tobytes()


def grow(data: bytes, at: int = 0) -> np.ndarray:
    """The counts that ``shrink`` packed, from place ``at`` on."""
    n, large = np.frombuffer(data, "<i8", 2, at).tolist()
    out = np.frombuffer(data, np.uint8, n, at + 16).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", large, at + 16 + n)
    return out


# -- words -------------------------------------------------------------------------------------------


def ask_words(rows: pa.Table, buckets: int) -> pa.Table:
    texts = Texts(rows)
    counts = np.bincount(texts.tokens, texts.trained, len(texts.names)).astype(np.int64)[texts.order]
    names = texts.names[texts.order]
    cut = _spread(names, buckets)
    return scatter.messages((texts.part, b, _pack(names[cut[b] : cut[b + 1]]) + shrink(counts[cut[b] : cut[b + 1]])) for b in range(buckets))


def _totals(names: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct names, their summed counts, and by sender the place of each of its names."""
    known, inverse = np.unique(np.concatenate(names), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, inverse, np.concatenate(counts))
    return known, total, np.split(inverse, np.cumsum([len(x) for x in names])[:-1])


def count_words(rows: pa.Table) -> pa.Table:
    """Answers: training tokens and distinct training words of the bucket, then a count for each word asked for."""
    sent = rows.column("data").to_pylist()
    names = [np.frombuffer(x, "<u8", int(np.frombuffer(x, "<i8", 1)[0]), 8) for x in sent]
    _, total, places = _totals(names, [grow(x, 8 + n.nbytes) for x, n in zip(sent, names, strict=True)])
    sums = np.array([total.sum(), np.count_nonzero(total)], "<i8")
    return scatter.messages((p, b, sums.tobytes() + shrink(total[at])) for p, b, at in zip(*_senders(rows), places, strict=True))


def _senders(rows: pa.Table) -> tuple[list[int], list[int]]:
    return rows.column("part").to_pylist(), rows.column("bucket").to_pylist()


class Unigrams:
    """What a part knows of its words: counts by word number, training tokens, distinct training words, probabilities."""

    def __init__(self, texts: Texts, answers: dict[int, bytes]) -> None:
        heads = [np.frombuffer(answers[b], "<i8", 2) for b in sorted(answers)]
        self.tokens, self.distinct = (int(x) for x in np.sum(heads, axis=0))
        self.counts = np.zeros(len(texts.names), np.int64)
        self.counts[texts.order] = np.concatenate([grow(answers[b], 16) for b in sorted(answers)])
        self.p = (self.counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))


# -- bigrams -----------------------------------------------------------------------------------------


def ask_pairs(rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    if not rows.num_rows:
        return scatter.messages(())
    texts = Texts(rows)
    words = Unigrams(texts, dict(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True)))
    history, word, names, counts = texts.pairs()
    # of the history its count and of the word its probability, in quarters of a power of two: enough to choose weights by
    often = np.clip(4 * np.log2(np.maximum(1, words.counts)), 0, 4 * BINS - 1).astype(np.uint8)[history]
    rare = np.clip(-4 * np.log2(words.p), 0, 255).astype(np.uint8)[word]
    cut = _spread(names, buckets)

    def made() -> Iterator[tuple[int, int, bytes]]:
        for b in range(buckets):
            s = slice(cut[b], cut[b + 1])
            short = np.ascontiguousarray(names[s].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
            yield texts.part, b, _pack(short, often[s], rare[s]) + shrink(counts[s])

    return scatter.messages(made())


def _bin(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.minimum(BINS - 1, np.log2(np.maximum(1, counts)).astype(int)), 0)


def count_pairs(rows: pa.Table) -> pa.Table:
    """Answers: the bucket's log-likelihoods by bin and weight, then a count for each bigram asked for."""
    names, counts, often, rare = [], [], [], []
    for data in rows.column("data").to_pylist():
        n = int(np.frombuffer(data, "<i8", 1)[0])
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 8).reshape(n, 6)
        names.append(wide.view("<u8").ravel())
        often.append(np.frombuffer(data, np.uint8, n, 8 + 6 * n))
        rare.append(np.frombuffer(data, np.uint8, n, 8 + 7 * n))
        counts.append(grow(data, 8 + 8 * n))
    known, total, places = _totals(names, counts)
    of = np.zeros(len(known), np.int64)
    of[np.concatenate(places)] = np.arange(sum(map(len, names)))
    often, rare = (np.concatenate(x)[of] for x in (often, rare))
    seen = total > 0
    bins = often // 4
    left = (total - 1) / np.maximum(1, np.exp2(often / 4.0) - 1)
    base = np.exp2(rare / -4.0)
    fit = np.zeros((BINS, len(WEIGHTS)))
    for k, w in enumerate(WEIGHTS):
        gain = total * np.log(np.maximum(1e-300, w * np.minimum(1, left) + (1 - w) * base))
        fit[:, k] = np.bincount(bins[seen], gain[seen], BINS)
    head = fit.astype("<f8").tobytes()
    return scatter.messages((p, b, head + shrink(total[at])) for p, b, at in zip(*_senders(rows), places, strict=True))


# -- the automaton ---------------------------------------------------------------------------------------


class Automaton:
    """States 0 (no history) and 1 + w (after a known word w); arcs sorted by state and word."""

    def __init__(self, words: Unigrams, history: np.ndarray, word: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> None:
        n = self.words = len(words.counts)
        known = words.counts > 0
        self.root_weight = np.log10(words.p)
        self.next = np.where(known, np.arange(n) + 1, 0)
        self.next[0] = 0  # nothing follows an end
        weight = weights[_bin(words.counts)]
        self.fail_weight = np.concatenate(([0.0], np.log10(1 - weight)))
        self.fail_to = np.zeros(n + 1, np.int64)
        seen = (counts > 0) & known[history]
        h, w = history[seen], word[seen]
        key = (h + 1) * n + w
        order = np.argsort(key)
        self.arc = np.append(key[order], np.iinfo(np.int64).max)
        self.arc_weight = np.log10(weight[h] * counts[seen] / np.maximum(1, words.counts[h]) + (1 - weight[h]) * words.p[w])[order]

    def read(self, tokens: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log10 probability of each text: one traversal, a step for all texts at a time."""
        order = np.argsort(-size, kind="stable")
        start, ends = start[order], -size[order]
        total = np.zeros(len(size))
        state = np.zeros(len(size), np.int64)
        for step in range(int(size.max(initial=0))):
            live = int(np.searchsorted(ends, -step, side="left"))
            w = tokens[start[:live] + step]
            at = state[:live]
            todo = np.flatnonzero(at)
            while len(todo):  # arcs of the state, else the failure arc
                key = at[todo] * self.words + w[todo]
                arc = np.searchsorted(self.arc, key)
                hit = self.arc[arc] == key
                total[todo[hit]] += self.arc_weight[arc[hit]]
                at[todo[hit]] = -1
                todo = todo[~hit]
                total[todo] += self.fail_weight[at[todo]]
                at[todo] = self.fail_to[at[todo]]
                todo = todo[at[todo] > 0]
            root = np.flatnonzero(at == 0)
            total[root] += self.root_weight[w[root]]
            state[:live] = self.next[w]
        out = np.zeros(len(size))
        out[order] = total
        return out


SCHEMA = "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_KINDS = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())


def score_part(rows: pa.Table, answers: pa.Table) -> pa.Table:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    if not rows.num_rows:
        return pa.table([pa.array([], t) for t in _KINDS], names=names)
    texts = Texts(rows)
    told = dict(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True))
    words = Unigrams(texts, {-1 - b: x for b, x in told.items() if b < 0})
    pairs = [told[b] for b in sorted(b for b in told if b >= 0)]
    wide = BINS * len(WEIGHTS)
    fit = sum(np.frombuffer(x, "<f8", wide) for x in pairs).reshape(BINS, -1)
    # a bin without training text takes the least weight
    weights = WEIGHTS[np.where(fit.any(axis=1), fit.argmax(axis=1), 0)]
    history, word, _, _ = texts.pairs()
    counts = np.concatenate([grow(x, 8 * wide) for x in pairs])
    score = Automaton(words, history, word, counts, weights).read(texts.tokens, texts.start, texts.size)
    known = np.add.reduceat((words.counts > 0)[texts.tokens].astype(np.int64), texts.start)
    base = np.add.reduceat(np.log10(words.p)[texts.tokens], texts.start)
    n = len(texts.size)
    return pa.table(
        [pa.array(texts.keys, pa.int64(), mask=texts.null), pa.array(texts.held_out), pa.array(texts.size), pa.array(known), pa.array(np.full(n, words.tokens)), pa.array(base), pa.array(score)],
        schema=pa.schema(list(zip(names, _KINDS, strict=True))),
    )


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", part_bytes: int = scatter.PART_BYTES) -> DataFrame:
    """Every text's score under the model of the training texts, those whose crc32(key as text) mod 5 is not 1."""
    parts = scatter.deal(docs, key, text, part_bytes)
    buckets = parts.count
    words = scatter.answer(scatter.ask(parts, lambda rows: ask_words(rows, buckets)), count_words)
    asked = scatter.hear(parts, words, lambda rows, answers: ask_pairs(rows, answers, buckets), scatter.MESSAGE)
    pairs = scatter.answer(asked, count_pairs)
    again = words.select("part", (-1 - F.col("bucket")).alias("bucket"), "data")
    return scatter.hear(parts, pairs.unionByName(again), score_part, SCHEMA).withColumnRenamed("key", key)
