"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a few features.  Cyclic boosting visits the features in turn,
fits a tree of at most two cuts to the gradient on the feature's bins and adds it
to that feature's lookup table; afterwards the pairs that explain most of what is
left get tables of their own in the same way.  A score is the sum of table
entries, looked up for whole batches at once.

The model is fitted on the driver from a sample of at most ``FIT_ROWS`` labelled
rows, those of least hash of their id; only their features are gathered there.

Cases: a null text is an empty one and gets a score as well; a missing label
leaves a row out of the fit; without labelled rows of both classes the score is
the share of label 1 (0.5 without any); repeated labels of an id count once, the least label first;
rows with a null id are scored and are not held out; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_text import STOP_WORDS
from .shared import keep_rows, slices, tidied

#: Most labelled rows that a fit uses.
FIT_ROWS = 20_000

FEATURES = (
    "log_words word_length symbols upper digits stop_words distinct most_common repeats pair_repeats duplicate_lines line_words pipes "
    "sentence_words odd_ends non_ascii"
).split()

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_ASCII = bytes(range(128))
_SPACE = bytes([9, 10, 11, 12, 13, 32])
_PLAIN = _LETTERS + _DIGITS + _SPACE + b".,;:'-"
_PLAIN_ENDS = frozenset(b"%#$&*|!^~=+<>_@")


def features(text: str | None) -> list[float]:
    """The features of one whole text, in the order of FEATURES; all of them are finite."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    words = text.split()
    n = len(words)
    most = max(1, n)
    low = text.lower().split()
    counts = Counter(low)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(raw.count(x) for x in (b". ", b".\n", b"? ", b"! ")) + 1
    letters = max(1, size - len(raw.translate(None, _LETTERS)))
    return [
        np.log2(1 + n),
        sum(map(len, words)) / most,
        len(raw.translate(None, _PLAIN)) / size,
        (len(raw) - len(raw.translate(None, _UPPER))) / letters,
        (len(raw) - len(raw.translate(None, _DIGITS))) / size,
        sum(c for w, c in counts.items() if w in STOP_WORDS) / most,
        len(counts) / most,
        max(counts.values(), default=0) / most,
        sum(map(str.__eq__, low, low[1:])) / most,
        sum(map(str.__eq__, low, low[2:])) / most,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log2(1 + n / max(1, len(lines))),
        raw.count(b"|") / most,
        np.log2(1 + n / ends),
        sum(ord(w[-1]) in _PLAIN_ENDS for w in words) / most,
        len(raw.translate(None, _ASCII)) / size,
    ]


@dataclass(frozen=True)
class Settings:
    """Bounds of a fit."""

    bins: int = 48
    pair_bins: int = 12
    rounds: int = 240
    pair_rounds: int = 120
    pairs: int = 12
    rate: float = 0.08
    least_rows: int = 12
    smoothing: float = 2.0


@dataclass
class Model:
    """Intercept, cuts of each feature, its table, and tables of pairs over coarser cuts."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.intercept)
        for j, (cut, lookup) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += lookup[np.searchsorted(cut, rows[:, j], side="right")]
        used = {j for a, b, _ in self.pairs for j in (a, b)}
        bins = {j: np.searchsorted(self.coarse[j], rows[:, j], side="right") for j in used}
        for a, b, lookup in self.pairs:
            total += lookup[bins[a], bins[b]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _cuts(values: np.ndarray, most: int) -> np.ndarray:
    """Cut points between bins of about equal counts."""
    points = np.quantile(values, np.linspace(0, 1, most + 1)[1:-1], method="lower")
    return np.unique(points[points > values.min()])


def _gain(g: np.ndarray, h: np.ndarray, smoothing: float) -> np.ndarray:
    return g * g / (h + smoothing)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, s: Settings) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins; place 0: none."""
    cg, ch, cn = (np.cumsum(x)[:-1] for x in (g, h, n))
    if not len(cg):
        return 0.0, 0
    gain = _gain(cg, ch, s.smoothing) + _gain(g.sum() - cg, h.sum() - ch, s.smoothing) - _gain(g.sum(), h.sum(), s.smoothing)
    gain[(cn < s.least_rows) | (n.sum() - cn < s.least_rows)] = 0
    k = int(gain.argmax())
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Leaf values by bin of a tree with up to two cuts."""
    parts = [(0, len(g))]
    for _ in range(2):
        gain, part, cut = max(((*_best_cut(g[a:b], h[a:b], n[a:b], s)[:1], (a, b), a + _best_cut(g[a:b], h[a:b], n[a:b], s)[1]) for a, b in parts), key=lambda x: x[0])
        if gain <= 0:
            break
        parts.remove(part)
        parts += [(part[0], cut), (cut, part[1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + s.smoothing)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best cross of one cut in each of two features."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    row = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    corners = list(zip(row(cg), row(ch), strict=True))
    gain = sum(_gain(a, b, s.smoothing) for a, b in corners)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = [a[i, j] / (b[i, j] + s.smoothing) for a, b in corners]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j] - _gain(g.sum(), h.sum(), s.smoothing)), out


def fit(rows: np.ndarray, labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Fit by cyclic boosting with the logistic loss; always the same model for the same rows."""
    n = len(labels)
    share = labels.mean() if n else 0.5
    if n == 0 or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(float(np.log(share / (1 - share))))
    order = np.lexsort((*rows.T, labels))
    rows, labels = rows[order], labels[order].astype(float)
    wide = range(rows.shape[1])
    model = Model(float(np.log(share / (1 - share))), [_cuts(rows[:, j], s.bins) for j in wide])
    model.coarse = [_cuts(rows[:, j], s.pair_bins) for j in wide]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, rows[:, j], side="right") for j, c in enumerate(model.cuts)]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    total = np.full(n, model.intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(s.rounds):
        for j in wide:
            g, h = (np.bincount(bins[j], x, len(model.tables[j])) for x in slope())
            step = s.rate * _tree(g, h, counts[j], s)
            model.tables[j] += step
            total += step[bins[j]]
    coarse = [np.searchsorted(c, rows[:, j], side="right") for j, c in enumerate(model.coarse)]
    sizes = [len(c) + 1 for c in model.coarse]

    def crossed(a: int, b: int, x: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * sizes[b] + coarse[b], x, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slope()
    ranked = sorted(((_quadrants(crossed(a, b, g), crossed(a, b, h), s)[0], a, b) for a in wide for b in wide if a < b), key=lambda x: (-x[0], x[1:]))
    model.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for gain, a, b in ranked[: s.pairs] if gain > 0]
    for _ in range(s.pair_rounds):
        for a, b, lookup in model.pairs:
            g, h = slope()
            step = s.rate * _quadrants(crossed(a, b, g), crossed(a, b, h), s)[1]
            lookup += step
            total += step[coarse[a], coarse[b]]
    return model


def feature_rows(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """``(key, features array<double>)``, or with a model ``(key, score double)``.  No shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                rows = [features(t) for t in part.column(1).to_pylist()]
                if model is None:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["key", "features"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(np.array(rows)))], names=["key", "score"])

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return out.mapInArrow(tidied(run), f"key {kind}, " + ("score double" if model else "features array<double>")).withColumnRenamed("key", key)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, settings: Settings = Settings()) -> Model:
    """Fit on at most ``fit_rows`` labelled rows outside the held-out ones."""
    sample = (
        labels.select("doc_id", "quality")
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    # at most fit_rows ids and labels: a bounded broadcast
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    packed = picked.select(F.struct("doc_id", "label").alias("row"), "text")
    got = feature_rows(packed, "row", "text").select("row.label", "features").toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), settings)
    rows = got.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return fit(rows, got.column("label").to_numpy(), settings)


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Every document's score: doc_id, held_out, score, predicted."""
    model = train(docs, labels, fit_rows)
    return feature_rows(docs, "doc_id", "text", model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, least: float = 0.7) -> DataFrame:
    """The documents whose score reaches ``least``, with the columns of ``documents``."""
    model = train(docs, labels, fit_rows)

    def chooser() -> Callable[[list[str | None]], list[bool]]:
        return lambda texts: (model.score(np.array([features(t) for t in texts])) >= least).tolist()

    return keep_rows(docs, "text", chooser)
