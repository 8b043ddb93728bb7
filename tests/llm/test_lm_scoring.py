import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from deltaframe.llm import lm_scoring as M

VOCABULARY = "the of cat dog runs sat by sea ON mat Red blue green élan İx".split()


def make_rows(seed, n):
    rng = random.Random(seed)
    phrases = [rng.choices(VOCABULARY, k=6) for _ in range(10)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(1, 9)) for w in rng.choice(phrases)) + rng.choice(["", " new%d" % i, "\x0b\n x"])) for i in range(n)]
    return [*rows, (900, None), (901, ""), (902, " \t"), (903, "word " * 3000), (3, "the cat"), (3, "the cat"), (None, "the of")]


def tokens(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "<end>"]


def held_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 1


def plain(rows):
    """The model in dictionaries; weights of the interpolation by the same rule, from exact counts."""
    train = [tokens(t) for k, t in rows if not held_out(k)]
    words = Counter(w for ts in train for w in ts)
    pairs = Counter(p for ts in train for p in zip(ts, ts[1:], strict=False))
    total, distinct = sum(words.values()), len(words)
    p0 = lambda w: (words[w] + 0.5) / (total + 0.5 * (distinct + 1))
    which = lambda h: min(M.BINS - 1, int(math.log2(words[h])))
    fit = {}
    for (h, w), c in pairs.items():
        b = which(h)
        about = 2 ** (int(4 * math.log2(words[h])) / 4)
        base = 2 ** (-int(-4 * math.log2(p0(w))) / 4)
        row = fit.setdefault(b, [0.0] * len(M.WEIGHTS))
        for k, x in enumerate(M.WEIGHTS):
            row[k] += c * math.log(x * min(1, (c - 1) / max(1, about - 1)) + (1 - x) * base)
    weight = {b: M.WEIGHTS[int(np.argmax(r))] for b, r in fit.items()}
    out = []
    for k, t in rows:
        ts = tokens(t)
        score = math.log10(p0(ts[0]))
        for h, w in zip(ts, ts[1:], strict=False):
            x = weight[which(h)] if words[h] else 0.0
            score += math.log10((x * pairs[h, w] / words[h] if words[h] else 0) + (1 - x) * p0(w))
        out.append((k, held_out(k), len(ts), sum(words[w] > 0 for w in ts), total, sum(math.log10(p0(w)) for w in ts), score))
    return out


@pytest.mark.parametrize("part_bytes", [200, 1 << 20])
def test_against_dictionaries(spark, part_bytes):
    rows = make_rows(4, 120)
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, score int, part string")
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted(map(tuple, M.scores(docs, part_bytes=part_bytes).collect()), key=key)
    for a, b in zip(got, sorted(plain(rows), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_better_than_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in M.scores(docs).collect() if r.held_out]
    assert len(rows) > 100
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_counts_in_bytes():
    for counts in ([], [0], [254, 255, 256, 0, 10**15, 1]):
        packed = M.shrink(np.array(counts, np.int64))
        assert M.grow(b"head" * 2 + packed, 8).tolist() == counts


def test_empty_table(spark):
    assert M.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_only_held_out_texts(spark):
    key = next(k for k in range(100) if held_out(k))
    row = M.scores(spark.createDataFrame([(key, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0)
    assert row.base_score == row.score == 0.0
