import math
import zlib

import numpy as np
import pytest

from deltaframe.llm import quality


def test_features_are_finite():
    for text in (None, "", " \n ", "a", "é" * 10, "x " * 50_000, "word\n" * 3, "\x00"):
        row = quality.features(text)
        assert len(row) == len(quality.FEATURES)
        assert np.isfinite(row).all()


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    rows = rng.random((4000, 3))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(int)
    model = quality.fit(rows[:3000], labels[:3000])
    assert ((model.score(rows[3000:]) > 0.5) == labels[3000:]).mean() > 0.95
    alone = quality.fit(rows[:3000], labels[:3000], quality.Settings(pairs=0))
    assert ((alone.score(rows[3000:]) > 0.5) == labels[3000:]).mean() < 0.75


def test_fit_does_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(2)
    rows = rng.random((500, 4)).round(1)
    labels = (rows[:, 0] + rng.random(500) > 1).astype(int)
    order = rng.permutation(500)
    assert np.allclose(quality.fit(rows, labels).score(rows), quality.fit(rows[order], labels[order]).score(rows))


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([1, 1], 0.999), ([0], 0.001)])
def test_one_class_or_none(labels, score):
    model = quality.fit(np.zeros((len(labels), len(quality.FEATURES))), np.array(labels, dtype=float))
    assert model.score(np.zeros((1, len(quality.FEATURES))))[0] == pytest.approx(score)


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    assert len(got) == docs.count()
    right = []
    for row in labels.collect():
        out = got[row.doc_id]
        assert out.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= out.score <= 1
        assert out.predicted == (out.score >= 0.7)
        if out.held_out:
            right.append(out.predicted == row.quality)
    assert np.mean(right) > 0.97


def test_nulls_repeats_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"
    rows = [(1, "the cat is on the mat", None, None, None, 1.0, 1), (1, "the cat is on the mat", None, None, None, 1.0, 1), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == 3
    assert all(r.held_out is not None and r.score is not None for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns
    nothing = spark.createDataFrame([], schema)
    assert quality.scored(nothing, labels).collect() == []
    assert quality.scored(docs, spark.createDataFrame([], labels.schema)).count() == 3


def plain_fit(rows, labels, s):
    """The same boosting in loops over rows, bins and cuts; gives a function that scores a row."""
    order = sorted(range(len(rows)), key=lambda i: (labels[i], *rows[i][::-1]))
    rows, labels = [rows[i] for i in order], [float(labels[i]) for i in order]
    wide = range(len(rows[0]))
    share = sum(labels) / len(labels)
    base = math.log(share / (1 - share))

    def cuts(j, most):
        values = sorted(r[j] for r in rows)
        at = [values[math.floor(k / most * (len(values) - 1) + 1e-12)] for k in range(1, most)]
        return sorted({x for x in at if x > values[0]})

    bin_of = lambda x, cut: sum(x >= c for c in cut)
    fine, coarse = [cuts(j, s.bins) for j in wide], [cuts(j, s.pair_bins) for j in wide]
    tables = [[0.0] * (len(c) + 1) for c in fine]
    total = [base] * len(rows)
    gain = lambda g, h: g * g / (h + s.smoothing)

    def slopes():
        ps = [1 / (1 + math.exp(-t)) for t in total]
        return [y - p for y, p in zip(labels, ps, strict=True)], [p * (1 - p) for p in ps]

    def best(g, h, n, a, b):
        found = (0.0, None)
        for c in range(a + 1, b):
            if min(sum(n[a:c]), sum(n[c:b])) >= s.least_rows:
                x = gain(sum(g[a:c]), sum(h[a:c])) + gain(sum(g[c:b]), sum(h[c:b])) - gain(sum(g[a:b]), sum(h[a:b]))
                if x > found[0] + 1e-12 and x > 1e-9:
                    found = (x, c)
        return found

    for _ in range(s.rounds):
        for j in wide:
            gs, hs = slopes()
            k = len(tables[j])
            bins = [bin_of(r[j], fine[j]) for r in rows]
            g, h, n = ([sum(x for x, b in zip(xs, bins, strict=True) if b == i) for i in range(k)] for xs in (gs, hs, [1] * len(rows)))
            parts = [(0, k)]
            for _ in range(2):
                x, c, part = max(((*best(g, h, n, *p), p) for p in parts), key=lambda f: f[0])
                if c is None:
                    break
                parts.remove(part)
                parts += [(part[0], c), (c, part[1])]
            for a, b in parts:
                for i in range(a, b):
                    tables[j][i] += s.rate * sum(g[a:b]) / (sum(h[a:b]) + s.smoothing)
            for r, i in enumerate(bins):
                a, b = next(p for p in parts if p[0] <= i < p[1])
                total[r] += s.rate * sum(g[a:b]) / (sum(h[a:b]) + s.smoothing)

    def cross(a, b):
        gs, hs = slopes()
        spots = [(bin_of(r[a], coarse[a]), bin_of(r[b], coarse[b])) for r in rows]
        found = (-math.inf, None)
        for i in range(1, len(coarse[a]) + 1):
            for j in range(1, len(coarse[b]) + 1):
                quarters = {}
                for (x, y), g, h in zip(spots, gs, hs, strict=True):
                    q = quarters.setdefault((x >= i, y >= j), [0.0, 0.0])
                    q[0], q[1] = q[0] + g, q[1] + h
                value = sum(gain(*q) for q in quarters.values())
                if value > found[0] + 1e-12:
                    found = (value, (i, j, {k: g / (h + s.smoothing) for k, (g, h) in quarters.items()}))
        return found[0] - gain(sum(gs), sum(hs)), found[1], spots

    ranked = sorted(((cross(a, b)[0], a, b) for a in wide for b in wide if a < b), key=lambda x: (-x[0], x[1:]))
    pairs = [(a, b, {}) for x, a, b in ranked[: s.pairs] if x > 0]
    for _ in range(s.pair_rounds):
        for a, b, lookup in pairs:
            _, (i, j, value), spots = cross(a, b)
            for x in range(len(coarse[a]) + 1):
                for y in range(len(coarse[b]) + 1):
                    lookup[x, y] = lookup.get((x, y), 0.0) + s.rate * value.get((x >= i, y >= j), 0.0)
            for r, (x, y) in enumerate(spots):
                total[r] += s.rate * value.get((x >= i, y >= j), 0.0)

    def score(row):
        t = base + sum(tables[j][bin_of(row[j], fine[j])] for j in wide)
        t += sum(lookup[bin_of(row[a], coarse[a]), bin_of(row[b], coarse[b])] for a, b, lookup in pairs)
        return 1 / (1 + math.exp(-t))

    return score


def test_fit_and_score_against_loops():
    rng = np.random.default_rng(5)
    rows = np.round(rng.normal(size=(160, 3)), 1)
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.3)).astype(int)
    settings = quality.Settings(bins=8, pair_bins=4, rounds=4, pair_rounds=3, pairs=2, least_rows=5, rate=0.3)
    model = quality.fit(rows, labels, settings)
    assert len(model.pairs) == 2
    plain = plain_fit(rows.tolist(), labels.tolist(), settings)
    new = np.round(rng.normal(size=(60, 3)), 1)
    assert np.allclose(model.score(new), [plain(r) for r in new.tolist()], atol=1e-9)


def test_features_made_after_junk_are_not_needed():
    """Without the shares of bars and of odd word ends, held-out labels are told nearly as well."""
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    kept = [d for d in docs if labels.get(d["doc_id"]) is not None]
    rows = np.array([quality.features(d["text"]) for d in kept])
    rows[:, [quality.FEATURES.index("pipes"), quality.FEATURES.index("odd_ends")]] = 0
    truth = np.array([labels[d["doc_id"]] for d in kept])
    out = np.array([zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2 for d in kept])
    score = quality.fit(rows[~out], truth[~out]).score(rows[out])
    assert ((score >= 0.7) == truth[out]).mean() >= 0.95
