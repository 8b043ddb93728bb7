import re

import numpy as np
import pytest
import xxhash

from deltaframe.llm import simhash


def plain_fingerprint(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, radius=2):
    label = list(range(len(prints)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    low = {}
    for i, k in enumerate(ids):
        low.setdefault(find(i), []).append(k)
    return [min((x for x in low[find(i)] if x is not None), default=None) for i in range(len(prints))]


TEXTS = [None, "", " \t\n", "One", "one TWO", "a b c", "A b c É d", "x " * 700, "the cat sat on the mat and so on " * 40, "é" * 999, "\x1c a \x85 b"]


def test_fingerprints():
    got = simhash.fingerprints([t if t is None else t.encode() for t in TEXTS])
    assert got.tolist() == [plain_fingerprint(t) for t in TEXTS]
    assert simhash.fingerprints([]).tolist() == []


def clustered_points(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, max(2, n // 20), dtype=np.uint64)
    points = centres[rng.integers(0, len(centres), n)]
    for _ in range(4):
        flip = rng.random(n) < 0.5
        points = np.where(flip, points ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), points)
    return np.unique(np.concatenate([points, [np.uint64(0), np.uint64(3)]]))


@pytest.mark.parametrize("seed", range(4))
def test_shard_walk_against_all_pairs(seed):
    points = clustered_points(seed, 600)
    root = simhash.shard_forest(points, np.ones(len(points), bool), 2, cell=256)
    want = plain_components(points.tolist(), list(range(len(points))))
    assert len(set(zip(root.tolist(), want, strict=True))) == len(set(want)) == len(set(root.tolist()))


@pytest.mark.parametrize("seed", range(3))
def test_router_reaches_every_neighbour(seed):
    points = clustered_points(seed + 10, 900)
    router = simhash.build_router(points[::2], 16)
    home = router.home(points)
    which, leaf = router.reached(points, 2)
    reached = set(zip(which.tolist(), leaf.tolist(), strict=True))
    near = np.argwhere(simhash.distance(points[:, None], points[None, :]) <= 2)
    assert all((a, home[b]) in reached for a, b in near.tolist())


def test_query_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    base = [" ".join(rng.choices("the of cat dog runs sat by sea on mat red blue".split(), k=60)) for _ in range(12)]
    texts = TEXTS + [" ".join(w if rng.random() > 0.01 else "zzz" for w in t.split()) for t in base for _ in range(12)]
    rows = [(i * 3 % 1000, t, "x", 1) for i, t in enumerate(texts)] + [(5, "a b c", "x", 1), (5, "a b c", "x", 1), (None, "q r s", "x", 1), (None, base[0], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = plain_components(prints, [r[0] for r in rows])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, want, strict=True)), key=key)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({c for c in want if c is not None})
    assert ids.count(None) == 2


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_long_chains(spark):
    from deltaframe.llm.shared import connected_components

    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7), (600, 601), (601, 602)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long"), "t").collect()))
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400, 600: 600, 601: 600, 602: 600}
