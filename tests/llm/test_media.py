import numpy as np
import pytest

from deltaframe.llm import media as M


def picture(seed, n=64):
    return M.draw(np.random.default_rng(seed).normal(size=n).tolist())


def test_png_round_trip_and_filters():
    import struct
    import zlib

    grey = picture(1)
    assert (M.decode(M.encode_png(grey)) == grey).all()
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    flat = pixels.reshape(9, 21).astype(int)
    rows, above = [], np.zeros(21, int)
    for y in range(9):
        kind, line = y % 5, flat[y]
        a = np.concatenate(([0] * 3, line[:-3]))
        c = np.concatenate(([0] * 3, above[:-3]))
        p = a + above - c
        paeth = np.where((abs(p - a) <= abs(p - above)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - above) <= abs(p - c), above, c))
        guess = [0, a, above, (a + above) // 2, paeth][kind]
        rows.append(bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes())
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    png = M._PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (M.decode(png) == np.round(pixels @ np.array([0.299, 0.587, 0.114]))).all()
    assert (M.decode(b"P5\n3 2\n255\nabcdef") == np.array([[97, 98, 99], [100, 101, 102]])).all()
    assert (M.decode(b"P6 1 1 255 \xff\xff\xff") == 255).all()


@pytest.mark.parametrize("raw", [None, b"", b"no image", M._PNG, M._PNG + b"\0" * 40, b"P5 0 0 255 ", b"P5 x", M.encode_png(np.zeros((4, 4), np.uint8))[:50]])
def test_odd_cells(raw):
    assert M.describe(M.decode(raw)) == []


def test_flat_small_and_large_images():
    assert M.describe(np.full((60, 60), 7, np.uint8)) == []
    assert M.describe(np.zeros((3, 500), np.uint8)) == []
    assert len(M.describe(np.random.default_rng(0).integers(0, 255, (400, 300), dtype=np.uint8))) == M.CORNERS


def test_half_size_copy():
    grey = picture(5)
    grey = np.kron(grey, np.ones((2, 2))).astype(np.uint8)  # a smooth image at twice the size
    small = grey[::2, ::2]
    pairs = [(*a[:4], *b[:4]) for a in M.describe(small) for b in M.describe(grey) if sum((a[4 + i] ^ b[4 + i]).bit_count() for i in range(3)) <= M.MOST_BITS]
    inliers, _, scale, _, _ = M.consensus(np.array(pairs))
    assert inliers >= M.LEAST_INLIERS
    assert scale == pytest.approx(2)


def test_search_against_brute_force(spark):
    n = 260
    rows = [(i, np.random.default_rng(i % 230).normal(size=64).tolist(), i, "x") for i in range(n)] + [(300, None, 1, "x"), (301, [], 1, "x"), (302, [None, 1.0], 1, "x"), (None, [1.0], 1, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, class_id string")
    got = M.vector_images(vectors).collect()
    members = {r.vec_id: (r.class_id, r.members) for r in got if r.kind == "member"}
    assert len(members) == len(rows)
    assert all(members[i] == (i % 230, 2 if i < 30 or i >= 230 else 1) for i in range(n))
    found = {(r.vec_id, r.class_id) for r in got if r.kind == "match"}
    images = {i: M.describe(picture(i)) for i in range(230)}
    want = set()
    for q in range(0, n, 20):
        query = M.describe(M.edit(picture(q % 230), q))
        for i, image in images.items():
            pairs = {(*a[:4], *b[:4]) for a in query for b in image if sum((a[4 + k] ^ b[4 + k]).bit_count() for k in range(3)) <= M.MOST_BITS}
            if len(pairs) >= M.LEAST_INLIERS and M.consensus(np.array(sorted(pairs)))[0] >= M.LEAST_INLIERS:
                want.add((q, i))
    true = {(q, q % 230) for q in range(0, n, 20)}
    assert len(true & want) / len(true) >= 0.9
    assert len(found & want) / len(want) >= 0.9
    assert len(found & true) / len(true) >= 0.9
    assert len(found - true) <= 1


def test_empty_and_null_images(spark):
    images = spark.createDataFrame([(1, None), (2, b"junk"), (3, b"junk"), (None, None)], "k long, image binary")
    got = sorted(((r.k, r.class_id, r.members) for r in M.find_copies(images, images, "k", "image").collect()), key=str)
    assert got == sorted([(1, None, None), (2, 2, 2), (3, 2, 2), (None, None, None)], key=str)
    assert M.find_copies(images.limit(0), images.limit(0), "k", "image").collect() == []


def test_small_crops_of_large_images(spark):
    """Crops that hold few of the strongest corners, some noisy or of half the size."""
    rng = np.random.default_rng(12)
    large = {i: (lambda z: np.clip(110 + 90 * z / np.abs(z).max(), 0, 255))(M._box(M._box(rng.normal(size=(320, 320)), 1), 1)) for i in range(6)}
    asked = {}
    for i, grey in large.items():
        y, x = rng.integers(0, 190, 2)
        asked[i] = grey[y : y + 64, x : x + 64]
        asked[10 + i] = grey[y : y + 64, x : x + 64] + rng.normal(0, 2, (64, 64))
        asked[20 + i] = grey[y : y + 128, x : x + 128].reshape(64, 2, 64, 2).mean((1, 3))
    png = lambda cells: [(i, bytearray(M.encode_png(np.clip(g, 0, 255).astype(np.uint8)))) for i, g in cells.items()]
    frame = lambda cells: spark.createDataFrame(png(cells), "k long, image binary")
    found = {(r.k, r.class_id) for r in M.find_copies(frame(large), frame(asked), "k", "image").collect() if r.kind == "match"}
    true = {(q, q % 10) for q in asked}
    kinds = [sum((k + i, i) in found for i in range(6)) for k in (0, 10, 20)]
    assert kinds[0] >= 5 and kinds[1] >= 5, kinds
    assert kinds[2] >= 3, kinds  # brute force finds all of half the size
    assert len(found - true) <= 1


def test_matches_by_chance_are_no_rows(spark):
    """Whole images are held against blocks of queries: no plan joins descriptors, whatever the number of blocks."""
    rows = [(i, bytearray(M.encode_png(picture(i % 40)))) for i in range(60)]
    asked = [(i, bytearray(M.encode_png(M.edit(picture(i), i)))) for i in range(0, 40, 4)]
    frame = lambda cells: spark.createDataFrame(cells, "key long, image binary")
    images, queries = (M.corners(frame(x), "key", "image").cache() for x in (rows, asked))
    assert images.count() == 60
    one, many = (M.search(queries, images, block_corners=n) for n in (M.BLOCK_CORNERS, 60))
    assert "Join" not in one._jdf.queryExecution().toString()
    got = sorted(map(tuple, one.collect()))
    assert {(r[0], r[1]) for r in got} >= {(q, q) for q, _ in asked}
    assert got == sorted(map(tuple, many.collect()))
    # as all pairs of corners that share an entry give it
    want = set()
    for q, raw in asked:
        mine = M.describe(M.decode(bytes(raw)), None)
        for i, other in rows:
            theirs = M.describe(M.decode(bytes(other)), None)
            entries = [M.table_entries(np.array([c[4:] for c in side])) for side in (mine, theirs)]
            shared = (entries[0][:, None] == entries[1][None]).any(2)
            near = np.bitwise_count(np.array([c[4:] for c in mine])[:, None] ^ np.array([c[4:] for c in theirs])[None]).sum(2) <= M.MOST_BITS
            pairs = {(*mine[a][:4], *theirs[b][:4]) for a, b in zip(*np.nonzero(shared & near), strict=True)}
            if len(pairs) >= M.LEAST_INLIERS and M.consensus(np.array(sorted(pairs)))[0] >= M.LEAST_INLIERS:
                want.add((q, i))
    assert {(r[0], r[1]) for r in got} == want
