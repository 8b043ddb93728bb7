import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deltaframe.operators import copies, diff, make


def check(old, new):
    for addblk in (False, True):
        found = diff.segments(old, new, addblk)
        ints, exts = make._lists(found)
        literals = b"".join(new[n : n + size] for _, _, n, size in found)
        added = diff.difference(old, new, found) if addblk else None
        assert copies.rebuild(old, ints, exts, literals, added) == new
        assert sum(n for n, _ in ints) == len(exts)
        assert sum(size for _, size in ints) == len(literals)
        assert sum(size for _, size in exts) + len(literals) == len(new)
        off = 0
        for adj, size in exts:
            off += adj
            assert 0 <= off <= len(old) - size
            off += size
        # split copies keep the same meaning
        assert copies.rebuild(old, *make._lists(found, 7), literals, added) == new


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 31, 32, 33, 100, 4000])
def test_sizes(n):
    data = random.Random(n).randbytes(n)
    for other in (b"", data, data[::-1], bytes(n), data[: n // 2], data[n // 2 :] + data[: n // 2], b"x" + data, bytes(b ^ (i % 3 == 0) for i, b in enumerate(data)), bytes(b ^ 1 for b in data)):
        check(data, other)
        check(other, data)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300), st.lists(st.tuples(st.integers(0, 300), st.integers(0, 60), st.binary(max_size=30)), max_size=5))
def test_edits(old, edits):
    new = bytearray(old)
    for at, size, put in edits:
        new[at : at + size] = put
    check(old, bytes(new))
    check(old * 3, bytes(new))


def test_copies_are_found():
    data = random.Random(2).randbytes(5000)
    new = data[:2000] + b"something new" + data[2500:]
    found = diff.segments(data, new)
    assert found == [(0, 2000, 2000, 13), (2500, 2500, 4513, 0)]
    sparse = bytearray(data)
    for i in range(100, 5000, 50):
        sparse[i] ^= 255
    assert sum(s[3] for s in diff.segments(data, bytes(sparse), True)) < 200


def test_ties():
    same = np.array([True, False, True, False, False])
    assert diff.best_reach(same) == 3  # of lengths 1 and 3 with a score of 1 the last
    assert diff.best_reach(np.array([False, False])) == 0
    assert diff.best_split(np.array([True, True]), np.array([True, True])) == 0  # the first of equal splits


def test_suffix_search():
    old = b"banana bandana"
    order = diff.suffix_order(old)
    assert [old[i:] for i in order] == sorted(old[i:] for i in range(len(old)))
    offset, length = diff.longest_match(old, order, b"andante")
    assert (old[offset : offset + length], length) == (b"andan", 5)
    assert diff.longest_match(b"", diff.suffix_order(b""), b"x") == (0, 0)


def test_delta_rows_and_both_replays(spark):
    rng = random.Random(4)
    base = rng.randbytes(3000)
    rows = [(1, base, base), (2, base, base[1000:] + b"new" + base[:500]), (3, base, b""), (4, None, base[:50]), (5, base, base[2000:] + base[:900]), (6, b"", None)]
    pairs = spark.createDataFrame(rows, "pair_id long, old binary, new binary")
    made = copies.delta_rows(diff.diff_pairs(pairs))
    want = {r[0]: r[2] or b"" for r in rows}
    assert {r.pair_id: bytes(r.new) for r in copies.replay(pairs, made).collect()} == want
    assert {r.pair_id: bytes(r.new) for r in copies.replay_relational(pairs, made).collect()} == want
    for r in made.collect():
        assert sum(p.n_ext for p in r.int_copies) == len(r.ext_copies)


def test_splitting_in_columns(spark):
    pairs = spark.createDataFrame([(1, b"0123456789" * 10, b"0123456789" * 10 + b"tail")], "pair_id long, old binary, new binary")
    from pyspark.sql import functions as F

    row = diff.diff_pairs(pairs).select(copies.int_copies(F.col("segments"), 30).alias("i"), copies.ext_copies(F.col("segments"), 30).alias("e")).first()
    assert [(p.adj, p.len) for p in row.e] == [(0, 30), (0, 30), (0, 30), (0, 10)]
    assert [(p.n_ext, p.len) for p in row.i] == [(4, 4)]
