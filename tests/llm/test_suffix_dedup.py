import hashlib
import random
import time

import numpy as np
import pytest

from deltaframe.llm import suffix_dedup as S


def plain(rows, length=50):
    last = 2**63 - 1
    first = {}
    for key, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            first[s] = min(first.get(s, last), last if key is None else key)
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (last if key is None else key):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abé \n", k=rng.randrange(30, 120))) for _ in range(8)] + ["a" * 70, "\x00" * 60, "ab" * 40]
    return [(rng.randrange(400), "".join(rng.choice([rng.choice(passages), "".join(rng.choices("xyz", k=rng.randrange(30)))]) for _ in range(rng.randrange(6)))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_every_string_has_one_anchor(seed):
    raws = [t.encode() for _, t in texts(seed, 40)]
    data = np.frombuffer(b"".join(raws), np.uint8)
    ends = np.cumsum([len(r) for r in raws])
    low, high, place = S.anchors(data, ends)
    want = [a + i for a, r in zip((ends - [len(r) for r in raws]).tolist(), raws, strict=True) for i in range(len(r) - 49)]
    assert [i for a, z in zip(low.tolist(), high.tolist(), strict=True) for i in range(a, z + 1)] == want
    offset = {}
    for a, z, p in zip(low.tolist(), high.tolist(), place.tolist(), strict=True):
        for i in range(a, z + 1):
            assert 0 <= p - i <= 30
            assert offset.setdefault(data[i : i + 50].tobytes(), p - i) == p - i


@pytest.mark.parametrize("small", [2, 8, 4096])
def test_multikey_quicksort(small):
    rng = np.random.default_rng(small)
    words = rng.integers(0, 3, (700, 4)).astype(np.uint64)
    order = S.multikey_order(words, small)
    assert sorted(order.tolist()) == list(range(700))
    assert words[order].tolist() == sorted(words.tolist())


def test_against_brute_force(spark):
    rows = texts(5, 150) + [(None, "a" * 200), (None, "q" * 60), (3, None), (3, ""), (7, "n" * 49), (9, "n" * 50), (8, "m" * 50), (8, "m" * 50), (2, "long " * 9000), (1, "long " * 100), (-5, "é" * 40)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, kept string, part int")
    assert sorted(map(tuple, S.digests(docs).collect()), key=str) == plain(rows)
    few = S.repeated_strings(docs, part_bytes=4000).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in few if r.doc_id is not None) == [r for r in sorted(plain(rows), key=lambda r: (r[0] is None, r)) if r[0] is not None]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.digests(docs).collect() == []
    assert [tuple(r)[:4] for r in S.digests(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0)]


def test_length_that_no_mask_holds(spark):
    import pytest
    from deltaframe.llm import suffix_dedup

    docs = spark.createDataFrame([(1, "x" * 90), (2, "x" * 90)], "doc_id long, text string")
    for length in (19, 52, 60):
        with pytest.raises(ValueError):
            suffix_dedup.repeated_strings(docs, length=length)


def test_messages_cost_no_more_with_many_parts():
    """A bucket's answers to 3000 parts, in far less time than looking through all shared names for each of them."""
    rng = np.random.default_rng(5)
    sent = [rng.integers(0, 2**18, 150, dtype=np.uint32) for _ in range(3000)]
    holders = np.bincount(np.concatenate([np.unique(x) for x in sent]), minlength=2**18)
    begin = time.process_time()
    got = S.sent_by_several(sent)
    assert time.process_time() - begin < 3
    assert all((g == (holders[x] > 1)).all() for g, x in zip(got, sent, strict=True))
    assert [g.tolist() for g in S.sent_by_several([np.array([7, 7], np.uint32), np.zeros(0, np.uint32)])] == [[False, False], []]
