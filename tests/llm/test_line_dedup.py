import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from deltaframe.llm import line_dedup as L

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone int, line string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (x != y)))
    return row[-1]


def plain(rows, similarity):
    """Brute force: all pairs of distinct lines."""
    last = 2**63 - 1
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    places = {}
    for d, text in rows:
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            if norm(line):
                places.setdefault(norm(line), set()).add((last if d is None else d, pos))
    names = sorted(places)
    label = {n: n for n in names}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if distance(a, b) <= int((1 - similarity) * max(len(a), len(b)) + 1e-9):
                label[find(a)] = find(b)
    first = {}
    for n in names:
        first[find(n)] = min(min(places[n]), first.get(find(n), (last, last)))
    out = []
    for d, text in rows:
        if text is None:
            out.append((d, 0, 0, None))
            continue
        lines = text.split("\n")
        stay = [x for pos, x in enumerate(lines) if not norm(x) or first[find(norm(x))] == (last if d is None else d, pos)]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def make(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), 1, "x") for d, t in rows], SCHEMA)


def got(docs, **how):
    return sorted(map(tuple, L.dedup_lines(docs, **how).collect()), key=str)


def fuzzy_rows(seed, n):
    rng = random.Random(seed)
    vocabulary = "the of cat dog runs sat by sea on mat red blue green élan straße 12 tree house river".split()
    base = [" ".join(rng.choices(vocabulary, k=rng.randrange(15, 30))) for _ in range(6)]

    def line():
        words = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return rng.choice([" ".join(words), " ".join(words).upper() + "!", rng.choice(vocabulary), "", "--"])

    return [(rng.randrange(1000) * 7 - 900, "\n".join(line() for _ in range(rng.randrange(1, 6)))) for _ in range(n)]


def test_against_brute_force(spark):
    rows = fuzzy_rows(1, 60)
    # candidates are found by chance: nothing may go that brute force keeps, nine tenths of the rest must; buckets are divided in the second run
    for pairs in (L.PAIRS, 0):
        mine, want = got(make(spark, rows), similarity=0.9, pairs=pairs), plain(rows, 0.9)
        assert [(r[0], r[1]) for r in mine] == [(r[0], r[1]) for r in want]
        assert all(a[2] <= b[2] for a, b in zip(mine, want, strict=True))
        assert sum(r[2] for r in mine) >= 0.9 * sum(r[2] for r in want) > 50


def test_recall_by_edit_similarity_alone(spark):
    """Words replaced in long lines, letters in short ones: all pairs are compared."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=rng.randrange(2, 9)))
    rows = []
    for i in range(160):  # so many that chance moves the share found by two hundredths
        words = [word() for _ in range(rng.choice((2, 4, 8, 20)))]
        rows.append((2 * i, " ".join(words)))
        if len(words) < 10:
            text = list(rows[-1][1])
            for _ in range(max(1, len(text) // 10)):
                text[rng.randrange(len(text))] = rng.choice("uvwxyz")
            rows.append((2 * i + 1, "".join(text)))
        else:
            for _ in range(len(words) // 8):
                words[rng.randrange(len(words))] = word()
            rows.append((2 * i + 1, " ".join(words)))
    want = set()
    for j, b in rows:
        for _, a in rows[:j]:
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            # letters without a counterpart need an edit each
            if max((Counter(a) - Counter(b)).total(), (Counter(b) - Counter(a)).total()) <= most and distance(a, b) <= most:
                want.add(j)
                break
    found = {r[0] for r in got(make(spark, rows)) if r[2]}
    assert len(want) > 140
    assert found <= want
    assert len(found) >= 0.9 * len(want)


def test_cases(spark):
    rows = [(3, "A line here.\nA LINE, here\n\n\nother"), (1, "a line here"), (1, "a line here"), (2, None), (4, ""), (5, "?\n?\n"), (None, "other"), (None, "new one"), (-7, "w " * 30_000 + "\nother")]
    docs = make(spark, rows)
    assert got(docs) == plain(rows, L.SIMILARITY)
    kept = L.keep_first_lines(docs)
    assert kept.columns == docs.columns
    assert kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.collect())


def test_large_bucket_of_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(40):
        copy = list(words)
        copy[rng.randrange(50)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    assert got(make(spark, rows), similarity=0.9) == plain(rows, 0.9)


def test_empty_table(spark):
    assert L.dedup_lines(make(spark, [(1, "x")]).limit(0)).collect() == []


def test_reduced_lines_and_sketches():
    texts = ["A b--C\n\n d_e é—f", None, "", "?", "x" * 90 + "\n" + "long words of many kinds " * 6, "The END\nthe end!"]
    found = L.Reduced(texts)
    want = [(i, pos, L.reduce_line(line)) for i, t in enumerate(texts) if t is not None for pos, line in enumerate(t.split("\n")) if L.reduce_line(line)]
    assert [(o, p, x.decode()) for o, p, x in zip(found.owner.tolist(), found.pos.tolist(), found.lines, strict=True)] == want
    sketch = found.sketch()
    assert (sketch[-1] == sketch[-2]).all()
    names = found.names()
    assert len({tuple(n) for n in names.tolist()}) == len({x for *_, x in want})
    has_pairs, has_runs = (sketch[:, :9] != 2**32 - 1).any(1), (sketch[:, 9:] != 2**32 - 1).any(1)
    assert has_pairs.tolist() == [len(x) > 64 for *_, x in want]
    assert has_runs.tolist() == [len(x) <= 80 or " " not in x for *_, x in want]
    # as the same lines in other surroundings
    assert (L.Reduced([want[4][2].upper(), "z"]).sketch()[0] == sketch[4]).all()
    assert L.Reduced([]).sketch().shape == (0, 22)
    assert L.Reduced([None, ""]).names().shape == (0, 2)


def test_aligned_edits_are_no_fewer_than_edits():
    rng = random.Random(11)
    for _ in range(400):
        a, b = (rng.choices(["ab", "b", "cab", "bb"], k=rng.randrange(1, 9)) for _ in range(2))
        assert L.aligned_edits(a, b, 99) >= distance(" ".join(a), " ".join(b))


def test_bytes_beyond_ascii_are_told_as_the_pattern_tells_them():
    for c in (*range(0x80, 0x600), *range(0x2000, 0x2100), 0x3000, 0x4E2D, 0x1F642):
        text = f"a{chr(c)}b"
        assert [x.decode() for x in L.Reduced([text]).lines] == [L.reduce_line(text)], hex(c)


def test_bounded_distance():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ("".join(rng.choices("ab c", k=rng.randrange(30))) for _ in range(2))
        for most in (0, 2, 6, 30):
            assert L.distance_within(a, b, most) == (distance(a, b) <= most)
            assert L.alike(a, b, 0.8) == (distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))


def short_cells(texts):
    """Texts as the columns of a batch of short lines."""
    cells = L.Reduced.short(type("", (), {"lines": [t.encode() for t in texts]}))
    return L._characters_of(pa.RecordBatch.from_arrays(cells, names=L._TEXT), L._TEXT)


def test_texts_at_once_are_as_close_as_one_by_one():
    rng = random.Random(12)
    for letters, size in (("ab c", 30), ("aé漢𝒳 ", 20), ("abcdefgh ", 80)):
        texts = ["".join(rng.choices(letters, k=rng.randrange(1, size + 1))) for _ in range(300)]
        texts += ["".join(c for c in t if rng.random() > 0.1) or "a" for t in texts]  # near ones, too
        cells, sizes = short_cells(texts)
        assert sizes.tolist() == [len(t) for t in texts]
        i, j = np.array([(k, rng.choice((k + 300, rng.randrange(600)))) for k in range(300)] * 3).T
        for most in (0, 1, 6, 16):
            limit = np.array([rng.randrange(most + 1) for _ in i])
            want = [distance(texts[a], texts[b]) <= m for a, b, m in zip(i.tolist(), j.tolist(), limit.tolist(), strict=True)]
            assert L.close_texts(cells, sizes, i, j, limit).tolist() == want


def test_short_pairs_that_differ_are_not_written(spark):
    """Short lines that share many runs but not 0.8 of their letters end where they meet; longer texts have no columns."""
    rng = random.Random(2)
    parts = ["the", "en", "ation", "er", "on", "re", "in", "at", "st", "ing"]
    texts = sorted({" ".join("".join(rng.choices(parts, k=3)) for _ in range(6))[:70].strip() for _ in range(60)}) + ["y" * 90]
    lines = L.distinct_lines(make(spark, list(enumerate(texts))))
    signed = L.signatures(lines).cache()
    assert signed.where("x0 is null").count() == 1
    placed = L.keyed(lines).withColumns({"own": F.col("line"), "led": F.lit(0).cast("long")})
    written = L.pairs_within(placed.join(signed, "line"), 0.8).collect()
    near = sum(distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) for k, a in enumerate(texts) for b in texts[:k] if abs(len(a) - len(b)) < 17)
    assert all(r.sure for r in written)
    assert len({frozenset((r.a, r.b)) for r in written}) <= near


def test_links_of_short_lines_are_a_forest(spark):
    """A group of near copies whose leader is another line gives a row per line, not per pair."""
    texts = [f"the quick brown fox jumps over the lazy dog {k:03d}" for k in range(200)]
    lines = L.distinct_lines(make(spark, list(enumerate(texts))))
    placed = lines.select(F.lit(1).cast("long").alias("key"), "line", F.col("line").alias("own"), F.lit(0).cast("long").alias("led"))
    written = L.pairs_within(placed.join(L.signatures(lines), "line"), 0.8).collect()
    assert len(written) == 199 and all(r.sure for r in written)


def passage_lines(n):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(60))
    return [" ".join([*(word() for _ in range(25)), passage]) for _ in range(n)]


def test_long_lines_of_a_common_passage_are_not_written_in_pairs(spark):
    """A row for each line that is to be read beside others of its bucket, where there were 60 * 59 / 2 pairs."""
    texts = passage_lines(60)
    lines = L.distinct_lines(make(spark, list(enumerate(texts))))
    placed = lines.select(F.lit(0).cast("long").alias("key"), "line", F.col("line").alias("own"), F.lit(0).cast("long").alias("led"))
    written = L.pairs_within(placed.join(L.signatures(lines), "line"), 0.8).collect()
    assert 0 < len(written) <= 60


def test_a_pair_meets_in_one_bucket_of_word_pairs():
    rng = np.random.default_rng(5)
    low = {(c, k + 1) for c, three in enumerate(L.AGREED["w"]) for k in range(9) if k not in three}
    for bits in rng.integers(0, 512, 200):
        have = {k for k in range(9) if bits >> k & 1}
        shared = [c for c, three in enumerate(L.AGREED["w"]) if have >= set(three)]
        whole = L.meet_here(np.array(shared, np.int64) | 1 << 20, np.full(len(shared), bits))
        assert whole.sum() == (len(shared) > 0)
        parts = [c | k << 6 for c, k in low if c in shared and k - 1 in have]
        assert L.meet_here(np.array(parts, np.int64), np.full(len(parts), bits)).sum() == (len(have) > 3 and len(shared) > 0)


def test_divided_buckets_leave_out_the_hashes_that_make_them(spark):
    """All lines of a bucket have those in common: dividing by them gave the whole bucket again, three times."""
    lines = L.distinct_lines(make(spark, list(enumerate(passage_lines(3)))))
    placed = L.keyed(lines).withColumns({"own": F.col("line"), "led": F.col("line")})
    keys = [r.key for r in L.divided(placed, lines).collect()]
    assert len(keys) == 3 * 12 * 6
    assert all((k >> 6 & 15) - 1 not in L.AGREED["w"][k & 63] for k in keys)


def test_far_apart_is_never_said_of_texts_that_are_near():
    rng = random.Random(4)
    texts = ["".join(rng.choices(letters, k=rng.randrange(60, 400))) for letters in ("ab c", "abcdefgh ijklmnop", "aé漢𝒳 bcd") for _ in range(40)]
    left, right = [], []
    for t in texts:
        for rate in (0.1, 0.25, 0.9):
            left.append(t)
            right.append("".join(rng.choice(("", c, c + "x", "y")) if rng.random() < rate else c for c in t))
    left, right = left + texts, right + texts[1:] + texts[:1]
    for similarity in (0.8, 0.95):
        near = [distance(a, b) <= int((1 - similarity) * max(len(a), len(b)) + 1e-9) for a, b in zip(left, right, strict=True)]
        far = L.far_apart(left, right, similarity)
        assert not any(a and b for a, b in zip(far.tolist(), near, strict=True))
        assert far.sum() > 0.3 * len(far)
        assert L.all_alike(left, right, similarity) == near
