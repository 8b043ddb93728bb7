import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def test_stage_against_all_pairs(spark):
    """Copies with some words replaced go, by Jaccard similarity alone."""
    rng = random.Random(4)
    rows, base = [(900, "", "en", "s", 0), (901, None, "en", "s", None), (None, "no id", "en", "s", 5)], []
    for i in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((60, 150, 400)))]
        for k in range(3):
            copy = list(base)
            for _ in range(k * len(base) // rng.choice((60, 90, 30))):
                copy[rng.randrange(len(copy))] = "other"
            rows.append((rng.randrange(10**6) + 1000, " ".join(copy), "en", "s", 1))
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if near(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    docs = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.near_copy_stage(spark, docs, "")
    assert got.columns == docs.columns
    want = {find(i) for i in ids}
    assert len(ids) - len(want) > len(ids) - len({frozenset(s) for s in sets.values()}) + 20
    assert {r.doc_id for r in got.collect()} == want | {None}


def test_rows_of_one_id_are_told_apart(spark):
    from deltaframe.llm import simhash

    text = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "en"), (5, text, "en"), (5, other, "en"), (5, other, "en"), (7, text + " more", "en"), (None, text, "en")], "doc_id long, text string, hash string")
    for keep in (simhash.keep_unlike, simhash.keep_one):
        got = keep(docs)
        assert got.columns == docs.columns
        kept = sorted(((r.doc_id, r.text[:2]) for r in got.collect()), key=str)
        want = [(1, "w0"), (5, "v0"), (None, "w0")] + [(7, "w0")] * (keep is simhash.keep_one and len(kept) == 4)
        assert kept == sorted(want, key=str)


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated ids and further columns through all stages but the last, and empty tables."""
    rows = [(1, None, "en", "s", None, 1, 0.5), (2, "", "en", "s", 0, 1, 0.5), (2, "", "en", "s", 0, 1, 0.5), (None, "A line.\nA line.", None, None, 15, 1, 0.5), (3, "x" * 50_000, "en", "s", 50_000, 1, 0.5), (3, "The cat is on the mat and it was good. " * 30, "en", "s", 1140, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, hash double")
    spark.createDataFrame([(1, 1), (3, None), (None, 0), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "it was good"), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        n = table.count()
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, str(tmp_path))
            if name != "byte_bpe":
                assert got.columns == docs.columns
            assert got.count() <= n


def test_simhash_finds_the_near_copies(spark, monkeypatch):
    """Every pair that is compared comes from fingerprints: trees for the nearest, tables of sampled bits for the others."""
    import numpy as np

    from deltaframe.llm import simhash

    rng = random.Random(9)
    rows = []
    for i in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 120)))]
        copy = list(words)
        copy[rng.randrange(10, 50)] = "other"  # five of the runs change: similarity above 0.8
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    rows += [(240, "The same words, once more. " * 9), (241, "the same  words, once more. " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r.doc_id: r for r in simhash.sketches(docs, 5).collect()}
    apart = [sum(((prints[2 * i][c] ^ prints[2 * i + 1][c]) & 2**64 - 1).bit_count() for c in ("fp", "fp2")) for i in range(120)]
    for k in range(3):
        hashes = simhash.shingle_set(rows[k][1].encode(), 5).tolist()
        assert prints[k].fp & 2**64 - 1 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert np.median(apart) > 2 and max(apart) <= simhash.WIDE
    assert {r.doc_id for r in simhash.keep_unlike(docs).collect()} == set(range(0, 242, 2))
    # without fingerprints there is nothing to compare
    monkeypatch.setattr(simhash, "majorities", lambda sets: np.random.default_rng(len(sets)).integers(0, 2**64, len(sets), dtype=np.uint64))
    assert simhash.keep_unlike(docs).count() > 230


def test_entries_of_large_groups_give_few_pairs(spark):
    """A group of one component is not paired with itself, whatever else lies in its entries."""
    from pyspark.sql import functions as F

    from deltaframe.llm import simhash

    group = spark.range(3000).select(F.col("id").alias("digest"), F.lit(50).alias("size"), F.lit(7).cast("long").alias("fp"), F.lit(9).cast("long").alias("fp2"))
    other = spark.createDataFrame([(5000, 50, 7, 8), (5001, 50, 7, 0x7FFFFFFFFFFFFFF9), (5002, 20, 7, 9)], "digest long, size int, fp long, fp2 long")
    tables = simhash.sampled_bits(10)
    both = group.unionByName(other)
    led = simhash.close_prints(both.withColumn("own", F.col("digest")), tables, 0.8, leaders=True).collect()
    assert {(r.a, r.b) for r in led} >= {(0, i) for i in range(1, 3000)} and len(led) <= 3002
    placed = group.withColumn("own", F.lit(0).cast("long")).unionByName(other.withColumn("own", F.col("digest")))
    rest = {(r.a, r.b) for r in simhash.close_prints(placed, tables, 0.8, leaders=False).collect()}
    assert rest == {(i, 5000) for i in range(3000)}
    assert len(simhash.sampled_bits(10**9)) > len(tables) and simhash.sampled_bits(10**9).shape[1] > 8
