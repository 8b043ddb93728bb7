"""What stages leave behind on executors: workers, shuffle files, bucket rows."""

import glob
from itertools import combinations

import corpus_pipeline
import public_tokenizers as P
from pyspark.sql import functions as F

from deltaframe.llm import bpe
from deltaframe.llm import line_dedup as L
from deltaframe.llm.shared import materialise


def test_token_stage_takes_one_worker_a_task(spark, capsys):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None), (None, "é 漢"), (4, "")], "doc_id long, text string")
    out = corpus_pipeline.token_stage(spark, docs, "")
    out.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    path = P.path("byte_bpe_50k.tiktoken")
    apart = bpe.decode(bpe.encode(docs, "doc_id", "text", path, P.PATTERN), "doc_id", "ids", path, P.PATTERN)
    plain = apart.select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    assert sorted(out.select(plain.columns).collect(), key=str) == sorted(plain.collect(), key=str)


def test_written_tables_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in top for f in glob.glob(f"{d}/*/shuffle_*.data")}
    there = files()
    out = materialise(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "test-shuffle")
    assert out.count() == 700
    # the count's own shuffle may stay; 700 keys of the written table must not
    assert not [f for f in files() - there if len(open(f, "rb").read()) > 1000]
    assert spark.conf.get(key) == before


def test_buckets_are_those_of_equal_least_hashes(spark):
    texts = [f"the quick brown fox jumps over the lazy dog {k}" for k in range(12)] + ["漢" * 40, "y" * 90, "a b", *(f"{'long words ' * 9}{k}" for k in range(5))]
    rows = L.distinct_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = rows.select("line", *[F.array(*L.least_hashes(kind)).alias(kind) for kind in L.MINIMA]).collect()
    plain = {}
    for row in rows:
        for kind, agreed in L.AGREED.items():
            for three in agreed:
                if row[kind][0] is not None:
                    plain.setdefault((kind, three, *[row[kind][k] for k in three]), set()).add(row.line)
    lines = L.distinct_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {}
    for r in L.bucketed(lines).collect():
        got.setdefault(r.key, set()).add((r.line, r.leader, r.size))
    want = sorted(sorted((x, min(b), len(b)) for x in b) for b in plain.values() if len(b) > 1)
    assert sorted(map(sorted, got.values())) == want
    assert len(want) > 20 and all(len(set(p)) == 2 for b in plain.values() for p in combinations(b, 2))
