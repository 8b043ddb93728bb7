import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from deltaframe.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    """Each stage on what the one before it kept, against plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "simhash", "decontamination", "byte_bpe"]
    steps = dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r for r in docs.collect()}

    good = steps["quality"](spark, docs, SF).cache()
    assert good.columns == columns
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    accepted = {i for i, r in before.items() if model.score(np.array([quality.features(r.text)]))[0] >= 0.7}
    assert {r.doc_id for r in good.collect()} == accepted

    lines = steps["line_dedup"](spark, good, SF).cache()
    assert lines.columns == columns
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    seen = set()
    after = {r.doc_id: r for r in lines.collect()}
    assert set(after) == accepted
    for i in sorted(accepted):
        kept = after[i].text.split("\n") if after[i].text else []
        assert after[i].n_chars == len(after[i].text)
        for line in before[i].text.split("\n"):
            if kept and kept[0] == line:  # a line that stays has not been seen
                assert not norm(line) or norm(line) not in seen
                kept.pop(0)
            else:
                assert norm(line)
            seen.add(norm(line))
        assert not kept

    unlike = steps["simhash"](spark, lines, SF).cache()
    assert unlike.columns == columns
    from deltaframe.llm.simhash import cluster

    groups = {r.doc_id: r.component_id for r in cluster(lines).collect()}
    assert {r.doc_id for r in unlike.collect()} == set(groups.values())

    clean = steps["decontamination"](spark, unlike, SF).cache()
    assert clean.columns == columns
    items = [decontaminate.reduce_text(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {r.doc_id for r in unlike.collect() if any(t in decontaminate.reduce_text(r.text) for t in items)}
    assert not whole & {r.doc_id for r in clean.collect()}
    assert len(whole) <= unlike.count() - clean.count() <= len(whole) + 2

    tokens = steps["byte_bpe"](spark, clean, SF).collect()
    import base64

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert {r.doc_id for r in tokens} == set(texts)
    for r in tokens:
        packed = b"".join(i.to_bytes(4, "little") for i in truth.encode_ordinary(texts[r.doc_id]))
        assert (bytes(r.ids), r.n_tokens) == (packed, len(packed) // 4)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 50 < len(rows) < 200
    assert len({r.doc_id for r in rows}) == len(rows)
