import base64
import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from deltaframe.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TRUTH = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    import numpy as np

    return np.frombuffer(bpe.load(PATH, P.PATTERN).encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_tiktoken(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(text) == TRUTH.encode_ordinary(text)
    assert bpe.load(PATH, P.PATTERN).decode(bpe.load(PATH, P.PATTERN).encode(text)) == text.encode()


def test_every_token_as_a_pre_token():
    codec = bpe.load(PATH, P.PATTERN)
    for token, rank in RANKS.items():
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        assert ids(text) == TRUTH.encode_ordinary(text), (rank, text)


def test_long_and_odd_texts():
    for text in ("a" * 20_000, " " * 5000 + "x", "\r\n\t ▁ ▁▁ x", "<|endoftext|>", "ß" * 3000 + "漢字" * 2000, "\x00\x01"):
        assert ids(text) == TRUTH.encode_ordinary(text)


def test_query_over_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "Hello world", 7, "k"), (2, None, 8, "k"), (3, "", 9, "k"), (1, "Hello world", 7, "k"), (None, "é 漢 🙂", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, key string")
    got = sorted(bpe.digests(docs, PATH, P.PATTERN).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == 5
    for row, text in zip(got, ["Hello world", "Hello world", "", "", "é 漢 🙂"], strict=True):
        packed = b"".join(i.to_bytes(4, "little") for i in TRUTH.encode_ordinary(text))
        assert (row.n_tokens, row.ids_sha256) == (len(packed) // 4, hashlib.sha256(packed).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []
