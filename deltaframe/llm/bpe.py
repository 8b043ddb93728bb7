"""Byte-level BPE encoding and decoding through a serialised sentencepiece model.

A rank file (base64 token and rank per line) is turned into a sentencepiece BPE
model: every token's bytes are mapped to printable characters, the piece's score
is its negative rank, normalisation is the identity.  Merging the adjacent pair
of highest score, leftmost first, is then the same as merging the pair of lowest
rank, so that sentencepiece's ids less one are the ranks.  A text is cut into
pre-tokens by a pattern; each is encoded by itself.

Cases: a null text is an empty one (no ids, empty bytes); long texts are encoded
whole; equal rows each give a row; other columns of the input are not read and
may have any name.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, tidied

#: Pre-tokens kept per worker; a full cache is emptied.
CACHE_ENTRIES = 200_000


def byte_alphabet() -> list[str]:
    """One printable character for each byte: itself where printable in Latin-1, else the next one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 0x100
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, at the place of their rank."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is unknown, piece r + 1 is the token of rank r."""
    letters = byte_alphabet()
    unknown = _bytes_field(1, "<unk>".encode()) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int_field(3, 2)
    model = [_bytes_field(1, unknown)]
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        model.append(_bytes_field(1, _bytes_field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _int_field(3, 1)))
    trainer = _int_field(3, 2) + _int_field(4, len(tokens) + 1) + _int_field(40, 0) + _int_field(41, -1) + _int_field(42, -1) + _int_field(43, -1)
    normalizer = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    return b"".join([*model, _bytes_field(2, trainer), _bytes_field(3, normalizer)])


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.tokens = tokens
        self.split = regex.compile(pattern).findall
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.cache = _Cache(self)

    # decoding needs neither of these
    @cached_property
    def model(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))

    @cached_property
    def whole(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-token, packed; a pre-token that is itself a token is that token."""
        raw = piece.encode()
        if (rank := self.whole.get(raw)) is not None:
            return struct.pack("<I", rank)
        ids = self.model.encode(raw.decode("latin-1").translate(self.alphabet))
        return (np.array(ids, dtype="<u4") - np.uint32(1)).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def decode(self, packed: bytes | None) -> bytes:
        if not packed:
            return b""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


class _Cache(dict):
    def __init__(self, owner: ByteBpe) -> None:
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        ids = self.owner.encode_piece(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def load(path: str, pattern: str) -> ByteBpe:
    """The codec of a rank file, kept until a task that encodes ends."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode(df: DataFrame, key: str, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """``(key, ids binary)``: each row's text as packed little-endian unsigned 32-bit ids.

    ``ranks_path`` must be readable on the executors; the vocabulary is a file
    of fixed size.  No shuffle: texts are encoded where they are read.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])
        _LOADED.clear()  # the worker may go on with other work

    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), f"key {kind.simpleString()}, ids binary")
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, ranks_path: str, pattern: str) -> DataFrame:
    """``(key, ids, decoded binary)``: the bytes that packed ids stand for."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                raw = [codec.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], names=["key", "ids", "decoded"])

    out = df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(tidied(run), f"key {kind.simpleString()}, ids binary, decoded binary")
    return out.withColumnRenamed("key", key).withColumnRenamed("ids", ids) if ids != "ids" else out.withColumnRenamed("key", key)


def round_trip(df: DataFrame, key: str, text: str, ranks_path: str, pattern: str) -> DataFrame:
    """``(key, ids, decoded binary)``: what encode() and then decode() give, in one worker a task instead of two that both stay."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                raw = [codec.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(raw, pa.binary())], names=["key", "ids", "decoded"])
        _LOADED.clear()  # the worker may go on with other work

    out = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), f"key {kind.simpleString()}, ids binary, decoded binary")
    return out.withColumnRenamed("key", key)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``documents`` encoded and decoded, as counts and digests (all of them computed in the JVM)."""
    coded = decode(encode(docs, "doc_id", "text", ranks_path, pattern), "doc_id", "ids", ranks_path, pattern)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
