"""Delta files as tables: the data source ``deltafile``, the public view and typed getters."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..codes import DeltaError, Status, Tag
from ..functions.batches import byte_slices
from ..functions.binary import hex_lower, raw_u32
from .container import parse

SCHEMA = (
    "filename string, type int, comp int, comp_level int, version int, src_nevr string, tgt_nevr string, sequence binary, tgt_md5 binary, tgt_size bigint, tgt_comp int, tgt_comp_level int, "
    "tgt_comp_param binary, tgt_header_len bigint, off_adj array<struct<pos:bigint,off:bigint>>, tgt_leadsig binary, payload_fmt_off bigint, int_copies array<struct<n_ext:bigint,len:bigint>>, "
    "ext_copies array<struct<adj:bigint,len:bigint>>, ext_data_len bigint, int_data_len bigint, add_data binary, int_data binary, status int, error string"
)


def row_of(name: str | None, data: bytes | None, body: bool = True) -> tuple:
    """A delta file as a row; what cannot be read has a status and nulls."""
    try:
        d, status, error = parse(data or b"", body), Status.OK, None
    except DeltaError as e:
        return (name, *[None] * 22, int(e.status), str(e))
    pairs = lambda x, a, b: [{a: p, b: q} for p, q in x]
    return (
        name, int(d.type), int(d.comp), d.comp_level, d.version, d.src_nevr, d.tgt_nevr, d.sequence, d.tgt_md5, d.tgt_size, int(d.tgt_comp), d.tgt_comp_level, d.tgt_comp_param, d.tgt_header_len,
        pairs(d.off_adj, "pos", "off"), d.tgt_leadsig, d.payload_fmt_off, pairs(d.int_copies, "n_ext", "len"), pairs(d.ext_copies, "adj", "len"), d.ext_data_len, len(d.int_data), d.add_data, d.int_data, int(status), error,
    )


def _types() -> list[tuple[str, pa.DataType]]:
    simple = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    pair = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
    nested = {"off_adj": pair("pos", "off"), "int_copies": pair("n_ext", "len"), "ext_copies": pair("adj", "len")}
    out = []
    for name, kind in (x.split(" ", 1) for x in SCHEMA.split(", ")):
        out.append((name, nested.get(name) or simple[kind]))
    return out


def parse_files(files: DataFrame, name: str = "path", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``SCHEMA`` from a table of file names and contents, as ``spark.read.format("binaryFile")`` gives it; columns to keep follow."""
    kept = "".join(f", {c} {files.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = _types()
        for batch in batches:
            for part in byte_slices(batch, 1):
                rows = [row_of(*pair) for pair in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                columns = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*columns, *part.columns[2:]], names=[*(n for n, _ in types), *keep])

    return files.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content"), *keep).mapInArrow(run, SCHEMA + kept)


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """All delta files under a path in any store that Spark reads."""
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


# -- public view --------------------------------------------------------------------------------------------


def info(deltas: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The public view: digests and blobs in hex, pairs flattened as unsigned numbers of 32 bits, empty values null."""
    text = lambda c: F.when(F.octet_length(c) > 0, hex_lower(F.col(c)))
    return deltas.select(
        "filename", "version", "type", "comp", text("sequence").alias("sequence"), "src_nevr", "tgt_nevr", "tgt_size", text("tgt_md5").alias("tgt_md5"), "tgt_comp",
        text("tgt_comp_param").alias("tgt_comp_param"), "tgt_header_len", flat("off_adj", "pos", "off", raw=True).alias("off_adj"), text("tgt_leadsig").alias("tgt_leadsig"), "payload_fmt_off",
        flat("int_copies", "n_ext", "len", raw=True).alias("int_copies"), flat("ext_copies", "adj", "len", raw=True).alias("ext_copies"), "ext_data_len", "int_data_len", *keep,
    )


def flat(pairs: str, first: str, second: str, raw: bool = False) -> Column:
    """Pairs one after the other; ``raw`` shows signed numbers as the unsigned ones of 32 bits."""
    show = raw_u32 if raw else (lambda c: c)
    return F.flatten(F.transform(pairs, lambda p: F.array(show(p[first]), show(p[second]))))


def write_sequences(deltas: DataFrame, path: str) -> None:
    """The sequences of deltas as lines of text."""
    deltas.select(F.concat("src_nevr", F.lit("-"), hex_lower(F.col("sequence")))).write.text(path)


_UINT = {Tag.VERSION: "version", Tag.TYPE: "type", Tag.COMP: "comp", Tag.TGTSIZE: "tgt_size", Tag.TGTCOMP: "tgt_comp"}
_ULONG = _UINT | {Tag.TGTHEADERLEN: "tgt_header_len", Tag.PAYLOADFMTOFF: "payload_fmt_off"}
_ULLONG = _ULONG | {Tag.EXTDATALEN: "ext_data_len", Tag.INTDATALEN: "int_data_len"}
_STRING = {Tag.FILENAME: "filename", Tag.SEQUENCE: "sequence", Tag.SRCNEVR: "src_nevr", Tag.TGTNEVR: "tgt_nevr", Tag.TGTMD5: "tgt_md5", Tag.TGTCOMPPARAM: "tgt_comp_param", Tag.TGTLEAD: "tgt_leadsig"}
_ARRAY = {Tag.ADJELEMS: "off_adj", Tag.INTCOPIES: "int_copies", Tag.EXTCOPIES: "ext_copies"}


def _get(table: dict[Tag, str], tag: int, kind: str) -> Column:
    if tag not in table:
        raise DeltaError(Status.ARGS, f"field {tag} is not of this type")
    return F.col(table[Tag(tag)]).cast(kind)


def get_uint(tag: int) -> Column:
    return _get(_UINT, tag, "bigint")


def get_ulong(tag: int) -> Column:
    return _get(_ULONG, tag, "bigint")


def get_ullong(tag: int) -> Column:
    return _get(_ULLONG, tag, "bigint")


def get_string(tag: int) -> Column:
    return _get(_STRING, tag, "string")


def get_ulong_array(tag: int) -> Column:
    return _get(_ARRAY, tag, "array<bigint>")


# -- data source ----------------------------------------------------------------------------------------------


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, body: bool) -> None:
        self.path, self.body = path, body

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [_File(self.path)]
        return [_File(os.path.join(d, n)) for d, _, names in sorted(os.walk(self.path)) for n in sorted(names) if not n.startswith((".", "_"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield row_of(partition.path, f.read(), self.body)


@dataclass
class _Written(WriterCommitMessage):
    paths: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Writes rows ``(filename, content)``, one file each; names appear when the job is committed."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: Iterator) -> _Written:
        import uuid

        done = []
        os.makedirs(self.path, exist_ok=True)
        for row in rows:
            part = os.path.join(self.path, f".{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(row.content)
            done.append((part, os.path.join(self.path, os.path.basename(row.filename))))
        return _Written(done)

    def commit(self, messages: list) -> None:
        for m in messages:
            for part, name in m.paths if m else ():
                os.replace(part, name)

    def abort(self, messages: list) -> None:
        for m in messages:
            for part, _ in m.paths if m else ():
                if os.path.exists(part):
                    os.remove(part)


class DeltaFiles(DataSource):
    """``spark.read.format("deltafile").load(path)`` over a mounted folder; option headerOnly skips the body."""

    @classmethod
    def name(cls) -> str:
        return "deltafile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("headeronly", "false").lower() != "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DeltaFiles)


