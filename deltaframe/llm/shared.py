"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Settings while a table is written.
_FRUGAL = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": f"{4 << 20}b"}


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver's sys.path names it.

    On a cluster the package is shipped with ``--py-files`` or installed; the
    entry is then merely an unused directory.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (PACKAGE_ROOT, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine (tests, a laptop) a local folder is made once
    and kept in the session's configuration; on a cluster it has to be named.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.deltaframe.scratch", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="deltaframe-")
        spark.conf.set("spark.deltaframe.scratch", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/deltaframe-{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path through Hadoop's file system API, whatever the store is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at replicated files."""
    return materialise_at(df, name)[0]


@contextmanager
def _frugal(spark: SparkSession) -> Iterator[None]:
    """What is executed meanwhile leaves no shuffle files (else they stay until the driver collects its garbage), and hands workers small batches."""
    before = {k: spark.conf.get(k, None) for k in _FRUGAL}
    for k, v in _FRUGAL.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _frugal(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _place(uri: str) -> tuple[pa.fs.FileSystem | None, str]:
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return None, unquote(urlparse(uri).path) if scheme else uri
    return pa.fs.FileSystem.from_uri(uri)


@contextmanager
def open_read(uri: str) -> Iterator[BinaryIO]:
    fs, path = _place(uri)
    with open(path, "rb", buffering=0) if fs is None else fs.open_input_file(path) as f:
        yield f


@contextmanager
def open_write(uri: str) -> Iterator[BinaryIO]:
    fs, path = _place(uri)
    if fs is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") if fs is None else fs.open_output_stream(path) as f:
        yield f


class Scratch:
    """Tables in the shared folder, removed once what follows from them has been written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = materialise_at(df, name)
        self.paths.append(path)
        return out

    def clear(self) -> None:
        for path in self.paths:
            delete_path(self.spark, path)
        self.paths.clear()


def text_bytes(df: DataFrame, text: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column: one aggregate over the whole table."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text))).alias("b")).first()
    return row["n"], row["b"] or 0


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``most_bytes`` of the given column (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and (held + n > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def release() -> None:
    """Give memory that a worker has freed back to the machine; workers stay between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # no GNU libc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that leaves no freed memory behind in its worker."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def keep_rows(df: DataFrame, text: str, chooser: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows of ``df`` whose text is chosen, with all columns as they are.  No shuffle; the text travels once.

    ``chooser`` is called once in each task and gives what decides for lists of texts.
    """
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = chooser()
        for batch in batches:
            for part in slices(batch, at, 1 << 20):
                yield part.filter(pa.array(choose(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(tidied(run), df.schema)


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as long pairs ``(u, v)``.

    Alternating large-star and small-star rounds: every vertex hands its
    neighbours to the smallest vertex it sees until the edge set is a forest of
    stars.  Each round is one group-by per star with map-side combine for the
    minimum, and is written to the shared folder, so that a lost executor costs
    one round and the plan does not grow.  Only two counters reach the driver.

    Returns ``(vertex long, component long)``, component being the smallest
    vertex reachable; vertices without an edge are not listed.
    """
    spark = edges.sparkSession
    current = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    current, path = materialise_at(current, f"{name}-edges")
    seen = None
    for _ in range(max_rounds):
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u are linked to the least of u and its neighbours
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its neighbours below are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
            .where("u <> v")
            .distinct()
        )
        previous = path
        current, path = materialise_at(small, f"{name}-edges")
        delete_path(spark, previous)
        mark = current.agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("d"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        state = (mark["n"], mark["d"], mark["h"])
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )
