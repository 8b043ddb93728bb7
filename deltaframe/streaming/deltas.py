"""Delta files as a stream: a folder is watched, new files are parsed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.deltas import parse_files


def stream_deltas(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A streaming table of the delta files that arrive under ``path``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return parse_files(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path))
