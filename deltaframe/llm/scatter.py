"""Documents dealt to parts, and messages between parts and buckets.

Two operators need to know, for each of very many small things in a text, what
all other texts have of it.  Texts stay in parts of bounded size (one exchange of
the table, used again by every step); what a part asks goes to buckets as packed
arrays, a row per part and bucket, and the answers come back in the same order,
so that no thing travels as a row of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_bytes

PART_BYTES = 12 << 20
LEAST_PARTS = 64

#: What a part says to a bucket, and a bucket to a part.
MESSAGE = "part long, bucket long, data binary"
_MESSAGE = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])


@dataclass
class Parts:
    """Rows ``(part long, key long, text binary)`` and how many parts there are."""

    rows: DataFrame
    count: int


def deal(docs: DataFrame, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> Parts:
    """Deal rows to parts by a hash of key and text (null texts are empty)."""
    _, size = text_bytes(docs, text)
    n = max(LEAST_PARTS, -(-size // part_bytes))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.pmod(F.xxhash64(F.col(key), body), F.lit(n)).alias("part"), F.col(key).cast("long").alias("key"), body.cast("binary").alias("text"))
    return Parts(rows, n)


def documents_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Keys, whether each is null, and texts of a part, in an order that does not depend on how rows arrived."""
    keys = rows.column("key")
    null = keys.is_null().to_numpy(zero_copy_only=False)
    number = keys.fill_null(0).to_numpy()
    texts = rows.column("text").to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (null[i], number[i], texts[i]))
    return number[order], null[order], [texts[i] for i in order]


def runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    starts = np.flatnonzero(values[1:] != values[:-1]) + 1 if len(values) else ()
    for a, z in zip([0, *starts], [*starts, len(values)], strict=True):
        if a < z:
            yield int(values[a]), int(a), int(z)


def messages(rows: Iterator[tuple[int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], schema=_MESSAGE)


def ask(parts: Parts, step: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Messages that each part makes of its documents."""
    return parts.rows.groupBy("part").applyInArrow(step, MESSAGE)


def answer(asked: DataFrame, step: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Messages that each bucket makes of all it was sent."""
    return asked.groupBy("bucket").applyInArrow(step, MESSAGE)


def hear(parts: Parts, answered: DataFrame, step: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What each part makes of its documents and the answers to it."""
    return parts.rows.groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(step, schema)
