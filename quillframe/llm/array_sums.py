"""Sums of large count arrays over all tasks, in chunks and in two levels, so that no task gathers what all tasks have sent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Entries of one chunk, and groups of tasks whose chunks are summed first.
CHUNK, FIRST_LEVEL = 1 << 14, 1024

PARTS = "name string, chunk int, part int, held binary"
_FIELDS = pa.schema([("name", pa.string()), ("chunk", pa.int32()), ("part", pa.int32()), ("held", pa.binary())])


def parts_of(arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A task's arrays (of int64, a whole number of chunks long) as rows; chunks without a count are left out."""
    context, press, rows = TaskContext.get(), zstandard.ZstdCompressor(level=1), []
    part = context.partitionId() % FIRST_LEVEL if context else 0
    for name, array in arrays.items():
        for k, chunk in enumerate(array.reshape(-1, CHUNK)):
            if chunk.any():
                rows.append((name, k, part, press.compress(chunk.tobytes())))
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _FIELDS)], schema=_FIELDS)


def _add(table: pa.Table) -> pa.Table:
    opener, total = zstandard.ZstdDecompressor(), np.zeros(CHUNK, np.int64)
    for held in table.column("held"):
        total += np.frombuffer(opener.decompress(held.as_buffer()), np.int64)
    packed = pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())
    first = table.slice(0, 1)
    return pa.Table.from_arrays([*[first.column(c).combine_chunks() for c in ("name", "chunk", "part")], packed], schema=_FIELDS)


def summed(parts: DataFrame, length: int) -> dict[str, np.ndarray]:
    """name -> sum of its arrays.  The driver gets one array for each name."""
    level = parts.groupBy("name", "chunk", "part").applyInArrow(_add, PARTS)
    level = level.withColumn("part", F.lit(0)).groupBy("name", "chunk").applyInArrow(_add, PARTS)
    out: dict[str, np.ndarray] = {}
    opener = zstandard.ZstdDecompressor()
    for r in level.select("name", "chunk", "held").collect():
        array = out.setdefault(r["name"], np.zeros(length, np.int64))
        array[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(opener.decompress(r["held"]), np.int64)
    return out
