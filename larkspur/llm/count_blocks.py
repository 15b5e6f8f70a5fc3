"""Summing large fixed-size count vectors over all tasks.

A task packs its counts into blocks of ``BLOCK`` numbers and emits one row for
each block. Blocks are added in rounds: over ``TASKS`` neighbouring map tasks,
then over as many of these sums, then over all. So no group holds more than
``TASKS`` blocks at up to ``TASKS`` ** 3 (16 million) map tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.shared import settings

BLOCK = 1 << 16
#: Blocks that meet in one group.
TASKS = 256

SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("salt", T.IntegerType()),
        T.StructField("counts", T.BinaryType()),
    ]
)


def emit(vectors: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of a task: the non-zero blocks of its vectors."""
    context = TaskContext.get()
    salt = context.partitionId() // TASKS if context else 0
    for name, vector in vectors.items():
        for block, at in enumerate(range(0, len(vector), BLOCK)):
            part = vector[at : at + BLOCK]
            if part.any():
                yield _row(name, block, salt, part)


def _row(name: str, block: int, salt: int, part: np.ndarray) -> pa.RecordBatch:
    packed = pa.compress(part.astype("<i8").tobytes(), "zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([packed], pa.binary())], names=SCHEMA.names)


def unpack(packed: bytes) -> np.ndarray:
    raw = pa.input_stream(pa.py_buffer(packed), compression="zstd").read()
    return np.frombuffer(raw, "<i8")


def _add(table: pa.Table) -> pa.Table:
    total: np.ndarray | None = None
    for packed in table["counts"].to_pylist():
        part = unpack(packed)
        total = part.copy() if total is None else total + part
    row = _row(table["name"][0].as_py(), table["block"][0].as_py(), table["salt"][0].as_py(), total)
    return pa.Table.from_batches([row])


def total(rows: DataFrame) -> DataFrame:
    """One row for each vector and block, with the sum over all tasks."""
    salted = rows.groupBy("name", "block", "salt").applyInArrow(_add, SCHEMA)
    higher = salted.withColumn("salt", F.expr(f"salt div {TASKS}").cast("int"))
    return higher.groupBy("name", "block", "salt").applyInArrow(_add, SCHEMA).groupBy("name", "block").applyInArrow(_add, SCHEMA)


def to_arrays(summed: DataFrame, size: int) -> dict[str, np.ndarray]:
    """The summed vectors on the driver; their size is fixed by the model, not by the data."""
    found: dict[str, np.ndarray] = {}
    with settings(summed.sparkSession):
        for row in summed.select("name", "block", "counts").toLocalIterator():
            part = unpack(bytes(row["counts"]))
            found.setdefault(row["name"], np.zeros(size, np.int64))[row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
    return found


def bucket(column: str, modulus: int) -> Column:
    """crc32 of a value as text, modulo; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
