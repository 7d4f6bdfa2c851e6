"""Shared pieces of the operators: batch-wise columns, words, work tables."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows handed to a Python worker at once: bounds its memory where texts are long.
BATCH_ROWS = 1024
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
WORD_JVM = r"[^\x20\x09-\x0D]+"


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the number of rows per Arrow batch of this session where it is higher."""
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= rows:
        spark.conf.set(BATCH_CONF, str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def with_batch_columns(df: DataFrame, inputs: list[str], outputs: StructType, work: Callable[..., list]) -> DataFrame:
    """``df`` with the columns of ``outputs``; ``work`` takes one Arrow array per input and returns one per output.

    Rows stay where they are: one narrow stage, no shuffle. ``outputs`` must not clash with columns of ``df``."""
    bound_batches(df.sparkSession)
    at = [df.columns.index(c) for c in inputs]
    names = [*df.columns, *outputs.fieldNames()]
    schema = StructType([*df.schema.fields, *outputs.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = work(*[batch.column(i) for i in at])
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Maximal runs of anything but ASCII white space."""
    return text.split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit image of every value (final mixing steps of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rows_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list or binary (64-bit items) column without nulls."""
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
    if pa.types.is_binary(values.type):
        flat = np.frombuffer(values.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.int64)
        return flat, (offsets - offsets[0]) // 8
    return values.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]
