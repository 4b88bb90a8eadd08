"""Vectors of an Arrow list column as matrices of scaled integers.

A vector counts if it isn't null, has the table's dimension, and each of its entries is there, finite and below 2**50 in
magnitude (beyond it a scaled entry would not be a whole number of a double).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 2.0**50
#: Bytes of a matrix that a task holds at once.
MOST_BYTES = 4 << 20


def dimension(rows: DataFrame, column: str = "embedding", multiple: int = 1) -> int:
    """The most common length above 0 that `multiple` divides; of equally common ones the largest; 0 if there is none."""
    sizes = rows.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count()
    top = sizes.where((F.col("d") > 0) & (F.col("d") % multiple == 0)).orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that count, and their entries as doubles, a row each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    whole = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), d), False).to_numpy(zero_copy_only=False))
    values = pc.list_flatten(column.take(pa.array(whole)))
    found = pc.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(whole), d)
    with np.errstate(invalid="ignore"):
        good = (np.abs(found) < LARGEST).all(axis=1)
    return (whole, found) if good.all() else (whole[good], found[good])


def scaled(batch: pa.RecordBatch, d: int, scale: int, shift: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of a batch whose `embedding` counts, some MB at a time, with floor(scale * entry) + shift."""
    step = max(1, MOST_BYTES // (8 * d))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        places, entries = matrix(part.column("embedding"), d)
        if len(places):
            yield part.take(pa.array(places)), np.floor(entries * scale).astype(np.int64) + shift


def blobs(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int64) * width), pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def joined(column: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary column after each other."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
