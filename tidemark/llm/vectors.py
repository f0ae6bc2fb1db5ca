"""What the two vector operators share: which vectors take part, packing, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a rotation or the quantiles of a projection are fitted on, the first by a hash of the vector.
SAMPLE_ROWS = 4096


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def common_size(vectors: DataFrame) -> int:
    """The most frequent number of components (of ties the smallest), 0 for an empty table."""
    row = vectors.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return row["size"] if row else 0


def sample(vectors: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """At most ``rows`` vectors as a matrix; the bound makes it fit the driver at any input size."""
    got = vectors.orderBy(F.xxhash64("vector")).select("vector").limit(rows).toArrow()["vector"]
    return matrix(got)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    at = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32) if width else np.zeros(len(rows) + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows)])


def unpacked(column: pa.Array | pa.ChunkedArray, dtype) -> np.ndarray:
    """Binary values of one width as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros((0, 0), dtype)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype).reshape(len(column), -1)


def in_groups(keys: int, process: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None]):
    """A mapInArrow function over partitions sorted by their first ``keys`` integer columns.

    ``process`` gets whole groups only: a table and the row numbers where its groups start, and its end.
    A group is held in memory, so callers bound its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            table = table.combine_chunks()
            new = np.zeros(len(table), bool)
            for i in range(keys):
                key = table.column(i).to_numpy()
                new[1:] |= key[1:] != key[:-1]
            starts = np.flatnonzero(new)
            last = int(starts[-1]) if len(starts) else 0
            held = table.slice(last)
            if last:
                out = process(table.slice(0, last).combine_chunks(), np.concatenate([[0], starts]))
                if out is not None:
                    yield out
        if held is not None and len(held):
            out = process(held.combine_chunks(), np.array([0, len(held)]))
            if out is not None:
                yield out

    return run
