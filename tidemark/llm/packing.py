"""Best-fit packing: bounded-space online best-fit into sequences of a fixed number of tokens.

Each partition packs its own texts while it reads them, so packing needs no shuffle.
``OPEN`` sequences are open at most; a bitset tells which amounts of free space
occur, and the smallest that fits is one bit operation away. When all are open and none
fits, the fullest closes. The pieces of one chunk of texts are placed by falling length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches
from tidemark.llm.tokens import Encoder
from tidemark.llm.words import chunks

CAPACITY = 2048
OPEN = 2048
END_ID = 0
CHUNK_BYTES = 1 << 20

SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class Bins:
    """The open sequences of one packer."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN, first: int = 0):
        self.capacity, self.most, self.next = capacity, most, first
        self.free: dict[int, list[int]] = defaultdict(list)
        self.mask = self.count = 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of 1 to ``capacity`` tokens."""
        fits = self.mask >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            sequence = self._take(space)
        else:
            if length < self.capacity and self.count >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
            sequence, space = self.next, self.capacity
            self.next += 1
        if space > length:
            self.free[space - length].append(sequence)
            self.mask |= 1 << (space - length)
            self.count += 1
        return sequence, self.capacity - space

    def _take(self, space: int) -> int:
        own = self.free[space]
        sequence = own.pop()
        self.count -= 1
        if not own:
            self.mask &= ~(1 << space)
        return sequence


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a shorter first."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def _pack(tokenizer: str, ranks: str, pattern: str, capacity: int, most: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, ranks, pattern)
        task = TaskContext.get()
        bins = Bins(capacity, most, (task.partitionId() if task else 0) << 40)
        for batch in batches:
            for low, high in chunks(batch.column(1), CHUNK_BYTES):
                ids = encoder.encode(batch.column(1).slice(low, high - low))
                ids = [np.append(x, np.uint32(end_id)) for x in ids]
                rows = [(i, k, s, n) for i, x in enumerate(ids) for k, (s, n) in enumerate(cuts(len(x), capacity))]
                spots: list[tuple[int, int]] = [(0, 0)] * len(rows)
                for r in sorted(range(len(rows)), key=lambda r: -rows[r][3]):
                    spots[r] = bins.place(rows[r][3])
                owner = pa.array([low + r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(owner),
                        pa.array([r[1] for r in rows], pa.int32()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([r[3] for r in rows], pa.int64()),
                        pa.array([ids[i][s : s + n].astype("<u4").tobytes() for i, _, s, n in rows], pa.binary()),
                        pa.array([s for s, _ in spots], pa.int64()),
                        pa.array([o for _, o in spots], pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
                )

    return run


def pack(documents: DataFrame, tokenizer: str, ranks: str, pattern: str, capacity: int = CAPACITY, most: int = OPEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian uint32), sequence_id, offset.

    A document is its ids and then ``end_id`` (null and empty texts: that alone). Repeated
    rows are documents of their own, and a null doc_id stays null. Other columns are not read.
    """
    docs = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(tokenizer, ranks, pattern, capacity, most, end_id), SCHEMA)
