"""Alignment of two tokenizers over the same bytes.

A text is encoded twice. Each byte gets a label: no token ends there, one of A, one of B, or
both. A regular expression scans the label string for spans up to each both-label; the labels counted in a
span say how many tokens of A and of B make one group. A byte where any token ends closes
one overlap of an A token with a B token, so links are read off the labels too.

How often each pair of ids is linked corpus-wide is a sum by Spark. Texts are worked on in units of
some megabytes: a unit asks for the totals of its distinct pairs once, and keeps for each document
only which of them it holds how often, so what is shuffled grows with the units' vocabularies
and not with the links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, small_batches
from tidemark.llm.tokens import Encoder
from tidemark.llm.words import buffers, chunks

#: Text bytes that share one list of distinct pairs, and those that are held as arrays at once; a longer single text is one of its own.
UNIT_BYTES, CHUNK_BYTES = 4 << 20, 1 << 18
#: Pairs in a row of a unit's list.
SLICE = 1 << 15

# Labels of a byte by (A ends here) + 2 * (B ends here).
LABELS = np.frombuffer(b".abx", np.uint8)
SPAN = re.compile(rb"[^x]*x")


class Tables:
    """Of one vocabulary: each id's bytes, as one run of bytes with offsets, and its decimal digits."""

    def __init__(self, entries: list[bytes]):
        self.size = np.fromiter(map(len, entries), np.int64, len(entries))
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        size = self.size[ids]
        before = np.cumsum(size) - size
        return self.data[np.repeat(self.at[ids] - before, size) + np.arange(size.sum())]


class Pair:
    """Both tokenizers; one for each worker process."""

    _own: dict[tuple[str, ...], Pair] = {}

    @classmethod
    def of(cls, files: tuple[str, str, str], pattern: str) -> Pair:
        if files not in cls._own:
            cls._own[files] = cls(*map(SparkFiles.get, files), pattern)
        return cls._own[files]

    def __init__(self, tokenizer: str, ranks: str, pieces: str, pattern: str):
        from sentencepiece import SentencePieceProcessor

        self.a = Encoder.of(tokenizer, ranks, pattern)
        entries = [b""] * (max(self.a.ranks.values()) + 2)
        for entry, i in self.a.ranks.items():
            entries[i] = entry
        self.bytes_a = Tables(entries)
        self.b = SentencePieceProcessor(model_file=pieces)
        named = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = Tables([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)])

    def encode(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of A for a space and each text, and those of B for the text, which adds that space itself."""
        a = self.a.encode(pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
        b = self.b.encode(texts.to_pylist(), num_threads=1)
        return a, [np.array(x, np.int64) for x in b]


def labels(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> bytes:
    """The label string of ``size`` bytes, from the numbers of bytes after which tokens end."""
    kind = np.zeros(size, np.uint8)
    kind[ends_a - 1] = 1
    kind[ends_b - 1] += 2
    return LABELS[kind].tobytes()


def digits(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, end of each id in it): decimal ids, each followed by its byte of ``ends``."""
    width = len(str(int(ids.max(initial=0))))
    power = 10 ** np.arange(width - 1, -1, -1)
    out = np.empty((len(ids), width + 1), np.uint8)
    out[:, :width] = ids[:, None] // power % 10 + 48
    out[:, width] = ends
    length = np.maximum((ids[:, None] >= power).sum(axis=1), 1)
    return out[np.arange(width + 1) >= (width - length)[:, None]], np.cumsum(length + 1)


class Aligned:
    """The texts of one chunk whose bytes both tokenizers give back; ``rows`` has their numbers in the chunk."""

    def __init__(self, pair: Pair, texts: pa.Array):
        self.rows = np.flatnonzero(np.asarray(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)))
        texts = texts.take(pa.array(self.rows))
        a, b = pair.encode(texts) if len(texts) else ([], [])
        # Length first, then bytes.
        data, at = buffers(texts)
        size = np.diff(at) + 1
        keep = [k for k in range(len(a)) if pair.bytes_a.size[a[k]].sum() == size[k] == pair.bytes_b.size[b[k]].sum()]
        spaced = [np.concatenate([[32], data[at[k] : at[k + 1]]]) for k in keep]
        if keep:
            whole, cut = np.concatenate(spaced), np.concatenate([[0], np.cumsum(size[keep])])[:-1]
            same = (pair.bytes_a.spelled(np.concatenate([a[k] for k in keep])) == whole) & (pair.bytes_b.spelled(np.concatenate([b[k] for k in keep])) == whole)
            keep = np.array(keep)[np.logical_and.reduceat(same, cut)].tolist()
        self.rows = self.rows[keep]
        none = np.zeros(0, np.int64)
        self.a = np.concatenate([none, *(a[k] for k in keep)]).astype(np.int64)
        self.b = np.concatenate([none, *(b[k] for k in keep)])
        self.n_a = np.fromiter((len(a[k]) for k in keep), np.int64, len(keep))
        self.n_b = np.fromiter((len(b[k]) for k in keep), np.int64, len(keep))
        self.size = size[keep]
        ends_a, ends_b = np.cumsum(pair.bytes_a.size[self.a]), np.cumsum(pair.bytes_b.size[self.b])
        self.labels = labels(ends_a, ends_b, int(self.size.sum()))

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each group its number of A tokens, of B tokens, and the byte after which it ends."""
        ends = np.fromiter((m.end() for m in SPAN.finditer(self.labels)), np.int64)
        kind = np.frombuffer(self.labels, np.uint8)
        out = []
        for letter in b"ab":
            seen = np.concatenate([[0], np.cumsum((kind == letter) | (kind == 120))])
            out.append(np.diff(seen[np.concatenate([[0], ends])]))
        return out[0], out[1], ends

    def digests(self, in_a: np.ndarray, in_b: np.ndarray, per_text: np.ndarray) -> list[str]:
        """The SHA-256 of each text's groups, written ``a1,a2|b1;a3|b2,b3``."""
        if not len(per_text):
            return []
        until_a, until_b = np.cumsum(in_a), np.cumsum(in_b)
        group = np.arange(len(in_a))
        place_a = np.arange(len(self.a)) + np.repeat(until_b - in_b, in_a)
        place_b = np.arange(len(self.b)) + until_a[np.repeat(group, in_b)]
        ids, ends = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), 44, np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        ends[place_a[until_a - 1]], ends[place_b[until_b - 1]] = 124, 59
        text, after = digits(ids, ends)
        text, stop = text.tobytes(), after[(until_a + until_b)[np.cumsum(per_text) - 1] - 1].tolist()
        return [hashlib.sha256(text[low : high - 1]).hexdigest() for low, high in zip([0, *stop[:-1]], stop, strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(A id << 32 | B id, text number) of every overlap, in order."""
        kind = np.frombuffer(self.labels, np.uint8)
        at = np.flatnonzero(kind != LABELS[0])
        ends_a, ends_b = (kind == 97) | (kind == 120), (kind == 98) | (kind == 120)
        # Tokens that ended before a byte come before the one that covers it.
        a, b = (np.cumsum(e)[at] - e[at] for e in (ends_a, ends_b))
        return self.a[a] << 32 | self.b[b], np.searchsorted(np.cumsum(self.size), at, "right")


class Unit:
    """Gathers chunks until they hold `UNIT_BYTES` of text."""

    NAMES = ("unit", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "first", "pairs", "counts")
    SCHEMA = "unit long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held binary, first int, pairs array<long>, counts array<long>"
    TYPES = (*[pa.int64()] * 6, pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def __init__(self, pair: Pair, number: int):
        self.pair, self.number, self.bytes = pair, number, 0
        self.ids: list[pa.Array] = []
        self.numbers: list[np.ndarray] = []
        self.digests: list[str] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, doc_id: pa.Array, texts: pa.Array) -> None:
        found = Aligned(self.pair, texts)
        in_a, in_b, ends = found.groups()
        per_text = np.bincount(np.searchsorted(np.cumsum(found.size), ends - 1, "right"), minlength=len(found.rows))
        pairs, owner = found.links()
        numbers = np.zeros((4, len(texts)), np.int64)
        numbers[:, found.rows] = found.n_a, found.n_b, per_text, np.bincount(owner, minlength=len(found.rows))
        digests = [""] * len(texts)
        for row, digest in zip(found.rows.tolist(), found.digests(in_a, in_b, per_text), strict=True):
            digests[row] = digest
        distinct, code = np.unique(pairs, return_inverse=True)
        held, times = np.unique(owner * max(len(distinct), 1) + code, return_counts=True)
        row = self.rows + found.rows[held // max(len(distinct), 1)]
        self.parts.append((distinct, *(x.astype(np.int32) for x in (held % max(len(distinct), 1), row, times))))
        self.ids.append(doc_id)
        self.numbers.append(numbers)
        self.digests += digests
        self.rows += len(texts)
        self.bytes += pc.sum(pc.binary_length(texts)).as_py() or 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        """A row for each document, with the places of its pairs in the unit's list and how often it holds each; then the list."""
        pairs = np.unique(np.concatenate([d for d, *_ in self.parts]))
        counts = np.zeros(len(pairs), np.int64)
        place, owner, times = [], [], []
        for distinct, code, row, n in self.parts:
            at = np.searchsorted(pairs, distinct).astype(np.int32)[code]
            np.add.at(counts, at, n)
            place.append(at)
            owner.append(row)
            times.append(n)
        owner = np.concatenate(owner)
        packed = held_bytes(np.concatenate(place), np.concatenate(times), owner, self.rows)
        numbers = np.concatenate(self.numbers, axis=1)
        ids = pa.concat_arrays(self.ids)
        for low in range(0, self.rows, 2048):
            high = min(low + 2048, self.rows)
            own = [pa.array(np.full(high - low, self.number)), ids.slice(low, high - low), *(pa.array(x[low:high]) for x in numbers), pa.array(self.digests[low:high])]
            yield self._batch([*own, pa.array(packed[low:high], pa.binary())], high - low)
        for low in range(0, len(pairs), SLICE):
            lists = [pa.array([x[low : low + SLICE]], pa.list_(pa.int64())) for x in (pairs, counts)]
            empty = [pa.nulls(1, t) for t in self.TYPES[1:8]]
            yield self._batch([pa.array([self.number]), *empty, pa.array([low], pa.int32()), *lists], 1)

    def _batch(self, columns: list[pa.Array], rows: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns + [pa.nulls(rows, t) for t in self.TYPES[len(columns) :]], list(self.NAMES))


def held_bytes(place: np.ndarray, times: np.ndarray, owner: np.ndarray, rows: int) -> list[bytes]:
    """Of each row its (place, times), ascending: their number, then, compressed, the places' differences and the times, lowest bytes first."""
    cut = np.searchsorted(owner, np.arange(rows + 1))
    step = place.astype("<i4")
    step[1:] -= step[:-1].copy()
    heads = cut[:-1][cut[:-1] < cut[1:]]
    step[heads] = place[heads]
    both = [np.ascontiguousarray(x.astype("<i4")).view(np.uint8).reshape(-1, 4) for x in (step, times)]
    out = []
    for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        plain = np.concatenate([x[low:high].T.ravel() for x in both]).tobytes()
        out.append((high - low).to_bytes(4, "little") + (pa.compress(plain, "zstd", asbytes=True) if plain else b""))
    return out


def held_of(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place, times) of one of `held_bytes`."""
    n = int.from_bytes(packed[:4], "little")
    plain = np.frombuffer(pa.decompress(packed[4:], n * 8, "zstd", asbytes=True) if n else b"", np.uint8)
    planes = plain.reshape(2, 4, n).transpose(0, 2, 1)
    step, times = (np.ascontiguousarray(x).view("<i4").ravel().astype(np.int64) for x in planes)
    return np.cumsum(step), times


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a unit with what its list's totals say about their links."""
    place = answers["place"].to_numpy()
    total, best = np.zeros((2, len(place)), np.int64)
    total[place], best[place] = answers["total"].to_numpy(), answers["best"].to_numpy()
    sums = np.zeros((2, len(docs)), np.int64)
    for k, packed in enumerate(docs["held"].to_pylist()):
        at, times = held_of(packed)
        sums[:, k] = times @ best[at], times @ total[at]
    names = [c.split()[0] for c in RESULT.split(", ")]
    return pa.table([pa.array(sums[names.index(c) - 5]) if c in ("n_best", "count_sum") else docs[c] for c in names], names)


def align(documents: DataFrame, tokenizer: str, ranks: str, pieces: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A: byte-level BPE (``tokenizer``, a file, with its ``ranks`` and ``pattern``) of a space and the text; B: the SentencePiece model
    ``pieces`` of the text. Their files go to the executors once. Texts that are null or empty, or that the tokens of A
    or B don't give back byte for byte (B takes U+2581 for a space), have no tokens: zeros and ''. Repeated rows each come
    back and each count; further columns are not read; an empty table gives an empty one.
    """
    spark = documents.sparkSession
    files = shipped(spark, tokenizer, ranks, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(files, pattern)
        # A table's units have different numbers, whatever attempt of a task wrote them.
        number = TaskContext.get().partitionId() << 32
        unit = Unit(pair, number)
        for batch in batches:
            text = batch.column(1)
            for low, high in chunks(text, CHUNK_BYTES):
                unit.add(batch.column(0).slice(low, high - low), text.slice(low, high - low))
                if unit.bytes >= UNIT_BYTES:
                    yield from unit.batches()
                    number += 1
                    unit = Unit(pair, number)
        if unit.rows:
            yield from unit.batches()
        # The worker goes on to other tasks, of other kinds too.
        pair.a.forget()

    docs = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = materialize(docs.mapInArrow(run, Unit.SCHEMA), "alignment-units")
    each = units.where("first is not null").select("unit", "first", F.posexplode(F.arrays_zip("pairs", "counts")).alias("pos", "of"))
    asked = each.select("unit", (F.col("first") + F.col("pos")).alias("place"), F.col("of.pairs").alias("pair"), F.col("of.counts").alias("n"))
    totals = materialize(asked.groupBy("pair").agg(F.sum("n").alias("total")), "alignment-totals").withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    # One row for each id of B's vocabulary at most.
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    judged = totals.join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    answers = asked.select("unit", "place", "pair").join(judged.hint("merge"), "pair").select(F.col("unit").alias("of_unit"), "place", "total", "best")
    own = units.where("first is null").select("unit", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held")
    return own.groupBy("unit").cogroup(answers.groupBy("of_unit")).applyInArrow(_finish, RESULT)


def shipped(spark: SparkSession, *paths: str) -> tuple[str, ...]:
    """The names under which executors find copies of the driver's files."""
    for path in paths:
        spark.sparkContext.addFile(path)
    return tuple(path.rsplit("/", 1)[-1] for path in paths)
