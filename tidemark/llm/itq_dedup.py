"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

1. Equal vectors of a label are one class with a count.
2. On a bounded sample of unit vectors, less their label's mean, rotations are learned (principal axes, then alternating sign
   codes and orthogonal Procrustes), whose sign bits are balanced codes. Substrings of some bits
   are the tables' keys, and the first bits a class's code. How often a pair at the threshold differs in a bit is
   measured on partners planted beside the sample's vectors; the number of tables, the Hamming radius and the bits of a
   code follow: such a pair misses all tables, or the radius, with probability `MISS`, and unlike vectors of a label lie outside the radius.
3. Only keys, ids and codes go to the tables. Classes of one bucket within the radius are
   candidates; a bucket returns a forest of them, never the pairs. Connected components over
   the forests make groups, so no candidate pair is lost, and a pair that no table joined still meets in its group.
4. The classes in groups fetch their original vectors once, and once more for each further
   block of a large group. Every pair of a group meets once, by exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, materialize, split_join
from tidemark.llm.vectors import SAMPLE_ROWS, common_size, in_groups, matrix, packed, unpacked, usable
from tidemark.llm.words import mix, signed

COSINE = 0.93
MISS = 1e-3
#: The share of pairs at the threshold that may exceed the radius where codes can't tell all others from a label's strangers.
DENSE_MISS = 1e-2
#: Bits of a code, shipped as longs: the first of these that tells unlike vectors of a label from pairs at the threshold by `APART` standard deviations.
CODES, APART = (128, 256, 512, 1024), 5.5
#: Sample rows of a label that its own mean needs; pairs planted.
OWN_MEAN, PLANTED = 64, 8192
#: Classes of one label per bucket that the substring length aims at; rows of a bucket's block, and of a group's.
BUCKET, BUCKET_BLOCK, GROUP_BLOCK = 2048, 4096, 1024
#: Entries of a distance matrix that are held at once.
CELLS = 1 << 21


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Means:
    """What is taken off unit vectors of a label before they are coded: the mean of its sample rows, or of all where it has few.

    A label whose vectors lie closer together than pairs at the threshold, on average, is left as it is: what is left
    of them would say nothing about such pairs.
    """

    def __init__(self, unit: np.ndarray, labels: np.ndarray, cosine: float):
        self.size, limit = unit.shape[1], 1 - 2 * (1 - cosine)
        found = {int(v): unit[labels == v].mean(axis=0) for v, n in zip(*np.unique(labels, return_counts=True), strict=True) if n >= OWN_MEAN}
        self.other = unit.mean(axis=0) if len(unit) >= OWN_MEAN else np.zeros(self.size)
        self.keys = np.array(sorted(found), np.int64)
        self.rows = np.array([found[int(k)] for k in self.keys] + [self.other])
        self.rows[(self.rows**2).sum(axis=1) > limit] = 0.0

    def centred(self, unit: np.ndarray, labels: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, labels), max(len(self.keys) - 1, 0))
        known = self.keys[at] == labels if len(self.keys) else np.zeros(len(labels), bool)
        return unit - self.rows[np.where(known, at, len(self.keys))]


def learn_rotations(data: np.ndarray, steps: int = 30, seed: int = 5) -> Iterator[np.ndarray]:
    """Rotations (size x size) without end, by iterative quantisation of centred rows, from different random starts."""
    size = data.shape[1]
    axes = np.linalg.eigh(data.T @ data)[1][:, ::-1] if len(data) else np.eye(size)
    rng = np.random.default_rng(seed)
    own = data @ axes
    while True:
        turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
        for _ in range(steps if len(data) > size else 0):
            left, _, right = np.linalg.svd(np.where(own @ turn >= 0, 1.0, -1.0).T @ own)
            turn = (left @ right).T
        yield axes @ turn


def substring_bits(classes: int, labels: int, size: int) -> int:
    """Bits grow with the logarithm of the classes of a label, so buckets don't grow."""
    return min(max(round(math.log2(max(classes / max(labels, 1) / BUCKET, 1))), 6), size)


def partners(unit: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """A unit vector at exactly this cosine beside each row: half in a random direction, half towards another row."""
    aside = rng.normal(size=unit.shape)
    aside[::2] = unit[rng.integers(0, len(unit), len(aside[::2]))] - unit[::2] + 1e-9 * aside[::2]
    aside -= (aside * unit).sum(axis=1, keepdims=True) * unit
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    return cosine * unit + math.sqrt(max(1 - cosine * cosine, 0.0)) * aside / np.maximum(length, 1e-300)


class Coding:
    """Means, rotations, bits of a substring, tables, bits of a code and Hamming radius, fitted on a sample."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, width: int, cosine: float, miss: float = MISS):
        rng = np.random.default_rng(8)
        unit = unit_rows(vectors)
        self.size, self.width = unit.shape[1], width
        self.means = Means(unit, labels, cosine)
        data = self.means.centred(unit, labels)
        row = np.resize(np.arange(len(unit)), PLANTED)
        beside = self.means.centred(partners(unit[row], cosine, rng), labels[row])
        strangers = rng.integers(0, len(unit), (2, PLANTED))
        strangers = strangers[:, (strangers[0] != strangers[1]) & (labels[strangers[0]] == labels[strangers[1]])]
        more, self.rotations = learn_rotations(data), []
        for self.bits in CODES:
            self.rotations += islice(more, -(-self.bits // self.size) - len(self.rotations))
            own = signs(data, self.rotations)[:, : self.bits]
            apart = (own[row] != signs(beside, self.rotations)[:, : self.bits]).sum(axis=1)
            # Beyond what the planted pairs can show, some bits more.
            self.radius = int(np.quantile(apart, max(1 - miss, 0.0), method="higher")) + (self.bits // 32 if miss * PLANTED < 1 else 0)
            unlike = (own[strangers[0]] != own[strangers[1]]).sum(axis=1)
            if not len(unlike) or unlike.mean() - APART * unlike.std() > self.radius:
                break
        else:
            # A dense label: a radius for all but `DENSE_MISS` of such pairs keeps its strangers apart.
            self.radius = min(self.radius, int(np.quantile(apart, 1 - max(miss, DENSE_MISS), method="higher")))
        # A planted pair shares a substring with the probability of its own rate of differing bits.
        same = (1 - np.minimum(apart / self.bits, 0.5)) ** width
        self.tables = 1
        while ((1 - same) ** self.tables).mean() > miss and self.tables < 4096:
            self.tables += 1
        self.rotations += islice(more, max(-(-self.tables // (self.size // width)) - len(self.rotations), 0))

    def signs(self, vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return signs(self.means.centred(unit_rows(vectors), labels), self.rotations)


def signs(centred: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([centred @ r >= 0 for r in rotations], axis=1)


def codes(bits: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` sign bits of each row, as unsigned longs."""
    return np.packbits(np.ascontiguousarray(bits[:, :size]), axis=1).view(np.uint64)


def substrings(bits: np.ndarray, size: int, width: int, tables: int) -> np.ndarray:
    """Substrings (rows x tables) of ``width`` sign bits; none crosses two rotations of ``size`` bits."""
    each = size // width
    starts = [k // each * size + k % each * width for k in range(tables)]
    return np.stack([bits[:, s : s + width] @ (1 << np.arange(width, dtype=np.uint64)) for s in starts], axis=1)


def _index(coding: Coding):
    names = [f"c{k}" for k in range(coding.bits // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 4096):
                part = batch.slice(low, 4096)
                label = part.column(0).to_numpy()
                bits = coding.signs(matrix(part.column(2)), label)
                parts = substrings(bits, coding.size, coding.width, coding.tables)
                code = signed(codes(bits, coding.bits))
                with np.errstate(over="ignore"):
                    key = mix(parts * np.uint64(0x9E3779B97F4A7C15) + np.arange(coding.tables, dtype=np.uint64))
                    key = mix(key + label.astype(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93))
                owner = np.repeat(np.arange(len(part)), coding.tables)
                ids = part.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(signed(key.ravel())), pa.array(ids[owner]), *(pa.array(c[owner]) for c in code.T)], ["key", "class_id", *names])

    return run, "key long, class_id long, " + ", ".join(f"{c} long" for c in names), names


def roots_of(close: list[np.ndarray], n: int) -> np.ndarray:
    """The smallest node of each node's component in an undirected graph, given as row blocks of its boolean matrix."""
    root = np.arange(n)
    while True:
        low, new = 0, root.copy()
        for rows in close:
            linked = np.where(rows, root[None, :], n).min(axis=1, initial=n)
            new[low : low + len(rows)] = np.minimum(new[low : low + len(rows)], linked)
            low += len(rows)
        # A node that moved takes its old root along.
        np.minimum.at(new, root, new)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _row_blocks(n: int, m: int) -> Iterator[tuple[int, int]]:
    step = max(1, CELLS // max(m, 1))
    for low in range(0, n, step):
        yield low, min(low + step, n)


def _candidates(radius: int, names: list[str]):
    """A forest of the pairs of a bucket's blocks within the radius."""

    def process(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        side, ids = table["side"].to_numpy(), table["class_id"].to_numpy()
        code = np.stack([table[c].to_numpy().view(np.uint64) for c in names], axis=1)
        a, b = [], []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if high - low < 2:
                continue
            own = code[low:high]
            apart = side[low:high]
            # Two blocks meet across only; each has met itself elsewhere.
            across = None if apart[0] == 1 else apart[:, None] != apart[None, :]
            close = []
            for i, j in _row_blocks(high - low, high - low):
                near = sum(np.bitwise_count(own[i:j, None, k] ^ own[None, :, k]).astype(np.int16) for k in range(len(names))) <= radius
                close.append(near if across is None else near & across[i:j])
            root = roots_of(close, high - low)
            moved = np.flatnonzero(root != np.arange(high - low))
            a.append(ids[low + moved])
            b.append(ids[low + root[moved]])
        if not sum(map(len, a)):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return process


def _meet(cosine: float):
    """Links of each class (a, n) and a forest of them (a, b), of two blocks of a group."""

    def process(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch | None:
        side, ids, copies, label = (table[c].to_numpy() for c in ("side", "class_id", "copies", "label"))
        vectors = unpacked(table["packed"], np.float64)
        out_a, out_b, out_n = [], [], []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            n = high - low
            if n < 2:
                continue
            own, apart = vectors[low:high], side[low:high]
            length = np.sqrt((own * own).sum(axis=1))
            close, links = [], np.zeros(n, np.int64)
            for i, j in _row_blocks(n, n):
                near = (own[i:j] @ own.T >= cosine * (length[i:j, None] * length[None, :])) & (label[low + i : low + j, None] == label[None, low:high])
                if apart[0] == 1:
                    near[np.arange(j - i), np.arange(i, j)] = False
                else:
                    near &= apart[i:j, None] != apart[None, :]
                links[i:j] = near @ copies[low:high]
                close.append(near)
            root = roots_of(close, n)
            moved = np.flatnonzero(root != np.arange(n))
            some = np.flatnonzero(links)
            out_a += [ids[low + some], ids[low + moved]]
            out_b += [np.full(len(some), -1), ids[low + root[moved]]]
            out_n += [links[some], np.zeros(len(moved), np.int64)]
        if not sum(map(len, out_a)):
            return None
        b = np.concatenate(out_b)
        own_n = np.concatenate(out_n)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(b, mask=own_n > 0), pa.array(own_n)], ["a", "b", "n"])

    return process


def _paired(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (with ``cuts`` blocks to be cut into) once for each pair of blocks that theirs is of: p, q, side (0 left, 1 both, 2 right)."""
    placed = rows.withColumn("block", F.pmod(F.xxhash64(name), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    side = F.when(F.col("block") == F.col("other"), 1).when(F.col("block") < F.col("other"), 0).otherwise(2)
    return placed.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")).withColumn("side", side)


def _cut(rows: DataFrame, key: str, block: int) -> DataFrame:
    """``rows`` with the number of blocks that their key is cut into: 1 for most."""
    crowded = rows.groupBy(key).count().where(F.col("count") > block).select(key, F.ceil(F.col("count") / block).cast("int").alias("cuts"))
    return split_join(rows, materialize(crowded, "itq-crowded"), [key], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))


def near_duplicate_vectors(embeddings: DataFrame, cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine, in double
    precision, reaches ``cosine``. Vectors that are null, empty, zero, hold null or
    non-finite components, or have another length than most, link with nothing. Rows
    that repeat a vec_id are vectors of their own. Null ids: component_id null, kept true.
    A group of m different vectors that are all near each other costs m * m cosines, as its counts are exact;
    equal vectors cost nothing.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("label"))
    rows = rows.withColumn("usable", usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("d1", F.when(F.col("usable"), F.xxhash64("label", "vector"))).withColumn("d2", F.when(F.col("usable"), F.xxhash64(F.lit(1), "vector", "label")))
    classes = rows.where("usable").groupBy("d1", "d2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    # Once written, the numbers stay as they are.
    classes = materialize(classes.withColumn("class_id", F.monotonically_increasing_id()), "itq-classes")
    size = common_size(classes)
    if not size:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    fit = classes.where(F.size("vector") == size)
    width = substring_bits(fit.count(), fit.agg(F.count_distinct("label")).first()[0], size)
    drawn = fit.orderBy(F.xxhash64("vector"), "label").select("vector", "label").limit(SAMPLE_ROWS).toArrow()
    coding = Coding(matrix(drawn["vector"]), drawn["label"].to_numpy(), width, cosine, miss)
    run, schema, names = _index(coding)
    index = fit.select("label", "class_id", "vector").mapInArrow(run, schema)
    placed = _paired(_cut(index, "key", BUCKET_BLOCK), "class_id").select("key", "p", "q", "side", "class_id", *names)
    order = ["key", "p", "q"]
    chains = placed.repartition(*order).sortWithinPartitions(*order).mapInArrow(in_groups(3, _candidates(coding.radius, names)), "a long, b long")
    groups = connected_components(chains, "itq-groups")

    members = _cut(groups.select(F.col("root").alias("grp"), F.col("node").alias("class_id")), "grp", GROUP_BLOCK)
    members = materialize(members, "itq-members")
    own = split_join(fit, members, ["class_id"], "inner").select("grp", "cuts", "class_id", "label", "copies", "vector")
    met = _paired(own, "class_id").select("grp", "p", "q", "side", "class_id", "label", "copies", "vector")
    order = ["grp", "p", "q"]
    met = met.repartition(*order).sortWithinPartitions(*order).mapInArrow(_packed(in_groups(3, _meet(cosine))), "a long, b long, n long")
    found = materialize(met, "itq-links")
    counts = found.groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("others"))
    roots = connected_components(found.where("b is not null").select("a", "b"), "itq-roots").withColumnRenamed("node", "class_id")
    own = classes.select("d1", "d2", "class_id", "least", "copies").join(counts, "class_id", "left").join(roots, "class_id", "left")
    own = materialize(own.withColumn("root", F.coalesce("root", "class_id")), "itq-own")
    named = own.join(own.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    named = named.select("d1", "d2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _packed(run):
    """``run`` over batches whose last column, lists of doubles, is handed on as binary values."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed(matrix(batch.column(batch.num_columns - 1)))], [*batch.schema.names[:-1], "packed"])

    return lambda batches: run(convert(batches))
