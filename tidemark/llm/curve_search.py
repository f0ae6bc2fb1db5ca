"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto a few random orthonormal axes, another set for each
curve, turned into cells by the axes' quantiles (from a bounded sample), shifted
at random, and ordered along a Hilbert curve. Each curve is cut into ranges of about `RANGE` vectors
at positions of a bounded sample. A query looks into its own range and ``reach`` ranges on either
side, on every curve used; the candidates of all windows are merged and ranked by the exact distance of the
original vectors.

How far to look is measured, not assumed: the exact answers of at most `ASKED` queries (one pass over the vectors)
tell for each number of curves the reach that finds `RECALL` of them, and the number of curves
with the least work is used, two at least: distances to all queries, and the copy of a vector that each curve takes. Where vectors have structure, windows are a few ranges, a
fixed number of rows at any size. Isotropic vectors have none that an order could use; there the
windows become a share of all rows, and the search close to a full one, which no ordering avoids.

Queries come to the vectors of a range in blocks, so a task holds one range's block of at most `BLOCK`
vectors and a part of a batch of queries, whatever their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialize
from tidemark.llm.hilbert import curve_keys
from tidemark.llm.vectors import common_size, matrix, packed, sample, unpacked, usable

CURVES, AXES, BITS = 8, 4, 12
NEAREST = 10
#: Vectors of a range, and ranges at most; beyond both, a range is dealt to several blocks of `BLOCK` vectors.
RANGE, RANGES, BLOCK = 1024, 4096, 16384
#: Vectors whose positions cut the curves, queries that are answered exactly to measure the reach, and the share of their answers to find.
CUT_ROWS, ASKED, RECALL = 65_536, 256, 0.95
#: Components that the sample holds at most, in all.
CUT_VALUES = 1 << 22
#: Distances that cost as much as a copy of a vector.
COPY = 200
#: Distances that are held at once.
CELLS = 1 << 21


class Curves:
    """The projections, shifts and quantiles of all curves."""

    def __init__(self, fitted: np.ndarray, curves: int = CURVES, axes: int = AXES, bits: int = BITS, seed: int = 3):
        rng = np.random.default_rng(seed)
        size = fitted.shape[1]
        self.axes, self.bits = min(axes, size), bits
        self.turns = [np.linalg.qr(rng.normal(size=(size, size)))[0][:, : self.axes] for _ in range(curves)]
        self.shifts = rng.random((curves, self.axes))
        self.quantiles = [np.sort(fitted @ turn, axis=0) for turn in self.turns]

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Positions (rows x curves, int64) on all curves."""
        out = np.zeros((len(vectors), len(self.turns)), np.int64)
        for c, turn in enumerate(self.turns):
            at = vectors @ turn
            share = np.stack([np.searchsorted(self.quantiles[c][:, a], at[:, a]) / max(len(self.quantiles[c]), 1) for a in range(self.axes)], axis=1)
            cells = ((share + self.shifts[c]) / 2 * (1 << self.bits)).astype(np.int64)
            out[:, c] = curve_keys(np.minimum(cells, (1 << self.bits) - 1), self.bits).view(np.int64)
        return out


def _cuts(positions: np.ndarray, ranges: int) -> np.ndarray:
    """Positions at which a curve is cut into ranges of equal numbers of the sample's vectors."""
    own = np.sort(positions)
    return np.unique(own[(np.arange(1, ranges) * len(own)) // ranges]) if len(own) else own


def _distances(asked: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances (asked x vectors), rounded as matrix products round."""
    square = (asked * asked).sum(axis=1)[:, None] + (vectors * vectors).sum(axis=1)[None, :] - 2 * (asked @ vectors.T)
    return np.sqrt(np.maximum(square, 0))


def _exact(curves: Curves, asked: np.ndarray, k: int):
    """Of each batch, the k + 1 vectors nearest to each asked one: its number, the distance, the positions."""
    names = ["asked", "distance", *(f"k{c}" for c in range(len(curves.turns)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 4096):
                vectors = matrix(batch.column(0).slice(low, 4096))
                far = _distances(asked, vectors)
                near = np.argpartition(far, min(k, len(vectors) - 1), axis=1)[:, : k + 1]
                keys = curves.keys(vectors)
                owner = np.repeat(np.arange(len(asked), dtype=np.int32), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.take_along_axis(far, near, axis=1).ravel()), *(pa.array(keys[near.ravel(), c]) for c in range(keys.shape[1]))], names)

    return run


def measured_reach(fit: DataFrame, curves: Curves, edges: list[np.ndarray], asked: np.ndarray, k: int, recall: float = RECALL, queries: float = 1e6) -> tuple[int, int]:
    """(curves to use, reach in ranges) that find ``recall`` of the asked vectors' k nearest with the least work for so many queries."""
    n = len(edges)
    names = [f"k{c}" for c in range(n)]
    schema = "asked int, distance double, " + ", ".join(f"{x} long" for x in names)
    best = Window.partitionBy("asked").orderBy("distance", *names)
    # Rank filters prune before the shuffle: at most k + 1 rows of each asked vector leave a task.
    found = fit.select("vector").mapInArrow(_exact(curves, asked, k), schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).toArrow()
    own = curves.keys(asked)[found["asked"].to_numpy()]
    # An asked vector is its own nearest, always in reach; it is left out.
    other = found["rank"].to_numpy() > 1
    at = np.stack([np.searchsorted(edges[c], found[names[c]].to_numpy(), "right") for c in range(n)], axis=1)[other]
    home = np.stack([np.searchsorted(edges[c], own[:, c], "right") for c in range(n)], axis=1)[other]
    # A window at an end of its curve reaches further on the other side.
    room = np.where(at > home, at, np.array([len(e) for e in edges]) - at)
    away = np.minimum(np.abs(at - home), -(-room // 2))
    if not len(away):
        return min(2, n), 0
    plans = []
    for used in range(min(2, n), n + 1):
        nearest_window = np.sort(away[:, :used].min(axis=1))
        reach = int(nearest_window[min(len(away) - 1, int(np.ceil(recall * len(away))))])
        ranges = [len(edges[c]) + 1 for c in range(used)]
        plans.append((queries * sum(min(2 * reach + 1, r) / r for r in ranges) + COPY * used, used, reach))
    return min(plans)[1:]


_BLOCKS = "curve int, cut int, salt int, query boolean, ids array<long>, packed binary"


def _spread(curves: Curves, edges: list[np.ndarray], reach: int, salts: int, query: bool, kind: type):
    """Rows of (curve, cut, salt): a vector in its own range, a query in its window; components are packed as ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 2048):
                part = batch.slice(low, 2048)
                vectors = matrix(part.column(0))
                keys, binary, n = curves.keys(vectors), packed(vectors.astype(kind)), len(part)
                for c, own in enumerate(edges):
                    cut = np.searchsorted(own, keys[:, c], "right")
                    if query:
                        width = min(2 * reach + 1, len(own) + 1)
                        first = np.clip(cut - reach, 0, len(own) + 1 - width)
                        owner = np.repeat(np.arange(n), width * salts)
                        cut = np.repeat((first[:, None] + np.arange(width)).ravel(), salts)
                        salt = np.tile(np.arange(salts), n * width)
                    else:
                        owner, salt = np.arange(n), part.column(2).to_numpy() % salts
                    for at in range(0, len(owner), 8192):
                        some = pa.array(owner[at : at + 8192])
                        columns = [np.full(len(some), c), cut[at : at + 8192], salt[at : at + 8192]]
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(x.astype(np.int32)) for x in columns), pa.array(np.full(len(some), query)), part.column(1).take(some), binary.take(some)],
                            ["curve", "cut", "salt", "query", "ids", "packed"],
                        )

    return run


class _Held:
    """The vectors of one block."""

    def __init__(self, key: tuple):
        self.key, self.parts, self.ids, self.vectors = key, [], [], None

    def add(self, ids: list, vectors: np.ndarray) -> None:
        self.ids += ids
        self.parts.append(vectors)

    def answer(self, asked: list[int], queries: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        if self.vectors is None:
            self.vectors = np.concatenate(self.parts)
            self.parts = []
        step = max(1, CELLS // len(self.vectors))
        # A query's own class may be among the nearest, and rounding may swap close ones.
        take = min(k + 6, len(self.vectors))
        for low in range(0, len(asked), step):
            q = queries[low : low + step]
            near = np.argpartition(_distances(q, self.vectors), take - 1, axis=1)[:, :take]
            exact = np.sqrt(((q[:, None, :] - self.vectors[near]) ** 2).sum(axis=2))
            for own, far, rows in zip(asked[low : low + step], exact, near, strict=True):
                for d, x in sorted((d, x) for d, j in zip(far, rows, strict=True) for x in self.ids[j] if x != own)[:k]:
                    yield own, x, d


def _search(k: int, kind: type):
    """Over partitions sorted by block, in each the vectors before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(())
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            ids, vectors = batch.column(4).to_pylist(), unpacked(batch.column(5), kind).astype(np.float64)
            new = np.ones(len(batch), bool)
            new[1:] = (key[1:] != key[:-1]).any(axis=1) | (asks[1:] != asks[:-1])
            starts = np.flatnonzero(new).tolist()
            out: list[tuple[int, int, float]] = []
            for low, high in zip(starts, [*starts[1:], len(batch)], strict=True):
                own = tuple(key[low])
                if own != held.key:
                    held = _Held(own)
                if not asks[low]:
                    held.add(ids[low:high], vectors[low:high])
                elif held.ids:
                    out += held.answer([x[0] for x in ids[low:high]], vectors[low:high], k)
            if out:
                q, v, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(embeddings: DataFrame, every: int = 100, k: int = NEAREST, curves: int = CURVES, range_rows: int = RANGE, recall: float = RECALL) -> DataFrame:
    """The k nearest found of each query (vec_id divisible by ``every``): query_id, rank, vec_id, score.

    Candidates are all rows with another vec_id; score is the Euclidean distance in
    double precision, ties go to the smaller vec_id. Vectors that are null, empty, zero,
    hold null or non-finite components, or have another length than most take no part, nor do
    rows without an id. Of a vec_id that repeats, the smallest vector asks. Equal vectors are one
    class, of which the k + 1 smallest ids are enough for any answer.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    # The rank filter prunes before the shuffle, so a vector that a third of all rows share stays small.
    order = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.distinct().withColumn("place", order).where(F.col("place") <= k + 1)
    classes = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = materialize(classes, "curves-classes")
    size = common_size(classes)
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fit = classes.where(F.size("vector") == size)
    n = fit.count()
    drawn = sample(fit, max(1, min(CUT_ROWS, CUT_VALUES // size)))  # in order of a hash, so its first rows are a sample too
    fitted = Curves(drawn[:4096], curves)
    ranges = min(-(-n // range_rows), RANGES)
    edges = [_cuts(x, ranges) for x in fitted.keys(drawn).T]
    used, reach = measured_reach(fit, fitted, edges, drawn[:ASKED], k, recall, n / every)
    edges = edges[:used]
    fitted.turns = fitted.turns[:used]
    salts = max(1, -(-n // (ranges * BLOCK)))
    # Floats travel as they came; they are doubles again before anything is computed.
    kind = np.float32 if embeddings.schema["embedding"].dataType.elementType == T.FloatType() else np.float64
    asked = rows.where((F.col("vec_id") % every == 0) & (F.size("vector") == size)).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    left = asked.select("vector", F.array("vec_id").alias("ids")).mapInArrow(_spread(fitted, edges, reach, salts, True, kind), _BLOCKS)
    right = fit.select("vector", "ids", F.pmod(F.xxhash64("vector"), F.lit(1 << 30)).alias("salt")).mapInArrow(_spread(fitted, edges, reach, salts, False, kind), _BLOCKS)
    group = ["curve", "cut", "salt"]
    blocks = left.unionByName(right).repartition(*group).sortWithinPartitions(*group, "query")
    found = blocks.mapInArrow(_search(k, kind), "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
