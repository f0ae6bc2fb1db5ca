"""Shared plumbing: presence maps, joins that spare texts a shuffle, and connected components over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import discard, materialize

__all__ = ["connected_components", "marked", "materialize", "small_batches", "split_join"]

#: Bits of a presence map: at most 2**18 rows of two longs at any size of the input, so it may be broadcast.
MAP_BITS = 1 << 24
_BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands texts to Python in Arrow batches of at most 4 MB, unless it has a size of its own.

    A batch exists several times at once (in the JVM, in transit, in the worker with its
    results), so at the default of 64 MB it is the largest part of a worker's memory. The
    setting is read when a result is computed, which is after its operator has returned.
    """
    conf = df.sparkSession.conf
    if conf.get(_BYTES_PER_BATCH).lower() in ("64mb", "64m", "67108864", "67108864b"):
        conf.set(_BYTES_PER_BATCH, "4m")
    return df


def marked(df: DataFrame, keys: DataFrame, on: list[str], name: str = "_maybe", bits: int = MAP_BITS) -> DataFrame:
    """``df`` with a boolean: false if the row's ``on`` columns are certainly not among those of ``keys``.

    A map with one bit for each hash is built from ``keys``; its size is ``bits``, whatever the
    tables' sizes. The fuller it gets, the more rows are true without being there.
    """
    spot = F.pmod(F.xxhash64(*on), F.lit(bits))
    own = keys.select(F.shiftright(spot, 6).alias("_word"), F.pmod(spot, F.lit(64)).cast("int").alias("_bit"))
    words = own.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    rows = df.select("*", F.shiftright(spot, 6).alias("_word"), F.pmod(spot, F.lit(64)).cast("int").alias("_bit"))
    here = F.coalesce(F.expr("shiftright(_bits, _bit) & 1 = 1"), F.lit(False))
    return rows.join(F.broadcast(words), "_word", "left").select(*[F.col(c) for c in df.columns], here.alias(name))


def split_join(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """``big`` joined with a written table; how: inner, left, left_semi or left_anti.

    Rows of ``big`` that certainly have no partner take no part in the shuffle: for ``left``
    they get nulls. Both sides of the join itself stay splittable where a key is hot.
    """
    rows = marked(big, small, on)
    met = rows.where("_maybe").drop("_maybe").join(small.hint("merge"), on, how)
    if how in ("inner", "left_semi"):
        return met
    rest = rows.where("not _maybe").drop("_maybe")
    if how == "left":
        rest = rest.select(*rest.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in small.schema if f.name not in on])
    return met.select(*rest.columns).unionByName(rest)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every end of ``edges`` (columns a, b of one orderable type); root is the component's smallest node.

    Each round points every node at its smallest neighbour, follows the pointers to
    their ends by doubling, and contracts the edges onto those ends. At least half of
    the nodes of every unfinished component vanish in a round, so the number of rounds
    is logarithmic. All steps are aggregations and joins on written tables: a hub with
    very many edges is pre-aggregated, and both join sides stay splittable. A round's tables
    are deleted when the next one's are written.
    """
    kind = edges.schema["a"].dataType.simpleString()
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    pairs = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    maps: list[DataFrame] = []
    while pairs.count():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
        pointer = held = materialize(pointer, f"{name}-pointer")
        while True:
            up = pointer.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = pointer.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved"))
            jumped = materialize(jumped, f"{name}-jump")
            discard(held)
            pointer, held = jumped.select("node", "root"), jumped
            if not jumped.where("moved").limit(1).count():
                break
        maps.append(pointer)
        left = pairs.join(pointer.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        left = left.join(pointer.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        left = left.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        before, pairs = pairs, materialize(left, f"{name}-edges")
        discard(before)
    discard(pairs)
    if not maps:
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    out = maps[0]
    for later in maps[1:]:
        up = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return materialize(out, name) if len(maps) > 1 else out
