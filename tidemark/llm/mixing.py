"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target t and size s is worth t / s copies. The whole part
is certain; the fraction is rounded by pivots: two documents exchange mass (words) in
a random direction, with probabilities that keep both expectations, until one
fraction is 0 or 1; the other meets the next document. Mass is kept in every exchange,
so a source's words miss its target by less than one document. Documents meet by falling
size, so that what stays open to the end is a small one.

Each bucket of a source is rounded in its own task and leaves at most one open
document; the open ones meet in a reduction tree of ``FAN`` children a node. All
random draws are hashes of ids, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize
from tidemark.llm.words import mix

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents of one source that one task rounds, and children of a node of the tree.
BUCKET_ROWS = 2000
FAN = 32
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count() -> Column:
    """Words of the column ``text``; null: none."""
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """skey, source_size, n_docs, target of each source of ``sizes`` (source, size).

    Sources in order of code points, null last, take the weights in turn and share all
    words; no target exceeds ``most`` times its source, and what is cut off is shared
    again by weight. That fixed point is target = min(most * size, level * weight) for
    the one level at which targets add up, found here by ascending size per weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_source = materialize(by_source, "mixing-sources")
    # One row for each source from here on.
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("cut", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - F.col("cut")) / F.col("open"))
    holds = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    first = F.first(holds, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("target", F.least(F.col("cap"), first * F.col("weight")))
    return rows.select(_key(F.col("source")).alias("skey"), "source_size", "n_docs", F.coalesce("target", F.col("cap")).alias("target"))


def _key(source):
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _uniform(a: int, b: int, level: int) -> float:
    with np.errstate(over="ignore"):
        x = mix(np.array([a % (1 << 64)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b % (1 << 64)))
        return float(mix(x + np.uint64(level + 1))[0] >> np.uint64(11)) / (1 << 53)


def pivot(ids: list[int], mass: list[float], share: list[float], level: int, last: bool) -> list[float]:
    """Round the fractions of one node; all but at most one come back as 0.0 or 1.0, and that one too if it is the last."""
    out = list(share)
    held = None
    draws = None
    for i in range(len(ids)):
        if out[i] <= 0 or out[i] >= 1:
            continue
        if held is None:
            held = i
            continue
        if draws is None:
            with np.errstate(over="ignore"):
                seeds = np.array([x % (1 << 64) for x in ids], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(len(ids), dtype=np.uint64)
                draws = (mix(mix(seeds) + np.uint64(level + 1)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        a, b = held, i
        up = min((1 - out[a]) * mass[a], out[b] * mass[b])
        down = min(out[a] * mass[a], (1 - out[b]) * mass[b])
        if draws[i] * (up + down) < down:
            full, empty = out[a] * mass[a] + up, out[b] * mass[b] - up
            a_done, b_done = (1 - out[a]) * mass[a] <= out[b] * mass[b], out[b] * mass[b] <= (1 - out[a]) * mass[a]
            out[a], out[b] = 1.0 if a_done else full / mass[a], 0.0 if b_done else empty / mass[b]
        else:
            empty, full = out[a] * mass[a] - down, out[b] * mass[b] + down
            a_done, b_done = out[a] * mass[a] <= (1 - out[b]) * mass[b], (1 - out[b]) * mass[b] <= out[a] * mass[a]
            out[a], out[b] = 0.0 if a_done else empty / mass[a], 1.0 if b_done else full / mass[b]
        held = a if 0 < out[a] < 1 else b if 0 < out[b] < 1 else None
    if last and held is not None:
        out[held] = 1.0 if _uniform(ids[held], len(ids), level) < out[held] else 0.0
    return out


def _round(level: int):
    def node(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending")])
        ids = [x or 0 for x in table["doc_id"].to_pylist()]
        last = table["parts"][0].as_py() <= 1
        share = pivot(ids, table["size"].to_pylist(), table["share"].to_pylist(), level, last)
        return table.set_column(table.column_names.index("share"), "share", pa.array(share, pa.float64()))

    return node


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken.

    size is the number of words (null and empty texts: 0, which are never taken);
    copies is 0 to ``most`` and taken is copies * size. Rows that repeat a doc_id are
    documents of their own. With no words at all every target is 0.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"))
    docs = materialize(docs, "mixing-sizes")
    targets = materialize(source_targets(docs, weights, most), "mixing-targets")
    rows = docs.select("doc_id", _key(F.col("source")).alias("skey"), "size").join(targets, "skey")
    copies = F.least(F.lit(float(most)), F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rows = rows.withColumn("whole", F.when(F.col("size") > 0, F.floor(copies)).otherwise(0)).withColumn("share", F.when(F.col("size") > 0, copies - F.floor(copies)).otherwise(0.0))
    parts = F.greatest(F.ceil(F.col("n_docs") / BUCKET_ROWS), F.lit(1)).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.col("parts")).cast("int"))
    columns = ["doc_id", "skey", "size", "source_size", "target", "whole", "share", "parts", "part"]
    schema = "doc_id long, skey string, size long, source_size long, target double, whole long, share double, parts int, part int"
    open_rows, done, level = rows.select(*columns), None, 0
    while True:
        rounded = materialize(open_rows.groupBy("skey", "part").applyInArrow(_round(level), schema), f"mixing-level-{level}")
        settled = (F.col("share") <= 0) | (F.col("share") >= 1)
        finished = rounded.where(settled)
        done = finished if done is None else done.unionByName(finished)
        left = rounded.where(~settled)
        if not left.limit(1).count():
            break
        open_rows = left.withColumn("parts", F.ceil(F.col("parts") / FAN).cast("int")).withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        level += 1
    copies = (F.col("whole") + F.col("share")).cast("long")
    return done.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
