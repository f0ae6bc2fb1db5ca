"""Joins of positions with intervals of any length, overlapping or not, as joins on equal bins.

An interval belongs to the level whose bins are as long as it is or up to `STEP` times longer, and so covers two
bins of that level at most. A position falls into one bin of each level that
intervals use. Level and bin are the keys of a hash join; the exact condition follows. So neither
a long interval among short ones nor many that overlap multiply the rows by their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 4
LEVELS = 32


def _widths(base: int) -> list[int]:
    out = [base]
    while len(out) < LEVELS and out[-1] < 1 << 60:
        out.append(out[-1] * STEP)
    return out


def _level(length: Column, widths: list[int]) -> Column:
    """The number of widths that are shorter than the length."""
    out = F.when(length <= widths[0], 0)
    for k, width in enumerate(widths[1:], 1):
        out = out.when(length <= width, k)
    return out.otherwise(len(widths) - 1)


def within(rows: DataFrame, windows: DataFrame, position: str, start: str = "start", end: str = "end", base: int = 64) -> DataFrame:
    """Each row with each window for which start <= position < end; columns of both, whose names must differ.

    Positions and bounds are whole numbers. Null positions or bounds and windows without length meet nothing. ``base``: the length of the
    shortest bins. Equal windows and equal rows each count.
    """
    widths = _widths(base)
    spans = windows.where(F.col(end) > F.col(start)).withColumn("_level", _level(F.col(end) - F.col(start), widths))
    # The levels in use, some dozens at most.
    used = sorted(r["_level"] for r in spans.select("_level").distinct().collect())
    if not used:
        return rows.join(windows.limit(0), F.lit(True), "inner")
    width = F.element_at(F.lit(widths).cast("array<long>"), F.col("_level") + 1)
    low, high = (F.floor(x / width).cast("long") for x in (F.col(start), F.col(end) - 1))
    spans = spans.withColumn("_bin", F.explode(F.sequence(low, high)))
    marks = F.array(*[F.struct(F.lit(k).alias("_level"), F.floor(F.col(position) / F.lit(widths[k])).cast("long").alias("_bin")) for k in used])
    placed = rows.where(F.col(position).isNotNull()).withColumn("_mark", F.explode(marks)).select(*rows.columns, "_mark._level", "_mark._bin")
    met = placed.join(spans, ["_level", "_bin"]).where((F.col(position) >= F.col(start)) & (F.col(position) < F.col(end)))
    return met.drop("_level", "_bin")
