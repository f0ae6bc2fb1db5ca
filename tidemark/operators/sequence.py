"""Positions and running sums over a total order, without one task for all rows.

Rows are written once and cut into ranges of their order by approximate quantiles, as many as the row count asks
for; each range is numbered or summed on its own, and the ranges' totals, one row for each, are added up
and broadcast. A key value that fills whole ranges by itself is cut further by the first tie column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import materialize

#: Rows of a range, and ranges at least and at most.
RANGE_ROWS, LEAST, MOST = 500_000, 8, 4_000


def _below(edges: list, value: Column) -> Column:
    """How many of the ascending edges are at most ``value``, by halving: a dozen comparisons for thousands of edges; 0 for null."""
    if not edges:
        return F.lit(0)
    steps = [1 << k for k in range(len(edges).bit_length() - 1, -1, -1)]
    more = lambda at, step: F.coalesce(F.try_element_at(F.lit(edges), at + step) <= value, F.lit(False))
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(more(at, step), at + step).otherwise(at))


def _quantiles(column: str, parts: int) -> Column:
    return F.percentile_approx(column, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))


def _ranged(df: DataFrame, key: str, ties: tuple[str, ...] = (), ranges: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """``df`` with its range in order of the key (and the first tie): ``_range``, an ascending long.

    ``keys``: a table with about the same keys that is cheaper to read; its quantiles cut the ranges.
    """
    keys = df if keys is None else keys
    if ranges is None:
        ranges = min(max(-(-keys.count() // RANGE_ROWS), LEAST), MOST)
    found = keys.agg(_quantiles(key, ranges).alias("e")).first()["e"] or []
    edges = sorted(set(found))
    at = _below(edges, F.col(key)).cast("long") * (1 << 20)
    # A value between two equal quantiles fills a range of its own, or more.
    hot = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})
    if hot and ties and df.schema[ties[0]].dataType.simpleString() in ("bigint", "int", "double"):
        cuts = df.where(F.col(key).isin(hot)).groupBy(key).agg(_quantiles(ties[0], ranges).alias("e"))
        for row in cuts.orderBy(key).collect():  # at most one row for each range
            own = sorted(set(row["e"] or []))
            at = at + F.when(F.col(key) == row[key], _below(own, F.col(ties[0]))).when(F.col(key) > row[key], len(own) + 1).otherwise(0)
    return df.withColumn("_range", at)


def _written(df: DataFrame) -> DataFrame:
    return df if hasattr(df, "written_path") else materialize(df, "unranged")


def in_ranges(df: DataFrame, key: str, keys: DataFrame, ranges: int) -> DataFrame:
    """``df`` with its range, ``_range``: each range whole in one task, in order of the numeric ``key`` (nulls first); keys: see `_ranged`."""
    return _ranged(df, key, (), ranges, keys).repartition("_range").sortWithinPartitions("_range", key)


def rows_before(rows: DataFrame) -> DataFrame:
    """_range, _before: the rows of all earlier ranges. One row for each range, some thousands at most."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    return counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def number_rows(df: DataFrame, key: str, ties: tuple[str, ...] = (), name: str = "seq", ranges: int | None = None) -> DataFrame:
    """Row numbers from 0 in order of a numeric ``key`` (nulls first) and ``ties``."""
    # Rows are computed once: written as they are, and their ranges found on what is written.
    rows = _ranged(_written(df), key, ties, ranges)
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key, *ties))
    return rows.join(F.broadcast(rows_before(rows)), "_range").withColumn(name, own.cast("long") - 1 + F.col("_before")).drop("_range", "_before")


def running_mean(df: DataFrame, value: Column, key: str, by: tuple[str, ...] = (), name: str = "running", ranges: int | None = None) -> DataFrame:
    """Mean of ``value`` over all rows up to each row, in order of a unique numeric ``key``, for each ``by``."""
    rows = _ranged(_written(df.withColumn("_v", value.cast("double"))), key, (), ranges)
    group = [*by, "_range"]
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group).agg(F.sum("_v").alias("_s"), F.count("*").alias("_c"))
    totals = totals.select(*group, F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s0"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c0"))
    within = Window.partitionBy(*group).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    mean = (F.sum("_v").over(within) + F.col("_s0")) / (F.count("*").over(within) + F.col("_c0"))
    return rows.join(totals, group).withColumn(name, mean).drop("_range", "_v", "_s0", "_c0")
