"""Items stored by day and by id: tables partitioned by the day of event time and bucketed by a key.

A filter on time names days, so the files of other days are not read: those known when the query is planned, or,
where days come from another table, those found when it runs. Two tables with the same buckets of
a key are joined on it bucket by bucket, without a shuffle.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import A_DAY_MS
from tidemark.storage import new_path


def day_of(ts_ms: str = "ts_ms"):
    """The day of a time in UTC, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.col(ts_ms) / A_DAY_MS).cast("int"))


def _store(df: DataFrame, name: str, key: str, buckets: int, partition: str | None, table: str | None) -> DataFrame:
    spark = df.sparkSession
    table = table or f"{name}_{uuid.uuid4().hex}"
    out = df.write.format("parquet").option("path", new_path(spark, name)).bucketBy(buckets, key).sortBy(key)
    (out.partitionBy(partition) if partition else out).saveAsTable(table)
    return spark.table(table)


def by_day(items: DataFrame, key: str = "doc_id", buckets: int = 8, table: str | None = None) -> DataFrame:
    """Write items (ts_ms, key, ...) as a table with a folder for each ``day`` and ``buckets`` files in it; a null ts_ms has a day of its own.

    Rows are brought together by bucket and day before they are written, so a folder has one file for each bucket; a day
    that fills a bucket's file beyond memory is sorted on disk.
    """
    placed = items.withColumn("day", day_of()).repartition(buckets, key)
    return _store(placed, "items_by_day", key, buckets, "day", table)


def by_key(df: DataFrame, key: str = "doc_id", buckets: int = 8, table: str | None = None) -> DataFrame:
    """Write a table in ``buckets`` files by key, to be joined with others of the same buckets."""
    return _store(df.repartition(buckets, key), "bucketed", key, buckets, None, table)


def between(items: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Rows of a `by_day` table with start_ms <= ts_ms < end_ms; the scan is left with the days between."""
    out = items
    if start_ms is not None:
        out = out.where((F.col("ts_ms") >= start_ms) & (F.col("day") >= day_of_ms(start_ms)))
    if end_ms is not None:
        out = out.where((F.col("ts_ms") < end_ms) & (F.col("day") <= day_of_ms(end_ms - 1)))
    return out


def day_of_ms(ms: int):
    """The day of a time as a literal."""
    return F.lit(datetime.fromtimestamp(ms / 1000, UTC).date())


def on_days(items: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of a `by_day` table on the days that ``days`` (day) names; folders of other days are left out when the query runs."""
    return items.join(F.broadcast(days.select("day").distinct()), "day", "left_semi")


def drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
