"""Sinks. None reads and overwrites one path: a new version is written beside the old one."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import item_line
from tidemark.storage import file_system, materialize


#: Row groups of slices: a scan splits files between them, so that few files of a slice are read by many tasks.
ROW_GROUP_BYTES = 8 << 20


def refined_text(df: DataFrame, path: str, single: bool = False) -> None:
    """``(ts,text,label)`` lines in order of time; single: one file, for readers that need it."""
    line = F.concat(F.lit("("), F.concat_ws(",", F.col("ts_ms").cast("string"), "text", "label"), F.lit(")"))
    out = df.orderBy("ts_ms", "text").select(line.alias("value"))
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def refined(df: DataFrame, path: str) -> None:
    """Parquet by day of event time, so that time filters skip files."""
    day = F.to_date(F.timestamp_millis("ts_ms"))
    df.withColumn("day", day).repartition("day").sortWithinPartitions("ts_ms").write.mode("overwrite").partitionBy("day").parquet(path)


def in_slices(df: DataFrame, path: str, at: Column) -> None:
    """Parquet in a folder for each value of ``at``, a whole number from 0, dated in this order: `readers.sliced_rows` streams a slice at a time.

    Each task writes its own files of the slices that it has, so no slice is one task's; folders are filled up with empty files to the same number,
    which is what a micro-batch takes. Then the files get modification times a minute apart from slice to slice, which is what a file stream goes by.
    """
    df.withColumn("_slice", at.cast("int")).write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy("_slice").parquet(path)
    spark = df.sparkSession
    fs, root = file_system(spark, path)
    folders = [x.getPath() for x in fs.listStatus(root) if x.isDirectory()]
    held = {str(folder): len(fs.listStatus(folder)) for folder in folders}
    lacking = {folder: max(held.values()) - n for folder, n in held.items() if n < max(held.values())}
    if lacking:
        aside = f"{path.rstrip('/')}-empty"
        spark.createDataFrame([], df.schema).coalesce(1).write.parquet(aside)
        jvm = spark._jvm.org.apache.hadoop.fs
        empty = next(x.getPath() for x in fs.listStatus(jvm.Path(aside)) if x.getPath().getName().startswith("part-"))
        for folder, n in lacking.items():
            for i in range(n):
                jvm.FileUtil.copy(fs, empty, fs, jvm.Path(f"{folder}/empty-{i}.parquet"), False, spark._jsc.hadoopConfiguration())
        fs.delete(jvm.Path(aside), True)
    start = fs.getFileStatus(root).getModificationTime()
    for folder in folders:
        number = int(folder.getName().split("=")[1])
        for file in fs.listStatus(folder):
            fs.setTimes(file.getPath(), start - (1_000_000 - number) * 60_000, -1)


def append_archive(items: DataFrame, path: str) -> None:
    items.select(item_line(F.col("pubDate"), F.col("title"), F.col("description"), F.col("category")).alias("value")).write.mode("append").text(path)


def registry(df: DataFrame, path: str) -> None:
    """The new registry is written beside the old one, which it then replaces: readers see one or the other, and ``df`` may read ``path``."""
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.select("url", "category", "last_update").write.option("sep", " ").csv(aside)
    swap(df.sparkSession, aside, path)


def swap(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder ``new`` in the place of ``path`` by renaming; the old one is deleted last."""
    fs, at = file_system(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    old = folder(f"{new}-old")
    replaces = fs.exists(at) and fs.rename(at, old)
    if not fs.rename(folder(new), at):
        raise OSError(f"{new} could not be renamed to {path}")
    if replaces:
        fs.delete(old, True)


def replay(items: DataFrame, folder: str, scale: int = 50_000, tick_ms: int = 1000, wait: Callable[[float], None] = time.sleep) -> int:
    """Append items as text lines to a folder, paced as event time divided by ``scale``; returns the ticks.

    Rows (ts_ms, text, label) of one tick of ``tick_ms`` are written together, as files that a stream of the folder
    picks up. A tick without rows is waited for and writes nothing. The pace is the driver's; the rows stay with the executors.
    """
    first = items.agg(F.min("ts_ms").alias("ts")).first()["ts"]
    if first is None:
        return 0
    tick = F.floor((F.col("ts_ms") - first) / (scale * tick_ms)).cast("long")
    line = F.concat(F.lit("("), F.concat_ws(",", F.col("ts_ms").cast("string"), "text", "label"), F.lit(")"))
    rows = materialize(items.select(tick.alias("tick"), "ts_ms", line.alias("value")), "replay")
    at = 0
    for row in rows.select("tick").distinct().orderBy("tick").toLocalIterator():
        wait((row["tick"] - at) * tick_ms / 1000)
        at = row["tick"]
        rows.where(F.col("tick") == at).orderBy("ts_ms").select("value").write.mode("append").text(folder)
    return at + 1


def dictionary(df: DataFrame, path: str) -> None:
    df.select("term", "term_id").orderBy("term_id").write.mode("overwrite").csv(path)


def prediction_series(df: DataFrame, path: str) -> None:
    """Tab-separated ts_ms, position, cumulative percent, learning rate."""
    df.select("ts_ms", "position", "cumulative_pct", "learning_rate").orderBy("position").write.mode("overwrite").option("sep", "\t").csv(path)


def stop_words(df: DataFrame, path: str, generated: str) -> None:
    """A comment line with the date, then the words in order."""
    head = df.sparkSession.createDataFrame([(f"# generated {generated}",)], "value string")
    words = df.select(F.col("word").alias("value")).distinct().orderBy("value")
    head.unionAll(words).coalesce(1).write.mode("overwrite").text(path)


def console(df: DataFrame, checkpoint: str):
    """Start a query that prints each batch's first ten rows."""
    return df.writeStream.format("console").option("numRows", 10).option("checkpointLocation", checkpoint).start()
