"""Refining archived lines: parsers, filters, duplicates, order, watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import A_DAY_MS, START_MS
from tidemark.functions.numeric import rfc822_ms
from tidemark.functions.text import alnum_or_space, drop_trailing_empty, java_hash, tokens
from tidemark.operators.sequence import number_rows


def _parts(line: Column) -> Column:
    return F.split(F.regexp_replace(line, "[()]", ""), ",")


def parse_refined(df: DataFrame, line: str = "value") -> DataFrame:
    """``(ts,text,label)`` lines, lower-cased, to ts_ms, text, label."""
    parts = F.split(F.trim(F.lower(F.regexp_replace(line, "[()]", ""))), ",")
    return df.select(F.get(parts, F.lit(0)).try_cast("long").alias("ts_ms"), F.get(parts, F.lit(1)).alias("text"), F.get(parts, F.lit(2)).alias("label"))


def parse_stream(df: DataFrame, line: str = "value") -> DataFrame:
    """The same lines as streamed: ts_ms, label, text; case is kept."""
    parts = _parts(F.col(line))
    return df.select(F.get(parts, F.lit(0)).try_cast("long").alias("ts_ms"), F.get(parts, F.lit(2)).alias("label"), F.get(parts, F.lit(1)).alias("text"))


def parse_batch(df: DataFrame, line: str = "value") -> DataFrame:
    """The same lines for batch work: only the first parenthesis goes, the text keeps letters, digits and spaces."""
    parts = F.split(F.regexp_replace(line, r"^([^(]*)\(", "$1"), ",")
    label = F.regexp_replace(F.get(parts, F.lit(2)), r"\)", "")
    return df.select(F.get(parts, F.lit(0)).try_cast("long").alias("ts_ms"), alnum_or_space(F.get(parts, F.lit(1))).alias("text"), label.alias("label"))


def parse_archive(df: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Archived item lines (weekday, date, title, description ..., category) to ts_ms, text, label.

    With more than five fields the text is the fourth and those from the sixth to the last but one.
    """
    parts = F.split(F.col(line), ",")
    n = F.size(parts)
    more = F.concat_ws(" ", F.get(parts, F.lit(3)), F.array_join(F.slice(parts, F.lit(6), F.greatest(n - 6, F.lit(0))), " "))
    long = n > 5
    text = F.when(long, F.when(n > 6, more).otherwise(F.get(parts, F.lit(3)))).otherwise(F.get(parts, F.lit(3)))
    label = F.when(long, F.element_at(parts, -1)).otherwise(F.get(parts, F.lit(4)))
    return df.select(*keep, rfc822_ms(F.get(parts, F.lit(1))).alias("ts_ms"), F.trim(text).alias("text"), F.trim(label).alias("label"))


def since(df: DataFrame, start_ms: int = START_MS) -> DataFrame:
    """Rows from a moment on; a plain comparison, so it reaches the scan."""
    return df.where(F.col("ts_ms") >= start_ms)


def enough_terms(df: DataFrame, terms: Column, least: int = 2) -> DataFrame:
    return df.where(F.size(terms) >= least)


def enough_words(df: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """Rows whose text has ``least`` words once everything but letters and digits is a space."""
    return df.where(F.size(tokens(F.col(text))) >= least)


def enough_pieces(df: DataFrame, text: str = "text", least: int = 10) -> DataFrame:
    """Rows whose text splits into ``least`` pieces at spaces and commas (empty ones at the end don't count)."""
    return df.where(F.size(drop_trailing_empty(F.split(text, " |,"))) >= least)


def split_by_days(df: DataFrame, days: int = 4, start_ms: int = START_MS) -> DataFrame:
    """part: train before the boundary, test after it; the boundary itself belongs to neither (null)."""
    share = (F.col("ts_ms") - start_ms) / F.lit(float(days * A_DAY_MS))
    return df.withColumn("part", F.when(share < 1.0, "train").when(share > 1.0, "test"))


def in_period(df: DataFrame, start_ms: int, end_ms: int, compat: bool = False) -> DataFrame:
    """Rows between two moments; compat: those up to the start, as the inverted comparison gives."""
    if start_ms > end_ms:
        raise ValueError("a period must not end before it starts")
    return df.where(F.col("ts_ms") <= start_ms) if compat else df.where(F.col("ts_ms").between(start_ms, end_ms))


def last_by_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Of rows with one text the latest stays (ties: the largest other values). Aggregates before it shuffles.

    Rows are grouped by the text's hash and by the text, as different texts may share a hash.
    """
    rest = [c for c in df.columns if c not in ("ts_ms", text)]
    newest = F.max(F.struct("ts_ms", *rest)).alias("r")
    return df.groupBy(java_hash(F.col(text)).alias("text_hash"), text).agg(newest).select("text_hash", "r.ts_ms", text, *[F.col(f"r.{c}").alias(c) for c in rest])


def newer_than_watermark(items: DataFrame, registry: DataFrame, key: str = "url") -> DataFrame:
    """Items later than their feed's watermark; the registry is one small row for each feed."""
    return items.join(registry.select(key, "last_update"), key).where(F.col("ts_ms") > F.col("last_update"))


def advance_watermarks(registry: DataFrame, items: DataFrame, key: str = "url") -> DataFrame:
    """The registry with each feed's latest time, unchanged where nothing new came."""
    newest = items.groupBy(key).agg(F.max("ts_ms").alias("newest"))
    moved = F.greatest(F.col("last_update"), F.coalesce("newest", "last_update"))
    return registry.join(newest, key, "left").select(*[moved.alias(c) if c == "last_update" else F.col(c) for c in registry.columns])


def replay_delays(df: DataFrame, scale: int = 50_000, first_ms: int = 10, ties: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """delay_ms before each row when event time runs ``scale`` times as fast; the first row waits ``first_ms``.

    The previous row is found by its position, so no task sees all rows.
    """
    rows = number_rows(df, "ts_ms", ties, "_seq")
    before = rows.select((F.col("_seq") + 1).alias("_seq"), F.col("ts_ms").alias("_before"))
    delay = F.floor((F.col("ts_ms") - F.col("_before")) / scale)
    return rows.join(before, "_seq", "left").withColumn("delay_ms", F.coalesce(delay, F.lit(first_ms))).drop("_seq", "_before")
