"""Keyed state that outlives micro-batches: a dictionary whose entries expire.

An entry of the dictionary is a term with the day it was first seen, the last one, its documents, and the
documents of each day. A term that is not seen for more than ``ttl`` days is forgotten: seen
again, it is a new entry. State is kept by bucket of terms, not by term: a bucket's entries are
one value and its days one map, both Arrow tables, so a micro-batch talks to the state store a few times a
bucket, however many terms it has, and merges are vectorised. A timer for each day drops that day and
the terms not seen since; so the state holds the terms of the last ``ttl`` days only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Memory of all state stores of an executor.
STATE_MB = 256
#: Settings of the caller's session that a session for streams takes over.
KEPT = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes")
ENTRIES = "term string, init_day long, last_day long, df long, n_days long, expired boolean"
_COLUMNS = ["term", "init_day", "last_day", "df", "n_days"]


def session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's whose streams keep their state in RocksDB, on disk and uploaded by changes; the caller's stays as it is."""
    own = spark.newSession()
    for name in KEPT:
        value = spark.conf.get(name, None)
        if value is not None:
            own.conf.set(name, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # Without a bound each of an executor's stores takes buffers of its own.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", str(STATE_MB))
    return own


def _bytes(table: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    plain = pa.Table.from_pandas(table, preserve_index=False)
    with pa.ipc.new_stream(sink, plain.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(plain)
    return sink.getvalue().to_pybytes()


def _table(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def merged(entries: pd.DataFrame, day: int, counts: pd.Series, seen: pd.Index, ttl: int) -> tuple[pd.DataFrame, pd.Index]:
    """``entries`` (by term) after the documents of a day, and the terms that changed; ``seen`` has the terms that this day already had."""
    old = entries.reindex(counts.index)
    fresh = old["df"].isna() | (day - old["last_day"] > ttl)
    now = pd.DataFrame(index=counts.index)
    now["init_day"] = old["init_day"].where(~fresh, day)
    now["last_day"] = old["last_day"].where(~fresh & (old["last_day"] > day), day)
    now["df"] = old["df"].where(~fresh, 0) + counts
    now["n_days"] = old["n_days"].where(~fresh, 0) + (~counts.index.isin(seen) | fresh).astype("int64")
    now = now.astype("int64")
    return pd.concat([entries.drop(counts.index, errors="ignore"), now]), counts.index


class TermEntries(StatefulProcessor):
    """One key is a bucket; rows are (bucket, day, term, n, time): n documents of a day have the term."""

    def __init__(self, ttl: int, start_ms: int):
        self.ttl, self.start_ms = ttl, start_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", "table binary")
        self.days = handle.getMapState("days", "day long", "table binary")

    def _entries(self) -> pd.DataFrame:
        got = _table(self.entries.get()[0]) if self.entries.exists() else pd.DataFrame({c: pd.Series(dtype="object" if c == "term" else "int64") for c in _COLUMNS})
        return got.set_index("term")

    def _put(self, entries: pd.DataFrame) -> None:
        if len(entries):
            self.entries.update((_bytes(entries.rename_axis("term").reset_index()),))
        else:
            self.entries.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Each batch of rows is counted as it comes: a bucket's rows are never held together.
        counts = pd.concat([pdf.groupby(["day", "term"])["n"].sum() for pdf in rows]).groupby(level=["day", "term"]).sum()
        entries, out = self._entries(), []
        for day in sorted(counts.index.get_level_values("day").unique()):
            now = counts.xs(day, level="day")
            before = _table(self.days.getValue((int(day),))[0]).set_index("term")["df"] if self.days.containsKey((int(day),)) else None
            if before is None:
                self.handle.registerTimer(self.start_ms + (int(day) + self.ttl + 1) * DAY_MS)
            entries, changed = merged(entries, int(day), now, before.index if before is not None else pd.Index([]), self.ttl)
            total = now if before is None else now.add(before, fill_value=0).astype("int64")
            self.days.updateValue((int(day),), (_bytes(total.rename("df").rename_axis("term").reset_index()),))
            out.append(entries.loc[changed].rename_axis("term").reset_index())
        self._put(entries)
        last = pd.concat(out).drop_duplicates(["term", "init_day"], keep="last")
        yield last.assign(expired=False)[[*_COLUMNS, "expired"]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        day = (expiredTimerInfo.getExpiryTimeInMs() - self.start_ms) // DAY_MS - self.ttl - 1
        self.days.removeKey((int(day),))
        entries = self._entries()
        gone = entries[entries["last_day"] <= day]
        if len(gone):
            self._put(entries.drop(gone.index))
            yield gone.rename_axis("term").reset_index().assign(expired=True)[[*_COLUMNS, "expired"]]

    def close(self) -> None:
        pass


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(day, term, n, time) of batches of (day, terms, time): documents counted, and their latest time, before anything is shuffled."""
    for batch in batches:
        terms = batch.column(1)
        rows = pc.list_parent_indices(terms)
        flat = pa.table({"day": batch.column(0).take(rows), "term": terms.flatten(), "time": batch.column(2).take(rows)})
        got = flat.group_by(["day", "term"]).aggregate([([], "count_all"), ("time", "max")])
        yield from got.select(["day", "term", "count_all", "time_max"]).rename_columns(["day", "term", "n", "time"]).combine_chunks().to_batches()


def dictionary_entries(stream: DataFrame, terms: Column, start_ms: int, ttl: int, delay: str = "1 hour", buckets: int = 64) -> DataFrame:
    """term, init_day, last_day, df, n_days, expired over a stream of (time, ...): an entry's row each time that it changes, and when it expires.

    ``terms`` is an array; a document counts once for each of its terms. ``time`` is a timestamp; rows later than ``delay`` behind
    the latest are dropped. The stream's session keeps state in RocksDB (`session`). Null terms and times are dropped.
    """
    day = F.floor((F.unix_millis("time") - start_ms) / DAY_MS).alias("day")
    rows = stream.where("time is not null").select(day, F.filter(F.array_distinct(terms), lambda t: t.isNotNull()).alias("terms"), "time").where("terms is not null")
    rows = rows.mapInArrow(_counted, "day long, term string, n long, time timestamp").withWatermark("time", delay)
    rows = rows.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "day", "term", "n", "time")
    return rows.groupBy("bucket").transformWithStateInPandas(TermEntries(ttl, start_ms), ENTRIES, "update", "eventTime")
