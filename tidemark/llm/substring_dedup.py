"""Substring dedup with a log-structured fingerprint index.

Documents arrive in batches. Every run of consecutive 50-word windows that have the
same minimal 10-word gram (their anchor) is one block; equal windows have equal
anchors, so a window can only repeat inside blocks of its anchor. A block is
fingerprinted by two independent 64-bit hashes of its words.

The index is a log of sorted, immutable runs, one for each batch, of the blocks that
were new with it: (d1, d2, anchor, holder and its place). A batch is merge-joined with
the runs in two steps:

* blocks whose fingerprint is in the log, or in a smaller document of the batch, are
  repeats as a whole;
* an anchor under which a new block meets a different block may still share single
  windows. The documents with such blocks are read again from the archive and the batch,
  and verified window by window with both hashes of all 50 words, at each place
  that a new block has in its smallest document.

Runs of one level are compacted into one run of the next when there are ``fanout``
of them. Nothing in an index is ever changed, so a lost executor only repeats work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, small_batches, split_join
from tidemark.llm.words import FIRST, SECOND, Words, chunks, signed, sliding_min, windows

WINDOW = 50
GRAM = 10
#: Batches that a table is indexed in, and runs of a level that are compacted: the third batch meets a compacted run.
BATCHES, FANOUT = 3, 2

_BLOCKS = "doc_id long, version int, anchor long, d1 long, d2 long, start int, n_windows int"
_WINDOWS = "doc_id long, version int, old boolean, w1 long, w2 long, start int"


def _blocks(window: int, gram: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for low, high in chunks(batch.column(2)):
                with np.errstate(over="ignore"):
                    words = Words(batch.column(2).slice(low, high - low))
                    starts, before = windows(words.at, window)
                    if not len(starts):
                        continue
                    one, two = words.hashes(FIRST), words.hashes(SECOND)
                    anchors = sliding_min(FIRST.runs(one, gram), window - gram + 1)[starts]
                    owner = np.repeat(np.arange(high - low), np.diff(before))
                    new = np.ones(len(starts), bool)
                    new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
                    first = np.flatnonzero(new)
                    n = np.diff(np.append(first, len(starts)))
                    begin, end = starts[first], starts[first] + n - 1 + window
                    d1, d2 = FIRST.spans(one, begin, end), SECOND.spans(two, begin, end)
                owner = owner[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[low + owner]),
                        pa.array(versions[low + owner]),
                        pa.array(signed(anchors[first])),
                        pa.array(signed(d1)),
                        pa.array(signed(d2)),
                        pa.array((begin - words.at[owner]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    ["doc_id", "version", "anchor", "d1", "d2", "start", "n_windows"],
                )

    return blocks


def _windows(window: int):
    """Both hashes of every window of the listed blocks of each text."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions, old = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            for low, high in chunks(batch.column(3)):
                spans = batch.column(4).slice(low, high - low)
                owner = np.repeat(np.arange(high - low), spans.value_lengths().to_numpy(zero_copy_only=False))
                flat = spans.flatten()
                begin, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                with np.errstate(over="ignore"):
                    words = Words(batch.column(3).slice(low, high - low))
                    place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    owner = np.repeat(owner, n)
                    at = words.at[owner] + place
                    w1, w2 = (by.runs(words.hashes(by), window)[at] for by in (FIRST, SECOND))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[low + owner]), pa.array(versions[low + owner]), pa.array(old[low + owner]), pa.array(signed(w1)), pa.array(signed(w2)), pa.array(place.astype(np.int32))],
                    ["doc_id", "version", "old", "w1", "w2", "start"],
                )

    return expand


def _cut(as_is: bool):
    """Keep the words outside the spans, joined by one space; as_is: a text that loses none stays as it is."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in chunks(batch.column(2)):
                texts = batch.column(2).slice(low, high - low)
                spans = batch.column(3).slice(low, high - low)
                kept, total, removed = [], [], []
                for text, span in zip(texts, spans, strict=True):
                    whole = text.as_buffer().to_pybytes() if text.is_valid else None
                    words = whole.split() if whole else []
                    total.append(len(words))
                    if span.is_valid and len(words):
                        edge = np.zeros(len(words) + 1, np.int32)
                        np.add.at(edge, span.values.field(0).to_numpy(), 1)
                        np.add.at(edge, span.values.field(1).to_numpy(), -1)
                        words = list(compress(words, np.cumsum(edge[:-1]) == 0))
                    removed.append(total[-1] - len(words))
                    kept.append(whole if as_is and not removed[-1] else b" ".join(words))
                rest = [batch.column(i).slice(low, high - low) for i in (0, *range(4, batch.num_columns))]
                names = [batch.schema.names[i] for i in (0, *range(4, batch.num_columns))]
                done = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
                yield pa.RecordBatch.from_arrays([*rest, *done], [*names, "kept_text", "n_words", "n_removed"])

    return cut


class FingerprintLog:
    """The index of all batches so far, and the archive of their texts."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT):
        self.spark, self.window, self.gram, self.fanout = spark, window, gram, fanout
        #: (level, run): sorted tables of distinct blocks, each block in one run only.
        self.runs: list[tuple[int, DataFrame]] = []
        self.archive: list[DataFrame] = []

    def _history(self) -> DataFrame | None:
        out = None
        for _, run in self.runs:
            out = run if out is None else out.unionByName(run)
        return out

    def compact(self) -> None:
        """Merge the runs of each level that has ``fanout`` of them into one sorted run of the next level."""
        level = 0
        while self.runs and level <= max(x for x, _ in self.runs):
            own = [run for x, run in self.runs if x == level]
            if len(own) >= self.fanout:
                merged = own[0]
                for run in own[1:]:
                    merged = merged.unionByName(run)
                merged = materialize(merged.repartition("d1", "d2").sortWithinPartitions("d1", "d2"), "substring-run")
                self.runs = [(x, run) for x, run in self.runs if x != level] + [(level + 1, merged)]
            level += 1

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch (doc_id, version, text); returns its repeated words as spans: doc_id, version, start, stop.

        A word is repeated when it lies in a window whose words also are a window of an
        earlier batch or of a smaller doc_id of this one.
        """
        blocks = materialize(batch.where("doc_id is not null").mapInArrow(_blocks(self.window, self.gram), _BLOCKS), "substring-blocks")
        place = F.struct("doc_id", "version", "start")
        first = blocks.groupBy("d1", "d2").agg(F.min(place).alias("at"), F.max("doc_id").alias("last"), F.count("*").alias("places"), F.first("anchor").alias("anchor"), F.first("n_windows").alias("n_windows"))
        first = first.select("d1", "d2", "anchor", "n_windows", "at.*", "last", "places")
        history = self._history()
        if history is None:
            first = first.withColumn("old", F.lit(False))
        else:
            first = first.join(history.select("d1", "d2", F.lit(True).alias("old")), ["d1", "d2"], "left").withColumn("old", F.coalesce("old", F.lit(False)))
        first = materialize(first.sortWithinPartitions("d1", "d2"), "substring-first")

        repeated = first.where("old or doc_id < last").select("d1", "d2", F.when(~F.col("old"), F.col("doc_id")).alias("holder"))
        repeated = materialize(repeated, "substring-repeated")
        whole = split_join(blocks, repeated, ["d1", "d2"], "inner").where("holder is null or holder < doc_id")
        spans = whole.select("doc_id", "version", "start", (F.col("start") + F.col("n_windows") + (self.window - 1)).alias("stop"))

        run = first.where("not old").select("d1", "d2", "anchor", "doc_id", "version", "start", "n_windows")
        again = first.where("not old and places > 1").select("d1", "d2", "anchor", F.col("doc_id").alias("holder"))
        singles = self._verify(batch, blocks, run, again, history)
        if singles is not None:
            spans = spans.unionByName(singles.select("doc_id", "version", "start", (F.col("start") + self.window).alias("stop")))
        self.runs.append((0, run))
        self.archive.append(batch)
        self.compact()
        return spans

    def _verify(self, batch: DataFrame, blocks: DataFrame, run: DataFrame, again: DataFrame, history: DataFrame | None) -> DataFrame | None:
        """Windows of the batch that repeat although their blocks differ: doc_id, version, start.

        ``again`` are the run's blocks with more than one place in ``blocks``. At those in larger
        documents than the holder they go as a whole; those in the holder itself are verified like the first.
        """
        anchors = run.select("anchor", F.lit(1).alias("new"))
        if history is not None:
            anchors = anchors.unionByName(history.select("anchor", F.lit(0).alias("new")))
        mixed = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.max("new").alias("new")).where("n > 1 and new = 1").select("anchor")
        mixed = materialize(mixed, "substring-mixed")
        if not mixed.limit(1).count():
            return None
        listed = split_join(run.withColumn("old", F.lit(False)), mixed, ["anchor"], "left_semi").select("doc_id", "version", "old", "start", "n_windows")
        again = materialize(split_join(again, mixed, ["anchor"], "left_semi").select("d1", "d2", "holder"), "substring-again")
        places = split_join(blocks, again, ["d1", "d2"], "inner").where("doc_id = holder")
        listed = listed.unionByName(places.select("doc_id", "version", F.lit(False).alias("old"), "start", "n_windows"))
        if history is not None:
            known = split_join(history.withColumn("old", F.lit(True)), mixed, ["anchor"], "left_semi")
            listed = listed.unionByName(known.select("doc_id", "version", "old", "start", "n_windows"))
        # A set: the first place of a block in ``again`` is listed twice, and so is a text that a doc_id repeats.
        keys = ["doc_id", "version", "old"]
        by_doc = materialize(listed.groupBy(*keys).agg(F.collect_set(F.struct("start", "n_windows")).alias("spans")), "substring-listed")
        texts = batch.withColumn("old", F.lit(False))
        for earlier in self.archive:
            texts = texts.unionByName(earlier.withColumn("old", F.lit(True)))
        # Documents without such a block take no part in the shuffle.
        texts = split_join(texts, by_doc, keys, "inner")
        found = materialize(texts.select(*keys, "text", "spans").mapInArrow(_windows(self.window), _WINDOWS), "substring-windows")
        order = F.when(F.col("old"), F.lit(-(1 << 63))).otherwise(F.col("doc_id"))
        found = found.withColumn("rank", order)
        least = found.groupBy("w1", "w2").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).where("least < most").select("w1", "w2", "least")
        least = materialize(least, "substring-least")
        return split_join(found, least, ["w1", "w2"], "inner").where("not old and rank > least").select("doc_id", "version", "start")


def cut_spans(batch: DataFrame, spans: DataFrame, as_is: bool = False) -> DataFrame:
    """Remove the spans' words from a batch: doc_id, its further columns, kept_text, n_words, n_removed.

    Texts without a span aren't shuffled. as_is: a text that loses no word comes back unchanged.
    """
    by_doc = materialize(spans.groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "substring-spans")
    more = [c for c in batch.columns if c not in ("doc_id", "version", "text")]
    rows = split_join(batch, by_doc, ["doc_id", "version"], "left").select("doc_id", "version", "text", "spans", *more)
    schema = rows.drop("version", "text", "spans").schema.add("kept_text", "string").add("n_words", "long").add("n_removed", "long")
    return rows.mapInArrow(_cut(as_is), schema)


def versioned(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, version, text and _<name> of each of ``keep``: version tells rows apart that repeat a doc_id with another text."""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("version"), text.alias("text"), *(F.col(c).alias(f"_{c}") for c in keep))


def substring_dedup(documents: DataFrame, batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT, keep: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """Index ``documents`` in ``batches`` of ascending doc_id; one row per document: doc_id, the columns ``keep``, kept_text, n_words, n_removed.

    A word goes when a window that covers it also starts in a document with a smaller
    doc_id; the windows are those of the input. Null texts have no words; rows without
    a doc_id come back whole, as nothing is smaller. Rows that repeat a doc_id don't count
    against each other. A text of any length is one row and is hashed whole. Columns that are not
    named are not read. as_is: texts that lose no word come back unchanged, not with single spaces.
    """
    docs = versioned(small_batches(documents))
    edges = docs.select("doc_id").stat.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.001) if batches > 1 else []
    edges = sorted({int(x) for x in edges})
    log = FingerprintLog(documents.sparkSession, window, gram, fanout)
    spans = None
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = docs.where("doc_id is not null")
        part = part if low is None else part.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        found = log.add(part)
        spans = found if spans is None else spans.unionByName(found)
    out = cut_spans(versioned(documents, keep), spans, as_is)
    return out.withColumnsRenamed({f"_{c}": c for c in keep})
