"""Texts into terms in Arrow batches: the same terms as `functions.text.terms`, found by bytes of a whole batch at once.

A column expression makes a string object for each token and calls the stop words' filter for each;
on long texts that is most of a query's time. Spark still reads, lower-cases and shuffles the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import STOP_WORDS
from tidemark.functions.text import lowered

_BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes 0-9 and a-z; all bytes of other characters part the terms.
_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session hands texts to Python in Arrow batches of at most 8 MB, unless it has a size of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BYTES_PER_BATCH).lower() in ("64mb", "64m", "67108864", "67108864b"):
        conf.set(_BYTES_PER_BATCH, "8m")
    return df


def split(texts: pa.Array, stop_words: pa.Array | None = None) -> pa.ListArray:
    """The terms of each lower-cased text, without stop words; null: none."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return pa.array([], pa.list_(pa.string()))
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    word = _WORD[data]
    begin, finish = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    finish[:-1] &= ~word[1:]
    # Texts lie side by side: a text's first and last letter begin and end a term too.
    full = ends[1:] > ends[:-1]
    begin[ends[:-1][full]] = word[ends[:-1][full]]
    finish[ends[1:][full] - 1] = word[ends[1:][full] - 1]
    first = np.flatnonzero(begin)
    length = np.flatnonzero(finish) + 1 - first
    places = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(first), pa.py_buffer(places), pa.py_buffer(data[word]))
    cuts = np.searchsorted(first, ends)
    if stop_words is not None and len(stop_words):
        keep = pc.invert(pc.is_in(terms, value_set=stop_words))
        terms, cuts = terms.filter(keep), np.concatenate([[0], np.cumsum(np.asarray(keep))])[cuts]
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), terms)


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (keep..., terms) as rows (keep..., term, tf): each row's distinct terms."""
    for batch in batches:
        terms = batch.column(batch.num_columns - 1)
        pairs = pa.table({"row": pc.list_parent_indices(terms), "term": pc.list_flatten(terms)})
        got = pairs.group_by(["row", "term"]).aggregate([([], "count_all")]).combine_chunks()
        for part in got.to_batches(max_chunksize=100_000):
            row = part.column("row")
            kept = [batch.column(i).take(row) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, part.column("term"), part.column("count_all")], [*batch.schema.names[:-1], "term", "tf"])


def with_terms(rows: DataFrame, keep: Sequence[str], text: Column | str = "text", stop_words: Sequence[str] = STOP_WORDS, least: int = 0, most: int | None = None, within: str | None = None) -> DataFrame:
    """keep..., terms (array) of the rows with ``least`` terms or more; their first ``most`` terms.

    within: a column of ``keep`` whose values (longs, no nulls) come in runs; such rows get a last column ``_at``, their number from 0 in their run.
    """
    stops = pa.array(list(stop_words), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, count = None, 0
        for batch in batches:
            terms = split(batch.column(batch.num_columns - 1), stops)
            enough = pc.greater_equal(pc.list_value_length(terms), least)
            terms = terms if most is None else pc.list_slice(terms, 0, most)
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], terms], [*batch.schema.names[:-1], "terms"])
            out = out.filter(enough) if least else out
            if within:
                values = np.asarray(out.column(within))
                at = np.arange(len(values))
                fresh = np.flatnonzero(np.diff(values, prepend=values[:1]) != 0)
                at -= np.repeat(np.concatenate([[0], fresh]), np.diff(np.concatenate([[0], fresh, [len(values)]])))
                if len(values):
                    at[: fresh[0] if len(fresh) else len(at)] += count if values[0] == value else 0
                    value, count = values[-1], at[-1] + 1
                out = out.append_column("_at", pa.array(at, pa.int64()))
            yield out

    return _mapped(rows, keep, text, run, "terms array<string>, _at long" if within else "terms array<string>")


def with_leading_terms(rows: DataFrame, keep: Sequence[str], text: str = "text", most: int = 10) -> DataFrame:
    """keep..., terms as `functions.text.leading_terms` gives them (null: none): an empty token at a text's start or end counts as a term."""
    low, blank = lowered(F.col(text)), F.array(F.lit(""))
    starts, stops = ~F.substring(low, 1, 1).rlike("^[0-9a-z]$"), (low != "") & ~F.right(low, F.lit(1)).rlike("^[0-9a-z]$")
    rows = with_terms(rows.select(*keep, text, starts.alias("_starts"), stops.alias("_stops")), (*keep, "_starts", "_stops"), text, most=most)
    none = F.array().cast("array<string>")
    ends = [F.when(F.col(c), blank).otherwise(none) for c in ("_starts", "_stops")]
    return rows.select(*keep, F.slice(F.concat(ends[0], "terms", ends[1]), 1, most).alias("terms"))


def counted_texts(rows: DataFrame, keep: Sequence[str], text: Column | str = "text", stop_words: Sequence[str] = ()) -> DataFrame:
    """keep..., term, tf: each row's distinct terms, split and counted where the rows are read; nothing is shuffled."""
    stops = pa.array(list(stop_words), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = split(batch.column(batch.num_columns - 1), stops)
            yield from counted([pa.RecordBatch.from_arrays([*batch.columns[:-1], terms], [*batch.schema.names[:-1], "terms"])])

    return _mapped(rows, keep, text, run, "term string, tf long")


def summed_texts(rows: DataFrame, by: Sequence[str], text: Column | str = "text", augmented: bool = False) -> DataFrame:
    """by..., term, n (texts that have the term), amount (times that they have it), by texts' columns ``by``; augmented: the amounts 0.5 + 0.5 tf / max tf of each text.

    Added up within Arrow batches first: what is shuffled are sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = split(batch.column(batch.num_columns - 1))
            pairs = pa.table({"row": pc.list_parent_indices(terms), "term": pc.list_flatten(terms)}).group_by(["row", "term"]).aggregate([([], "count_all")]).combine_chunks()
            if not len(pairs):
                continue
            row, tf = np.asarray(pairs["row"]), np.asarray(pairs["count_all"])
            amount = tf.astype(float)
            if augmented:
                most = np.zeros(len(batch), np.int64)
                np.maximum.at(most, row, tf)
                amount = 0.5 + 0.5 * tf / most[row]
            kept = {c: batch.column(i).take(pa.array(row)) for i, c in enumerate(by)}
            got = pa.table({**kept, "term": pairs["term"], "amount": pa.array(amount)}).group_by([*by, "term"]).aggregate([([], "count_all"), ("amount", "sum")])
            yield from got.select([*by, "term", "count_all", "amount_sum"]).rename_columns([*by, "term", "n", "amount"]).combine_chunks().to_batches(max_chunksize=100_000)

    sums = _mapped(rows, by, text, run, "term string, n long, amount double")
    return sums.groupBy(*by, "term").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))


def _mapped(rows: DataFrame, keep: Sequence[str], text: Column | str, run: Callable, more: str) -> DataFrame:
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    rows = rows.select(*keep, lowered(F.col(text) if isinstance(text, str) else text).alias("_text"))
    return small_batches(rows).mapInArrow(run, ", ".join([*fields, more]))


def distinct_terms(rows: DataFrame, terms: str = "terms") -> DataFrame:
    """term: each term of the rows' arrays once; a batch's own repeats go nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pc.unique(pc.list_flatten(batch.column(0)))], ["term"])

    return small_batches(rows.select(terms)).mapInArrow(run, "term string").distinct()
