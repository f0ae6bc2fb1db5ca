"""Term tables: tokens in long form, dictionaries, frequencies, weights, sparse vectors.

The long form (document, ..., position, term) is the engine's core table: all else are
aggregations and joins over it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import A_DAY_MS, START_MS, STOP_WORDS
from tidemark.functions.numeric import augmented_tf, day_number, idf, idf_whole
from tidemark.functions.text import terms
from tidemark.operators.sequence import number_rows
from tidemark.operators.splitting import counted
from tidemark.storage import materialize

#: Rows of a table of terms that are broadcast: those of its most frequent terms, which are nearly all tokens.
HOT_ROWS = 200_000


def token_table(docs: DataFrame, keep: Sequence[str], stop_words: Sequence[str] = STOP_WORDS, least: int = 0, text: str = "text") -> DataFrame:
    """keep columns, pos, term of each term; documents with fewer than ``least`` terms are left out."""
    rows = docs.select(*keep, terms(F.col(text), stop_words).alias("_t"))
    if least:
        rows = rows.where(F.size("_t") >= least)
    return rows.select(*keep, F.posexplode("_t").alias("pos", "term"))


def counted_terms(rows: DataFrame, keep: Sequence[str], terms: Column | str = "terms") -> DataFrame:
    """keep..., term, tf of rows with an array of terms (without nulls): counted where they are read, nothing is shuffled.

    Rows that repeat a document give rows of their own; `weighed` and `sparse_vectors` add them up.
    """
    rows = rows.select(*keep, (F.col(terms) if isinstance(terms, str) else terms).alias("_terms")).where("_terms is not null")
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(counted, ", ".join([*fields, "term string", "tf long"]))


def join_terms(tokens: DataFrame, table: DataFrame, often: Column, most: int = HOT_ROWS) -> DataFrame:
    """Inner join by ``term`` with a written table of terms, without a shuffle of the tokens of its most frequent terms.

    ``often`` says how frequent a term of the table is. A table of up to ``most`` rows is broadcast whole; of a larger one that many
    rows' worth of terms, and the other tokens meet the rest in a shuffle. Terms may have several rows.
    """
    rows = table.count()
    if rows <= most:
        return tokens.join(F.broadcast(table), "term")
    by_term = table.groupBy("term").agg(F.max(often).alias("_often"), F.count("*").alias("_rows"))
    per_term = by_term.agg(F.max("_rows")).first()[0]
    hot = materialize(by_term.orderBy(F.desc("_often")).limit(max(most // per_term, 1)).select("term"), "hot-terms")
    near = tokens.join(F.broadcast(table.join(F.broadcast(hot), "term", "left_semi")), "term")
    far = tokens.join(F.broadcast(hot), "term", "left_anti").join(table.join(F.broadcast(hot), "term", "left_anti"), "term")
    return near.unionByName(far)


def first_seen_ids(tokens: DataFrame, order: str = "seq") -> DataFrame:
    """term, term_id: ids from 0 in the order in which terms first occur."""
    return counted_ids(tokens, order).select("term", "term_id")


def counted_ids(tokens: DataFrame, order: str = "seq") -> DataFrame:
    """term, term_id, n: the same with each term's occurrences."""
    # One long per place keeps the order numeric: documents' positions stay below 2**24.
    place = F.min(F.col(order) * F.lit(1 << 24) + F.col("pos")).alias("first")
    return number_rows(tokens.groupBy("term").agg(place, F.count("*").alias("n")), "first", ("term",), "term_id").select("term", "term_id", "n")


def document_frequency(tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """term, df: documents that have the term. Distinct pairs first, so no counter holds a set."""
    return tokens.select(doc, "term").distinct().groupBy("term").agg(F.count("*").alias("df"))


def scanned_frequency(tokens: DataFrame, order: str = "seq") -> DataFrame:
    """term, df as a scan in order of documents and positions counts it, ``order`` being unique to a document.

    A term starts at 1 where it first occurs. After that a document adds 1 only to the first of its terms, by position,
    that the dictionary has by then, which may be one that the document itself has just brought in.
    """
    place = F.col(order) * F.lit(1 << 24) + F.col("pos")
    first = tokens.groupBy("term").agg(F.min(place).alias("first"))
    known = tokens.select(order, "term", place.alias("place")).join(first, "term").where("place > first")
    added = known.groupBy(order).agg(F.min_by("term", "place").alias("term")).groupBy("term").agg(F.count("*").alias("more"))
    return first.join(added, "term", "left").select("term", (F.coalesce("more", F.lit(0)) + 1).alias("df"))


def daily_sketches(tokens: DataFrame, start_ms: int = START_MS, k: int = 14) -> DataFrame:
    """day, terms: a HyperLogLog sketch of each day's terms, 2**k registers; a relative error of 1.04 / sqrt(2**k) or so."""
    day = F.floor((F.col("ts_ms") - start_ms) / A_DAY_MS).alias("day")
    return tokens.select(day, "term").groupBy("day").agg(F.hll_sketch_agg("term", F.lit(k)).alias("terms"))


def sketched_size(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, n_terms: the estimated number of distinct terms of a period, from the sketches of its days alone."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("terms")).alias("n_terms"))


def term_frequency(tokens: DataFrame, doc: Sequence[str] = ("doc_id",)) -> DataFrame:
    return tokens.groupBy(*doc, "term").agg(F.count("*").alias("tf"))


def weighted_frequency(tokens: DataFrame, weight: str = "weight", doc: Sequence[str] = ("doc_id",)) -> DataFrame:
    return tokens.groupBy(*doc, "term").agg(F.sum(weight).alias("tf"))


def frequency_by_day(tokens: DataFrame) -> DataFrame:
    """term, by_day (map of day number to documents of that day), total."""
    daily = tokens.select("term", day_number(F.col("ts_ms")).alias("day"), "doc_id").distinct().groupBy("term", "day").agg(F.count("*").alias("df"))
    by_day = F.map_from_entries(F.array_sort(F.collect_list(F.struct("day", "df"))))
    return daily.groupBy("term").agg(by_day.alias("by_day")).withColumn("total", F.aggregate(F.map_values("by_day"), F.lit(0).cast("long"), lambda a, x: a + x))


def tf_idf(tokens: DataFrame, n_docs: int = 20_000, augmented: bool = True) -> DataFrame:
    """doc_id, term, tf, df, weight. augmented: (0.5 + 0.5 tf / max tf) ln(n div df); else tf ln(n / df). Rows without an id are no documents."""
    tokens = tokens.where("doc_id is not null")
    tf = term_frequency(tokens)
    most = tf.groupBy("doc_id").agg(F.max("tf").alias("most"))
    rows = tf.join(most, "doc_id").join(document_frequency(tokens), "term")
    weight = augmented_tf(F.col("tf"), F.col("most")) * idf_whole(n_docs, F.col("df")) if augmented else F.col("tf") * idf(n_docs, F.col("df"))
    return rows.select("doc_id", "term", "tf", "df", weight.alias("weight"))


def weighed(tokens: DataFrame, dictionary: DataFrame, n_docs: int = 20_000, doc: str = "doc_id") -> DataFrame:
    """doc, term, weight: augmented tf-idf with the document frequencies of a written dictionary (term, df); other terms are dropped.

    ``tokens`` are rows of single terms, or counted ones (`counted_terms`). Documents are shuffled once.
    """
    counts = tokens.select(doc, "term", F.col("tf") if "tf" in tokens.columns else F.lit(1).cast("long").alias("tf"))
    known = join_terms(counts, dictionary.select("term", "df"), F.col("df")).repartition(doc)
    tf = known.groupBy(doc, "term").agg(F.sum("tf").alias("tf"), F.max("df").alias("df"))
    weight = augmented_tf(F.col("tf"), F.max("tf").over(Window.partitionBy(doc))) * idf_whole(n_docs, F.col("df"))
    return tf.select(doc, "term", weight.alias("weight"))


def words_after(lines: DataFrame, order: str, text: str, skip: int = 7) -> DataFrame:
    """order, pos, term: a line's words from number ``skip`` on, lower-cased, without all but digits and letters."""
    from tidemark.functions.text import alnum_only

    words = F.transform(F.split(text, r"\s+"), lambda w: alnum_only(F.lower(w)))
    return lines.select(order, F.posexplode(words).alias("pos", "term")).where(F.col("pos") >= skip).where("term <> ''")


def grown(dictionary: DataFrame, tokens: DataFrame, order: str = "seq") -> DataFrame:
    """A dictionary (term, term_id) with the terms of ``tokens`` that it lacks, numbered on from its last id in order of first sight."""
    fresh = first_seen_ids(tokens.join(dictionary.select("term"), "term", "left_anti"), order)
    last = dictionary.agg(F.coalesce(F.max("term_id"), F.lit(-1)).alias("last"))  # one row
    more = fresh.crossJoin(F.broadcast(last)).select("term", (F.col("term_id") + F.col("last") + 1).alias("term_id"))
    return dictionary.select("term", "term_id").unionByName(more)


def sparse_vectors(tf: DataFrame, dictionary: DataFrame, doc: str = "doc_id", compat: bool = False) -> DataFrame:
    """doc, indices, values with indices ascending; compat: values are sorted on their own, as a quirk of old data.

    With a written dictionary of `counted_ids`, the tokens of its most frequent terms get their ids without a shuffle.
    """
    known = join_terms(tf, dictionary, F.col("n")) if "n" in dictionary.columns else tf.join(dictionary, "term")
    known = known.select(doc, "term_id", "tf").repartition(doc).groupBy(doc, "term_id").agg(F.sum("tf").alias("tf"))
    pairs = known.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("term_id", "tf"))).alias("p"))
    values = F.transform("p", lambda x: x["tf"].cast("double"))
    return pairs.select(doc, F.transform("p", lambda x: x["term_id"]).alias("indices"), (F.array_sort(values) if compat else values).alias("values"))


def hashed_vectors(tokens: DataFrame, size: int = 1000, doc: str = "doc_id") -> DataFrame:
    """doc, bucket, tf with terms hashed to a fixed number of buckets."""
    from tidemark.functions.text import java_hash

    return tokens.groupBy(doc, F.pmod(java_hash(F.col("term")), F.lit(size)).alias("bucket")).agg(F.count("*").alias("tf"))


def _hashed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(batch.num_columns - 1)
            coded = pc.list_flatten(terms).dictionary_encode()
            bucket = (java_hashes(coded.dictionary) % size)[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64)
            pairs = pa.table({"row": pc.list_parent_indices(terms), "bucket": pa.array(bucket, pa.int64())})
            got = pairs.group_by(["row", "bucket"]).aggregate([([], "count_all")]).combine_chunks()
            for part in got.to_batches():
                kept = [batch.column(i).take(part.column("row")) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, part.column("bucket"), part.column("count_all")], [*batch.schema.names[:-1], "bucket", "tf"])

    return run


def java_hashes(terms: pa.Array) -> np.ndarray:
    """`java_hash` of each string of an array without nulls."""
    points = np.frombuffer("".join(terms.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    length = np.asarray(pc.utf8_length(terms)).astype(np.int64)
    start, out = np.cumsum(length) - length, np.zeros(len(length), np.int64)
    for i in range(int(length.max(initial=0))):
        long = np.flatnonzero(length > i)
        out[long] = (out[long] * 31 + points[start[long] + i]) % (1 << 32)
    return np.where(out >= 1 << 31, out - (1 << 32), out)


def hashed_counts(rows: DataFrame, keep: Sequence[str], size: int = 1000) -> DataFrame:
    """keep..., bucket, tf of rows with an array ``terms`` (without nulls): hashed and counted where they are read, each distinct term of a batch once."""
    rows = rows.select(*keep, "terms").where("terms is not null")
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(_hashed(size), ", ".join([*fields, "bucket long", "tf long"]))


def word_count(df: DataFrame, text: str) -> DataFrame:
    """Words between single spaces, counted."""
    return df.select(F.explode(F.split(text, " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def idf_vectors(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, indices, values: each distinct term of a document with its idf alone, whatever its frequency."""
    n = tokens.agg(F.count_distinct("doc_id").alias("n_docs"))
    weights = document_frequency(tokens).crossJoin(F.broadcast(n)).select("term", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    pairs = tokens.select("doc_id", "term").distinct().join(weights, "term").join(dictionary, "term")
    pairs = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term_id", "idf"))).alias("p"))
    return pairs.select("doc_id", F.transform("p", lambda x: x["term_id"]).alias("indices"), F.transform("p", lambda x: x["idf"]).alias("values"))


def index_vector(size: Column | int) -> Column:
    """0 .. size - 1."""
    return F.sequence(F.lit(0), (F.lit(size) if isinstance(size, int) else size) - 1)


def zero_vector(size: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), size)
