"""The engine's functions for queries written in SQL alone.

Scalar ones are SQL functions, whose bodies the optimizer inlines: a query with them is the same plan as
its DataFrame twin. `slot_bayes` is a table function over Arrow batches: it trains and predicts within
each partition of its table argument, so ``PARTITION BY`` makes a model for each slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

#: name(parameters): type, body.
FUNCTIONS = {
    "words_of(s STRING)": ("ARRAY<STRING>", "array_remove(split(lower(replace(coalesce(s, ''), '\u0130', 'i')), '[^0-9a-z]+'), '')"),
    "string_hash(s STRING)": ("BIGINT", "signed_32(aggregate(filter(split(s, ''), c -> c <> ''), 0L, (h, c) -> pmod(h * 31 + ascii(c), 4294967296L)))"),
    "half_toward_zero(v BIGINT)": ("BIGINT", "v DIV 2"),
    "rfc822_ms(s STRING)": ("BIGINT", "unix_millis(try_to_timestamp(regexp_replace(trim(s), '^[A-Za-z]{3},? *', ''), 'dd MMM yyyy HH:mm:ss z'))"),
    "idf_whole(n BIGINT, df BIGINT)": ("DOUBLE", "CASE WHEN n DIV df > 0 THEN ln(CAST(n DIV df AS DOUBLE)) WHEN n DIV df = 0 THEN DOUBLE('-Infinity') WHEN n DIV df < 0 THEN DOUBLE('NaN') END"),
    "idf(n BIGINT, df BIGINT)": ("DOUBLE", "ln(CAST(n AS DOUBLE) / df)"),
    "augmented_tf(tf BIGINT, most BIGINT)": ("DOUBLE", "0.5D + 0.5D * tf / most"),
    "tf_idf(tf BIGINT, most BIGINT, n BIGINT, df BIGINT)": ("DOUBLE", "augmented_tf(tf, most) * idf_whole(n, df)"),
    "log_ratio(count DOUBLE, total DOUBLE, more DOUBLE)": ("DOUBLE", "ln((count + more) / (total + more))"),
}
#: Functions that others call.
FIRST = {"signed_32(h BIGINT)": ("BIGINT", "CASE WHEN h >= 2147483648L THEN h - 4294967296L ELSE h END")}


class SlotBayes:
    """One slot: rows (doc_id, label, terms, training) come in batches; documents that are not for training come out with a prediction.

    Smoothing adds 0.1 to counts and to a label's total, there is no prior, and of equal scores (to nine places) the first label
    wins. A slot without training rows predicts nothing. A slot is held in memory: it is a window of a policy, of bounded rows.
    """

    ADD = 0.1

    def __init__(self) -> None:
        self.batches: list[pa.RecordBatch] = []

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        self.batches.append(rows)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if not self.batches:
            return
        table = pa.Table.from_batches(self.batches).combine_chunks()
        training = np.asarray(table["training"].combine_chunks().fill_null(False)).astype(bool)
        names = sorted(set(table["label"].filter(pa.array(training)).drop_null().to_pylist()))
        if not names or training.all():
            return
        terms = table["terms"].combine_chunks()
        owner = np.asarray(pc.list_parent_indices(terms))
        code = np.asarray(pc.dictionary_encode(pc.list_flatten(terms)).indices.fill_null(-1))
        owner, code = owner[code >= 0], code[code >= 0]
        label = np.asarray(pc.index_in(table["label"].combine_chunks(), pa.array(names)).fill_null(-1))
        known = training[owner] & (label[owner] >= 0)
        size = int(code.max(initial=-1)) + 1
        counts = np.bincount(label[owner[known]] * size + code[known], minlength=len(names) * size).reshape(len(names), size)
        gain = np.log((counts + self.ADD) / (counts.sum(axis=1, keepdims=True) + self.ADD))
        score = np.stack([np.bincount(owner, g[code], len(table)) for g in gain], axis=1)
        best = np.array(names, dtype=object)[np.round(score, 9).argmax(axis=1)]
        asked = np.flatnonzero(~training)
        yield pa.table({"doc_id": table["doc_id"].combine_chunks().take(pa.array(asked)), "label": table["label"].combine_chunks().take(pa.array(asked)), "prediction": pa.array(best[asked].tolist(), pa.string())})


SLOT_SCHEMA = "doc_id long, label string, prediction string"


def register(spark: SparkSession) -> None:
    """Make the functions known to a session, in place of those of the same names."""
    for name, (kind, body) in (FIRST | FUNCTIONS).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body}")
    spark.udtf.register("slot_bayes", arrow_udtf(SlotBayes, returnType=SLOT_SCHEMA))
