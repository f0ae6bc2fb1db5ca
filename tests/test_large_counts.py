"""Terms of very many documents, tables of terms too large to broadcast, slices of several files, packed rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import numeric as N
from tidemark.functions import sql
from tidemark.functions import text as X
from tidemark.operators import bayes, dictionary, policies
from tidemark.sources import readers, writers


def test_weight_of_a_term_of_more_documents_than_the_constant(spark):
    sql.register(spark)
    df = spark.createDataFrame([(20_000,), (20_001,), (171_592,), (None,)], "df long")
    for whole in (N.idf_whole(20_000, F.col("df")), F.expr("idf_whole(20000, df)")):
        assert [r.w for r in df.select(whole.alias("w")).collect()] == [0.0, -math.inf, -math.inf, None]
    tokens = spark.createDataFrame([(d, t) for d in range(3) for t in ("all", f"own{d}")], "doc_id long, term string")
    weights = {(r.doc_id, r.term): r.weight for r in dictionary.tf_idf(tokens, 2).collect()}
    assert weights[0, "all"] == -math.inf and weights[0, "own0"] == math.log(2)


def test_model_of_infinite_weights_is_that_of_sql(spark):
    """A label with such a term scores NaN, which SQL orders first; one without it plus infinity."""
    train = spark.createDataFrame([("b", "all", -math.inf), ("b", "x", 1.0), ("a", "y", 1.0)], "label string, term string, weight double")
    docs = spark.createDataFrame([("a",), ("b",)], "label string")
    model = bayes.fit(train, docs, 0, config.STREAM_RATIO, weight="weight")
    asked = spark.createDataFrame([(1, "all", -math.inf), (2, "y", 1.0)], "doc_id long, term string, weight double")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    scored = bayes.scores(model, asked, rows, weight="weight")
    got = {(r.doc_id, r.label): r.score for r in scored.collect()}
    assert math.isnan(got[1, "b"]) and got[1, "a"] == math.inf and math.isnan(got[2, "b"]) and got[3, "a"] == got[3, "b"] == 0.0
    assert {r.doc_id: r.prediction for r in bayes.predict(scored).collect()} == {1: "b", 2: "b", 3: "a"}


def test_terms_too_many_to_broadcast_meet_all_the_same(spark):
    tokens = spark.createDataFrame([(d, f"t{(d * k) % 17}") for d in range(40) for k in range(9)], "doc_id long, term string")
    table = tokens.groupBy("term").agg(F.count("*").alias("n")).where("term <> 't3'").withColumn("label", F.explode(F.array(F.lit("a"), F.lit("b"))))
    want = sorted(tokens.join(table, "term").select("doc_id", "term", "n", "label").collect())
    for most in (1, 8, 1000):
        assert sorted(dictionary.join_terms(tokens, table, F.col("n"), most).select("doc_id", "term", "n", "label").collect()) == want
    near_and_far = dictionary.join_terms(tokens, table, F.col("n"), 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in near_and_far and "LeftAnti" in near_and_far


def test_counts_where_rows_are_read(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["a"]), (2, []), (3, None)], "doc_id long, terms array<string>")
    got = dictionary.counted_terms(rows, ("doc_id",))
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (1, "a", 2), (1, "b", 1)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    ids = spark.createDataFrame([("a", 0, 4), ("b", 1, 1)], "term string, term_id long, n long")
    vector = dictionary.sparse_vectors(got, ids).collect()
    assert [(r.doc_id, r.indices, r["values"]) for r in vector] == [(1, [0, 1], [3.0, 1.0])]


@pytest.mark.parametrize("term", ["hello", "polygenelubricants", "", "Ünï cödé", "a😀b", "a" * 70])
def test_hashes_of_arrays(spark, term):
    assert dictionary.java_hashes(pa.array([term, "x"]))[0] == spark.range(1).select(X.java_hash(F.lit(term))).first()[0]


def test_slices_of_several_files_are_one_micro_batch_each(spark, tmp_path):
    df = spark.range(0, 90, 1, 9).select("id", F.when(F.col("id") < 10, 0).otherwise(1 + F.col("id") % 2).alias("slice"))
    writers.in_slices(df, f"{tmp_path}/in", F.col("slice"))
    stream = readers.sliced_rows(spark, f"{tmp_path}/in", df.schema)
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, out.select("batch", "slice").distinct().collect())) == [(0, 0), (1, 1), (2, 2)] and out.count() == 90
    files = [len(list(folder.glob("*.parquet"))) for folder in (tmp_path / "in").iterdir() if folder.is_dir()]
    assert files == [8, 8, 8]


def test_packed_ids():
    ids = np.sort(np.random.default_rng(3).zipf(1.3, 330).clip(0, 1 << 40))
    for given in (ids, ids[:0], np.array([0, 0, 7], np.int64)):
        assert policies.unpack(policies.pack(given)).tolist() == given.tolist()
    assert len(policies.pack(ids.clip(0, 1 << 22))) < 330 * 8 / 3
