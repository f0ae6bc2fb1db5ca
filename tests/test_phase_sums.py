"""The phase machine on sums: the scores and predictions of the weights that it doesn't write."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import text as X
from tidemark.operators import bayes, dictionary, splitting
from tidemark.sources import writers
from tidemark.streaming import jobs

SCHEMA = "doc_id long, ts_ms long, label string, text string"


def batches(spark):
    rng = random.Random(11)
    rows = [(i, i, rng.choice(["a", "b", None]), " ".join(f"t{int(rng.paretovariate(0.8)) % 60} the" for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows[3], rows[44], rows[45] = (3, 3, "a", None), (44, 44, "b", "never seen"), (45, 45, "a", "")
    return [spark.createDataFrame(rows[k : k + 20], SCHEMA) for k in (0, 20, 40)]


def predictions(spark, folder, given, tf_idf, smoothing):
    """Two batches of training, then one that is predicted."""
    machine = jobs.PhaseMachine(spark, folder, 1000, 1, smoothing, tf_idf)
    for number, batch in enumerate(given):
        machine(batch.withColumn("ts_ms", F.col("ts_ms") + (0 if number < 2 else 50_000 * 2)), number)
    scored = machine._scores(given[2], 2)
    return {(r.doc_id, r.label): r.score for r in scored.collect()}, sorted(map(tuple, spark.read.parquet(f"{folder}/predictions").select("doc_id", "prediction").collect()))


@pytest.mark.parametrize("tf_idf, smoothing", [(False, config.MULTINOMIAL), (True, config.STREAM_RATIO)])
def test_sums_give_the_scores_of_weights(spark, tmp_path, monkeypatch, tf_idf, smoothing):
    """With few terms broadcast, and in the long form, which documents that come twice and many labels take."""
    given = batches(spark)
    assert [jobs.PhaseMachine._repeats(rows) for rows in (given[2], given[2].union(given[2].limit(1)))] == [False, True]
    monkeypatch.setattr(jobs.PhaseMachine, "hot", 5)
    got = predictions(spark, f"{tmp_path}/few", given, tf_idf, smoothing)
    assert spark.read.parquet(f"{tmp_path}/few/cold/batch=2").count() > 5
    monkeypatch.setattr(jobs, "WIDE_LABELS", 0)
    monkeypatch.setattr(jobs.PhaseMachine, "_repeats", staticmethod(lambda rows: True))
    want = predictions(spark, f"{tmp_path}/long", given, tf_idf, smoothing)
    assert got[0] == pytest.approx(want[0]) and len(want[0]) == 20 * 3
    assert got[1] == want[1] and want[1]


def test_scores_of_infinite_weights_are_those_of_the_long_form(spark):
    train = spark.createDataFrame([("b", "all", -float("inf")), ("b", "x", 1.0), ("a", "y", 1.0)], "label string, term string, count double")
    model = bayes.fit_counts(train, train.select("label"), 0, config.STREAM_RATIO)
    labels = model.labels.collect()
    terms = bayes.gains_by_term(model, labels).withColumn("idf", F.when(F.col("term") == "all", -float("inf")).otherwise(1.0))
    counts = spark.createDataFrame([(1, "all", 2), (2, "y", 1), (2, "x", 3)], "doc_id long, term string, tf long")
    weight = (F.lit(0.5) + F.lit(0.5) * F.col("tf") / F.when(F.col("doc_id") == 1, 2).otherwise(3)) * F.when(F.col("term") == "all", -float("inf")).otherwise(1.0)
    rows = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    want = bayes.scores(model, counts.withColumn("weight", weight), rows, weight="weight")
    for hot, cold in ((terms, terms.limit(0)), (terms.where("term = 'x'"), terms.where("term <> 'x'"))):
        got = bayes.scores_of_sums(counts, rows, labels, hot, cold, True)
        assert {(r.doc_id, r.label): pytest.approx(r.score, nan_ok=True) for r in got.collect()} == {(r.doc_id, r.label): r.score for r in want.collect()}


def test_texts_are_added_up_where_they_are_read(spark):
    df = spark.createDataFrame([("a", "x x y"), ("a", "X"), (None, "x"), ("b", None), ("b", "")], "label string, text string").coalesce(1)
    got = splitting.summed_texts(df, ("label",), augmented=True)
    assert sorted(map(tuple, got.collect()), key=str) == [("a", "x", 2, 2.0), ("a", "y", 1, 0.75), (None, "x", 1, 1.0)]
    assert sorted(map(tuple, splitting.summed_texts(df, ("label",)).collect()), key=str) == [("a", "x", 2, 3.0), ("a", "y", 1, 1.0), (None, "x", 1, 1.0)]


def test_files_of_a_slice_can_be_read_by_many_tasks(spark, tmp_path):
    """One file of one slice, of several row groups."""
    df = spark.range(0, 40_000, 1, 1).select("id", F.concat_ws(" ", *[F.sha2((F.col("id") * 9 + k).cast("string"), 512) for k in range(6)]).alias("text"))
    writers.in_slices(df, f"{tmp_path}/in", F.lit(0))
    (file,) = (tmp_path / "in" / "_slice=0").glob("*.parquet")
    assert pq.ParquetFile(file).num_row_groups >= 3
