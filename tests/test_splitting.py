"""Terms found in Arrow batches are those of the column expressions."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import text as X
from tidemark.operators import policies, splitting
from tidemark.operators.sequence import number_rows, running_mean
from tidemark.plans import inputs as I
from tidemark.streaming import jobs

TEXTS = ["The quick,brown fox", "", None, "  ", "a", "x", "-x1-", "ab", "cd", "İstanbul Kelvin été naïve", "x\ny\tz\x00w", "THE the The", "日本 42 \U0001f600a", "end "]


def test_terms_are_those_of_the_expression(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(1)
    want = {r.doc_id: r.t for r in df.select("doc_id", X.terms(F.col("text")).alias("t")).collect()}
    assert {r.doc_id: r.terms for r in splitting.with_terms(df, ("doc_id",)).collect()} == want
    assert {r.doc_id: r.terms for r in splitting.with_terms(df, ("doc_id",), least=2).collect()} == {k: v for k, v in want.items() if len(v) >= 2}
    every = {r.doc_id: r.t for r in df.select("doc_id", X.tokens(F.col("text")).alias("t")).collect()}
    rows = splitting.with_terms(df, ("doc_id",), stop_words=())
    assert {r.doc_id: r.terms for r in rows.collect()} == every
    assert sorted(r.term for r in splitting.distinct_terms(rows).collect()) == sorted({t for v in every.values() for t in v})


def test_a_slice_of_a_batch():
    texts = pa.array(["aa bb", "cc", None, "dd ee"])
    assert splitting.split(texts[1:]).to_pylist() == [["cc"], [], ["dd", "ee"]]
    assert splitting.split(texts[:0]).to_pylist() == splitting.split(pa.array([], pa.string())).to_pylist() == []


def test_windows_in_order_give_the_rows_of_the_joins(spark):
    """Overlapping windows, windows shorter than a period, null labels, batches that end inside windows."""
    rng = random.Random(5)
    rows = [(i, i, rng.choice(["b", "a", None, "c" if i > 60 else "a"]), [f"t{int(rng.paretovariate(0.7)) % 30}" for _ in range(rng.randint(1, 9))]) for i in range(150)]
    items = spark.createDataFrame(rows, "doc_id long, seq long, label string, terms array<string>").repartition(3)
    tokens = items.select("doc_id", "seq", "label", F.explode("terms").alias("term"))
    docs = items.select("doc_id", "seq", "label")
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for policy in (config.Periodic(20, 41, 20, 20), config.Periodic(10, 15, 10, 35), config.Periodic(30, 50, 25, 5)):
            terms = splitting.distinct_terms(items)
            want = policies.periodic_predictions(tokens, docs, terms, policy)
            got = policies.windowed_predictions(items, terms.count(), policy)
            assert got.columns == want.columns
            assert sorted(got.collect(), key=lambda r: r.seq) == sorted(want.collect(), key=lambda r: r.seq)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "HashJoin" not in plan and "MergeJoin" not in plan and "HashAggregate" not in plan
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)


def test_leading_terms_are_those_of_the_expression(spark):
    df = spark.createDataFrame(list(enumerate([*TEXTS, "a b c d e f g h i j k l", " one two three ", "one two three."])), "doc_id long, text string")
    want = {r.doc_id: r.t or [] for r in df.select("doc_id", X.leading_terms(F.col("text"), 3).alias("t")).collect()}
    assert {r.doc_id: r.terms for r in splitting.with_leading_terms(df, ("doc_id",), most=3).collect()} == want


def test_rows_are_computed_once_before_they_are_numbered_or_averaged(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    df = spark.range(40).mapInPandas(seen, "id long")
    assert number_rows(df, "id").agg(F.max("seq")).first()[0] == 39 and calls.value == 40
    means = running_mean(df, F.col("id"), "id").orderBy("id").collect()
    assert means[-1].running == 19.5 and calls.value == 80


def test_frequencies_of_rows_that_share_time_and_label_are_added_up(spark):
    rows = [(1, "a", "x x the"), (1, "a", "X y"), (1, None, "x"), (1, None, "x z"), (2, "a", "x"), (None, "a", "q q"), (3, "b", None)]
    batch = spark.createDataFrame(rows, "ts_ms long, label string, text string")
    want = [(1, "a", "the", 1), (1, "a", "x", 3), (1, "a", "y", 1), (1, None, "x", 2), (1, None, "z", 1), (2, "a", "x", 1), (None, "a", "q", 2)]
    assert sorted(map(tuple, jobs.term_frequencies(batch).collect()), key=str) == sorted(want, key=str)
    alone = jobs.term_frequencies(batch.where("ts_ms > 1"))
    assert list(map(tuple, alone.collect())) == [(2, "a", "x", 1)]
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


def test_items_are_numbered_where_they_are_split(spark, tmp_path):
    """Ranges that go on over batches, and texts too short to count."""
    rows = [(i * 7 % 3000, "a" if i % 5 else "x y", "en") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        got = I.items(spark, str(tmp_path)).orderBy("doc_id").select("doc_id", "seq").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert [r.doc_id for r in got] == sorted(d for d, text, _ in rows if text == "x y")
    assert [r.seq for r in got] == list(range(600))
