"""Stored layouts (what their plans read), joins of intervals, sketches, order-dependent counts, binary search, measures of streams."""

from __future__ import annotations

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.config import A_DAY_MS
from tidemark.operators import dictionary, intervals, sequence
from tidemark.sources import layout, readers, writers
from tidemark.streaming import progress, state

# --- layout -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def items(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") * (20 * A_DAY_MS // 2000)).alias("ts_ms"), F.lit("x").alias("label"))
    return layout.by_day(rows.unionByName(spark.createDataFrame([(5000, None, "x")], "doc_id long, ts_ms long, label string")), buckets=4)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    """Final metrics of the scans of a query that has run: (partitions, files) of each."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            metrics = node.metrics()
            out.append(tuple(metrics.apply(m).value() if metrics.contains(m) else None for m in ("numPartitions", "numFiles")))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_a_time_filter_names_the_days(spark, items):
    part = layout.between(items, 3 * A_DAY_MS, 5 * A_DAY_MS + 10)
    assert part.count() == spark.range(2000).where(f"id * {20 * A_DAY_MS // 2000} >= {3 * A_DAY_MS} and id * {20 * A_DAY_MS // 2000} < {5 * A_DAY_MS + 10}").count()
    scan = [line for line in plan(part).splitlines() if "FileScan" in line][0]
    assert "PartitionFilters: [" in scan and "day#" in scan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [IsNotNull(ts_ms)" in scan
    part.collect()
    assert scans(part)[0][0] == 3
    assert len(part.inputFiles()) == 3 * 4 < len(items.inputFiles())
    assert layout.between(items).count() == 2001 and layout.between(items, end_ms=0).count() == 0


def test_days_of_another_table_prune_when_it_runs(spark, items):
    days = spark.createDataFrame([("1970-01-04",), ("1970-01-09",), ("1970-01-09",), ("2001-01-01",)], "d string").select(F.to_date("d").alias("day"))
    # A table of its own, so that its rows are not known when the query is planned.
    path = f"{layout.new_path(spark, 'days')}"
    days.write.parquet(path)
    got = layout.on_days(items, spark.read.parquet(path).where("day > date'1969-01-01'"))
    assert got.count() == 200
    got.collect()
    assert "dynamicpruning" in plan(got)
    assert (2, 8) in scans(got)


def test_a_null_time_has_a_day_of_its_own(items):
    assert [r.doc_id for r in items.where("day is null").collect()] == [5000]


def test_equal_buckets_join_without_a_shuffle(spark, items):
    other = layout.by_key(spark.range(0, 3000, 3).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")), buckets=4)
    joined = items.join(other.hint("merge"), "doc_id")
    assert joined.count() == 667 and "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
    layout.drop(spark, "no_such_table")


# --- intervals ----------------------------------------------------------------------------------------------


def test_intervals_of_any_length(spark):
    rng = random.Random(3)
    rows = [(rng.randint(-500, 5000), k) for k in range(600)] + [(None, 9999), (7, 10_000), (7, 10_000)]
    windows = [(k, a := rng.randint(-600, 5000), a + rng.choice([0, 1, 2, 63, 64, 65, 300, 4000, 100_000])) for k in range(120)]
    windows += [(500, None, 3), (501, 3, None), (502, 9, 2), (503, 0, 10), (503, 0, 10), (504, -(10**12), 10**13)]
    a, b = spark.createDataFrame(rows, "position long, row long"), spark.createDataFrame(windows, "window long, start long, end long")
    got = intervals.within(a, b, "position")
    want = sorted((p, r, w, s, e) for p, r in rows for w, s, e in windows if None not in (p, s, e) and s <= p < e)
    assert sorted(map(tuple, got.select("position", "row", "window", "start", "end").collect())) == want
    assert not {"NestedLoop", "Cartesian"} & set(plan(got).replace("Join", " ").split()) and "NestedLoopJoin" not in plan(got) and "CartesianProduct" not in plan(got)
    assert intervals.within(a, b.limit(0), "position").count() == 0 and intervals.within(a.limit(0), b, "position").count() == 0


# --- counts ---------------------------------------------------------------------------------------------------


def test_scanned_frequency_equals_a_scan(spark):
    rng = random.Random(6)
    docs = [[rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))] for _ in range(60)]
    table: dict = {}
    for words in docs:
        new = True
        for w in words:
            if w not in table:
                table[w] = 1
            elif new:
                table[w] += 1
                new = False
    tokens = spark.createDataFrame([(i, k, w) for i, words in enumerate(docs) for k, w in enumerate(words)], "seq long, pos int, term string")
    assert {r.term: r.df for r in dictionary.scanned_frequency(tokens).collect()} == table
    assert dictionary.scanned_frequency(tokens.limit(0)).count() == 0


def test_sketches_of_days_add_up_to_any_period(spark):
    rows = spark.range(60_000).select((F.col("id") % 9 * A_DAY_MS).alias("ts_ms"), F.concat(F.lit("t"), (F.col("id") * 7919 % 23_000).cast("string")).alias("term"))
    sketches = dictionary.daily_sketches(rows, 0)
    assert sketches.count() == 9
    for low, high in ((0, 9), (2, 3), (4, 8)):
        exact = rows.where(f"ts_ms >= {low * A_DAY_MS} and ts_ms < {high * A_DAY_MS}").select("term").distinct().count()
        about = dictionary.sketched_size(sketches.where(f"day >= {low} and day < {high}")).first().n_terms
        assert abs(about - exact) <= 0.03 * exact


@settings(max_examples=25, deadline=None, suppress_health_check=[])
@given(st.lists(st.integers(-50, 50), max_size=40), st.lists(st.one_of(st.none(), st.integers(-60, 60)), min_size=1, max_size=10))
def test_edges_below(edges, values):
    from pyspark.sql import SparkSession

    spark, edges = SparkSession.getActiveSession(), sorted(set(edges))
    df = spark.createDataFrame([(v,) for v in values], "v long").coalesce(1)
    got = [r.n for r in df.select(sequence._below(edges, F.col("v")).alias("n")).collect()]
    assert got == [sum(e <= v for e in edges) if v is not None else 0 for v in values]


# --- measures of streams ------------------------------------------------------------------------------------------


def test_a_listener_writes_each_batch_s_accuracy(spark, tmp_path):
    rows = [(i, i % 5, i % 3 == 0 if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, slice int, correct boolean")
    writers.in_slices(df, f"{tmp_path}/in", F.col("slice"))
    stream = progress.measured(readers.sliced_rows(spark, f"{tmp_path}/in", df.schema), F.col("correct"))
    for _ in (1, 2):  # the second run finds nothing new
        progress.run(stream, f"{tmp_path}/out", f"{tmp_path}/cp", "judged", f"{tmp_path}/metrics")
    got = sorted(map(tuple, progress.read(spark, f"{tmp_path}/metrics").collect()))
    own = lambda k: [c for _, s, c in rows if s == k]
    assert got == [(k, len(own(k)), sum(bool(c) for c in own(k)), len(own(k))) for k in range(5)]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 300


def test_micro_batches_at_an_interval_until_a_time(spark, tmp_path):
    df = spark.createDataFrame([(i, True) for i in range(10)], "id long, correct boolean")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = progress.measured(readers.file_rows(spark, f"{tmp_path}/in", df.schema), F.col("correct"))
    start = time.time()
    query = progress.run(stream, f"{tmp_path}/out", f"{tmp_path}/cp", "paced", f"{tmp_path}/metrics", "200 milliseconds", 2)
    assert not query.isActive and 2 <= time.time() - start < 120
    assert [tuple(r) for r in progress.read(spark, f"{tmp_path}/metrics").collect()] == [(0, 10, 10, 10)]


def test_streams_have_a_session_of_their_own(spark):
    own = state.session(spark)
    assert own.conf.get("spark.sql.streaming.stateStore.providerClass") == state.ROCKS
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
