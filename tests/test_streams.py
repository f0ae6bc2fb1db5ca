"""Streams with bounded state: expiring keys, joins of two streams, restarts from the checkpoint."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.sources import readers, writers
from tidemark.streaming import jobs, joins, state

DAY = state.DAY_MS
SCHEMA = "doc_id long, ts_ms long, label string, text string"


def corpus(n=160, days=12, seed=4):
    """Documents whose words come and go: w3 is seen on days that 3 divides or that follow one, and so on."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        ts = int(i * days * DAY / n) + rng.randint(0, 1000)
        day = ts // DAY
        words = ["always"] + [f"w{k}" for k in range(2, 9) if day % k < 2 and rng.random() < 0.6]
        rows.append((i, ts, rng.choice("ab"), " ".join(words * rng.randint(1, 2))))
    return rows


def sliced(spark, rows, folder, days=2, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    writers.in_slices(df, folder, F.floor(F.col("ts_ms") / (days * DAY)))
    return readers.sliced_rows(state.session(spark), folder, df.schema).withColumn("time", F.timestamp_millis("ts_ms"))


def run(stream, folder, checkpoint="cp", mode="update"):
    """Runs to the end, each micro-batch's rows in a table of its own; returns the query's progress reports."""
    return jobs.run_to_end(stream, f"{folder}/{checkpoint}", lambda df, number: df.write.mode("overwrite").parquet(f"{folder}/out/batch={number}"), mode).recentProgress


def entries_of(rows, ttl):
    """{(term, init_day): (last_day, df, n_days)} by a plain walk over the days."""
    days: dict = {}
    for _, ts, _, text in rows:
        for term in set(text.split()):
            key = (term, ts // DAY)
            days[key] = days.get(key, 0) + 1
    out: dict = {}
    now: dict = {}
    for (term, day), n in sorted(days.items(), key=lambda x: x[0][1]):
        init, last, df, seen = now.get(term, (day, day, 0, 0))
        if day - last > ttl:
            init, df, seen = day, 0, 0
        now[term] = (init, day, df + n, seen + 1)
        out[term, init] = (day, df + n, seen + 1)
    return out


def test_slices_are_micro_batches_in_order(spark, tmp_path):
    rows = corpus(40)
    reports = run(sliced(spark, rows, f"{tmp_path}/in"), tmp_path, mode="append")
    got = spark.read.parquet(f"{tmp_path}/out").select("batch", (F.col("ts_ms") / (2 * DAY)).cast("int").alias("slice")).distinct().collect()
    assert sorted(map(tuple, got)) == [(k, k) for k in range(6)] and len(reports) >= 6


def test_entries_expire_and_updates_are_small(spark, tmp_path):
    rows = corpus()
    stream = sliced(spark, rows, f"{tmp_path}/in")
    reports = run(state.dictionary_entries(stream, X.tokens(F.col("text")), 0, 2, buckets=4), tmp_path)
    versions = spark.read.parquet(f"{tmp_path}/out")
    got = {(r.term, r.init_day): (r.last_day, r.df, r.n_days) for r in jobs.latest(versions, ("term", "init_day")).collect()}
    want = entries_of(rows, 2)
    assert got == want and len(want) > len({t for t, _ in want})
    expired = versions.where("expired").collect()
    last_day = max(ts for _, ts, *_ in rows) // DAY
    over = {k for k, v in want.items() if v[0] + 3 <= last_day}
    # One that comes back in the micro-batch that would end it is followed by its next entry instead.
    followed = {(t, i) for t, i in over if any(u == t and j > i for u, j in want)}
    assert over - followed <= {(r.term, r.init_day) for r in expired} <= over and over - followed
    # A batch gives the terms that it saw, and those that expire: not all that there are.
    for r in versions.where("not expired").groupBy("batch").agg(F.collect_set("term").alias("terms"), F.min("last_day").alias("low"), F.max("last_day").alias("high")).collect():
        assert set(r.terms) == {t for _, ts, _, text in rows if r.low <= ts // DAY <= r.high for t in text.split()}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in reports]
    assert max(held) <= 4 * (1 + 2 + 2 + 3 + 2) * 4 and held[-1] <= max(held)


def test_entries_go_on_after_a_restart(spark, tmp_path):
    rows = corpus()
    make = lambda stream: state.dictionary_entries(stream, X.tokens(F.col("text")), 0, 2, buckets=3)
    half = [r for r in rows if r[1] < 6 * DAY]
    run(make(sliced(spark, half, f"{tmp_path}/in")), tmp_path)
    first = spark.read.parquet(f"{tmp_path}/out").agg(F.max("batch")).first()[0]
    df = spark.createDataFrame([r for r in rows if r[1] >= 6 * DAY], SCHEMA)
    writers.in_slices(df, f"{tmp_path}/more", F.floor(F.col("ts_ms") / (2 * DAY)))
    for folder in (tmp_path / "more").iterdir():
        if folder.is_dir():
            folder.rename(tmp_path / "in" / folder.name)
    again = readers.sliced_rows(state.session(spark), f"{tmp_path}/in", df.schema).withColumn("time", F.timestamp_millis("ts_ms"))
    run(make(again), tmp_path)
    out = spark.read.parquet(f"{tmp_path}/out")
    got = {(r.term, r.init_day): (r.last_day, r.df, r.n_days) for r in jobs.latest(out, ("term", "init_day")).collect()}
    assert got == entries_of(rows, 2) and out.agg(F.max("batch")).first()[0] > first


def test_odd_rows_of_entries(spark, tmp_path):
    rows = [(1, 0, "a", None), (2, 1, "a", ""), (3, None, "a", "lost"), (4, DAY - 1, "a", "x x"), (4, DAY - 1, "a", "x x"), (5, DAY, "a", "x")]
    stream = sliced(spark, [r for r in rows if r[1] is not None], f"{tmp_path}/in").withColumn("day", F.lit(7)).withColumn("bucket", F.lit(1))
    nulls = F.when(F.col("doc_id") == 3, F.lit(None)).otherwise(F.col("time"))
    run(state.dictionary_entries(stream.withColumn("time", nulls), X.tokens(F.col("text")), 0, 2, buckets=1), tmp_path)
    got = jobs.latest(spark.read.parquet(f"{tmp_path}/out"), ("term", "init_day")).where("term <> ''").collect()
    assert [(r.term, r.init_day, r.last_day, r.df, r.n_days) for r in got] == [("x", 0, 1, 3, 2)]


def test_merge_of_a_day_that_comes_in_two_batches():
    empty = pd.DataFrame({"term": pd.Series(dtype="object"), **{c: pd.Series(dtype="int64") for c in ("init_day", "last_day", "df", "n_days")}}).set_index("term")
    one, _ = state.merged(empty, 5, pd.Series({"a": 2, "b": 1}), pd.Index([]), 2)
    two, changed = state.merged(one, 5, pd.Series({"a": 3, "c": 1}), pd.Index(["a", "b"]), 2)
    assert list(changed) == ["a", "c"] and two.loc["a"].tolist() == [5, 5, 5, 1] and two.loc["b"].tolist() == [5, 5, 1, 1]
    three, _ = state.merged(two, 8, pd.Series({"a": 1, "b": 1}), pd.Index([]), 3)
    assert three.loc["a"].tolist() == [5, 8, 6, 2]
    four, _ = state.merged(two, 9, pd.Series({"a": 1}), pd.Index([]), 3)
    assert four.loc["a"].tolist() == [9, 9, 1, 1]


# --- counts by window ---------------------------------------------------------------------------------


def test_windowed_counts_leave_the_state(spark, tmp_path):
    rows = corpus()
    reports = run(jobs.label_term_counts(sliced(spark, rows, f"{tmp_path}/in", days=1), window="1 day"), tmp_path)
    daily = jobs.latest(spark.read.parquet(f"{tmp_path}/out"), ("label", "term", "start"))
    got = {(r.label, r.term): r.n for r in daily.groupBy("label", "term").agg(F.sum("n").alias("n")).collect()}
    want: dict = {}
    for _, _, label, text in rows:
        for t in text.split():
            want[label, t] = want.get((label, t), 0) + 1
    assert got == want
    own = [p["stateOperators"][0] for p in reports]
    assert sum(o["numRowsRemoved"] for o in own) > 0 and max(o["numRowsTotal"] for o in own) < daily.count() / 3
    assert all(o["numRowsDroppedByWatermark"] == 0 for o in own)


# --- joins of two streams -----------------------------------------------------------------------------


def two_sides(spark, tmp_path, lag_hours, n=120, days=10):
    rng = random.Random(9)
    hour = 3_600_000
    start = 1000 * DAY  # a row at time 0 is as late as the first watermark
    predictions = [(i, rng.choice("ab"), start + int(i * days * DAY / n)) for i in range(n)] + [(7, "c", start + 7 * days * DAY // n)]
    labels = [(i, rng.choice("ab"), start + int(i * days * DAY / n) + lag_hours(i) * hour) for i in range(n) if i % 11]
    sides = []
    session = state.session(spark)
    for name, rows, columns in (("p", predictions, ("prediction", "predicted_at")), ("l", labels, ("label", "labelled_at"))):
        df = spark.createDataFrame(rows, f"doc_id long, {columns[0]} string, ts_ms long").select("doc_id", columns[0], F.timestamp_millis("ts_ms").alias(columns[1]))
        writers.in_slices(df, f"{tmp_path}/{name}", F.floor((F.unix_millis(columns[1]) - start) / DAY))
        sides.append(readers.sliced_rows(session, f"{tmp_path}/{name}", df.schema))
    met = [(i, p, a, q, b) for i, p, a in predictions for j, q, b in labels if i == j and a <= b <= a + 24 * hour]
    return sides, predictions, met


def test_late_labels_meet_their_predictions(spark, tmp_path):
    sides, predictions, met = two_sides(spark, tmp_path, lambda i: i * 5 % 37 - 1)
    reports = run(joins.judged_late(*sides, "24 HOURS"), tmp_path, mode="append")
    got = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "prediction", F.unix_millis("predicted_at"), "label", F.unix_millis("labelled_at"), "correct").collect()
    assert sorted(map(tuple, got)) == sorted((i, p, a, q, b, p == q) for i, p, a, q, b in met) and met
    held = [p["stateOperators"][0] for p in reports]
    assert sum(o["numRowsRemoved"] for o in held) > len(predictions)
    assert held[-1]["numRowsTotal"] < len(predictions) / 2 and max(o["numRowsTotal"] for o in held) < 1.5 * len(predictions)
    assert all(o["numRowsDroppedByWatermark"] == 0 for o in held)


def test_predictions_without_a_label_come_out_when_their_time_is_over(spark, tmp_path):
    sides, predictions, met = two_sides(spark, tmp_path, lambda i: i * 5 % 37)
    run(joins.judged_late(*sides, "24 HOURS", "leftOuter"), tmp_path, mode="append")
    rows = spark.read.parquet(f"{tmp_path}/out").select("doc_id", "prediction", "label", F.unix_millis("predicted_at").alias("a")).collect()
    found = {(i, p) for i, p, *_ in met}
    alone = [(r.doc_id, r.prediction) for r in rows if r.label is None]
    assert sum(r.label is not None for r in rows) == len(met)
    assert len(alone) == len(set(alone)) and not set(alone) & found
    # The last day's are still waiting when the streams end.
    assert {(i, p) for i, p, a in predictions if (i, p) not in found and a < 1008 * DAY} <= set(alone)


def test_null_keys_and_times_meet_nothing(spark, tmp_path):
    session = state.session(spark)
    sides = []
    for name, rows, schema in (
        ("p", [(None, "a", 0), (1, "a", None), (2, "a", 5)], "doc_id long, prediction string, t long"),
        ("l", [(None, "a", 0), (1, "a", 1), (2, None, 6), (2, None, 6)], "doc_id long, label string, t long"),
    ):
        time = "predicted_at" if name == "p" else "labelled_at"
        df = spark.createDataFrame(rows, schema).withColumn(time, F.timestamp_seconds("t")).drop("t")
        df.write.parquet(f"{tmp_path}/{name}")
        sides.append(readers.file_rows(session, f"{tmp_path}/{name}", df.schema, 100))
    run(joins.judged_late(*sides, "1 HOUR"), tmp_path, mode="append")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.doc_id, r.label, r.correct) for r in got] == [(2, None, None)] * 2


@pytest.fixture(autouse=True)
def settings_stay(spark):
    """The caller's session keeps its own settings."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
