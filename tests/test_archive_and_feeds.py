"""The transactional archive, and feeds as a stream: each batch and each item once."""

from __future__ import annotations

import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.plans import registry as plans
from tidemark.sources import archive, http_feeds, readers
from tidemark.streaming import jobs

SCHEMA = "a long, b string"


def rows(spark, low, high):
    return spark.range(low, high, numPartitions=3).select(F.col("id").alias("a"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("b"))


def content(spark, path, version=None):
    return sorted(r.a for r in archive.read(spark, path, SCHEMA, version).collect())


# --- archive --------------------------------------------------------------------------------------------


def test_a_repeated_batch_leaves_one_copy(spark, tmp_path):
    path = f"{tmp_path}/archive"
    for _ in range(3):
        archive.append(rows(spark, 0, 10), path, "first")
    archive.append(rows(spark, 10, 15), path, "second")
    assert content(spark, path) == list(range(15))
    log = archive.Log(path)
    assert log.versions() == [0, 1] and len(list(Path(path, "data").iterdir())) == len(log.state().files)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/archive"
    archive.append(rows(spark, 0, 5), path)
    broken = rows(spark, 0, 3000).withColumn("b", F.when(F.col("a") == 2900, F.raise_error(F.lit("stop"))).otherwise(F.col("b")))
    with pytest.raises(Exception, match="stop"):
        archive.append(broken, path, "broken")
    assert content(spark, path) == list(range(5))
    archive.append(rows(spark, 5, 7), path, "broken")
    assert content(spark, path) == list(range(7))
    archive.Log(path).sweep()
    assert content(spark, path) == list(range(7)) and len(list(Path(path, "data").iterdir())) == len(archive.Log(path).state().files)


def test_readers_always_see_a_whole_version(spark, tmp_path):
    path = f"{tmp_path}/archive"
    archive.replace(rows(spark, 0, 4), path)
    before = archive.read(spark, path, SCHEMA)
    archive.replace(archive.read(spark, path, SCHEMA).withColumn("a", F.col("a") + 100), path)
    assert content(spark, path) == [100, 101, 102, 103] and content(spark, path, 0) == [0, 1, 2, 3]
    assert sorted(r.a for r in before.collect()) == [0, 1, 2, 3]
    seen, stop = [], threading.Event()

    def look():
        while not stop.is_set():
            seen.append(len(archive.Log(path).state().files) > 0)

    watcher = threading.Thread(target=look)
    watcher.start()
    for k in range(3):
        archive.replace(rows(spark, 0, k + 1), path)
    stop.set()
    watcher.join()
    assert seen and all(seen) and content(spark, path) == [0, 1, 2]


def test_two_commits_of_one_version(tmp_path):
    """The later of two writers that saw the same version takes the next one; neither is lost."""
    path = f"{tmp_path}/archive"
    logs = [archive.Log(path) for _ in range(8)]
    threads = [threading.Thread(target=log.commit, args=(f"b{k}", [f"f{k}"], False)) for k, log in enumerate(logs)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert logs[0].versions() == list(range(8)) and sorted(logs[0].state().files) == [f"f{k}" for k in range(8)]


def test_old_versions_are_summed_up(tmp_path):
    log = archive.Log(f"{tmp_path}/archive")
    for k in range(70):
        assert log.commit(f"b{k}", [f"f{k}"], k == 40)
    now = log.state()
    assert now.files == [f"f{k}" for k in range(40, 70)] and len(now.batches) == 70 and not log.commit("b3", ["again"], False)
    assert log.state(39).files == [f"f{k}" for k in range(40)]
    # What came before the last whole version is not needed any more.
    for v in range(64):
        (tmp_path / "archive" / "_log" / f"{v:020d}.json").unlink()
    assert log.state() == now
    assert json.loads((tmp_path / "archive" / "_log" / f"{64:020d}.json").read_text())["whole"]


def test_a_stream_s_batch_that_runs_again_is_taken_once(spark, tmp_path):
    archive.register(spark)
    for k in range(3):
        rows(spark, 10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    path = f"{tmp_path}/archive"

    def run():
        stream = readers.file_rows(spark, f"{tmp_path}/in", rows(spark, 0, 1).schema)
        jobs.run_into(stream, "archive", f"{tmp_path}/cp", {"path": path, "batch": "feed"})

    run()
    assert content(spark, path) == list(range(30)) and archive.Log(path).versions() == [0, 1, 2]
    # The last commit is lost after its batch was written: it runs again.
    for file in (tmp_path / "cp" / "commits").iterdir():
        if file.name.strip(".").startswith("2"):
            file.unlink()
    run()
    assert content(spark, path) == list(range(30)) and archive.Log(path).versions() == [0, 1, 2]
    with pytest.raises(Exception, match="batch"):
        jobs.run_into(readers.file_rows(spark, f"{tmp_path}/in", rows(spark, 0, 1).schema), "archive", f"{tmp_path}/cp2", {"path": path})


def test_empty_writes(spark, tmp_path):
    path = f"{tmp_path}/archive"
    assert content(spark, path) == []
    archive.append(rows(spark, 0, 0), path)
    assert content(spark, path) == []
    archive.append(rows(spark, 0, 2), path)
    archive.replace(rows(spark, 0, 0), path)
    assert content(spark, path) == []


# --- feeds as a stream ------------------------------------------------------------------------------------


def feed(path: Path, items):
    body = "".join(f"<item><title>{t}</title><pubDate>{d}</pubDate></item>" for t, d in items)
    path.write_text(f"<rss><channel>{body}</channel></rss>")


def date(minute):
    return f"Mon, 12 Jan 2015 21:{minute:02d}:00 GMT"


def test_a_growing_feed_gives_each_item_once(spark, tmp_path):
    http_feeds.register(spark)
    one, two = tmp_path / "one.xml", tmp_path / "two.xml"
    urls = http_feeds.urls_of([(one.as_uri(), "news", -1), (two.as_uri(), "", http_feeds.published_ms(date(1)))])

    def run(**options):
        stream = spark.readStream.format("feeds").option("urls", urls).options(**options).load()
        jobs.run_to_end(stream, f"{tmp_path}/cp", lambda df, number: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}"), "append")
        return sorted((r.batch, r.title) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    feed(one, [("a1", date(1)), ("a2", date(2)), ("undated", "yesterday")])
    feed(two, [("b1", date(1)), ("b3", date(3))])
    assert run() == [(0, "a1"), (0, "a2"), (0, "b3")]
    # Old items may leave a feed; only the second feed grows.
    feed(one, [("a2", date(2))])
    feed(two, [("b3", date(3)), ("b4", date(4)), ("b5", date(4))])
    assert run()[3:] == [(1, "b4"), (1, "b5")]
    assert len(run()) == 5
    # A batch that was written but not committed has the same items when it runs again, though the feed has grown.
    feed(two, [("b4", date(4)), ("b5", date(4)), ("b6", date(6))])
    for file in (tmp_path / "cp" / "commits").iterdir():
        if file.name.strip(".").startswith("1"):
            file.unlink()
    assert run()[:5] == [(0, "a1"), (0, "a2"), (0, "b3"), (1, "b4"), (1, "b5")]
    assert run()[5:] == [(2, "b6")]


def test_an_unreachable_feed_keeps_its_watermark(tmp_path):
    there, gone = tmp_path / "there.xml", tmp_path / "gone.xml"
    feed(there, [("a", date(1))])
    feed(gone, [("b", date(2))])
    options = {"urls": http_feeds.urls_of([(there.as_uri(), "x", 5), (gone.as_uri(), "y", 7)]), "onError": "skip"}
    stream = http_feeds._Stream(options)
    start = stream.initialOffset()
    assert list(start.values()) == [5, 7]
    first = stream.latestOffset()
    gone.unlink()
    feed(there, [("a", date(1)), ("c", date(9))])
    second = stream.latestOffset()
    assert second[gone.as_uri()] == first[gone.as_uri()] and second[there.as_uri()] > first[there.as_uri()]
    assert [(p.url, p.after) for p in stream.partitions(first, second)] == [(there.as_uri(), first[there.as_uri()])]
    with pytest.raises(OSError):
        http_feeds._Stream(options).latestOffset()
    known = http_feeds._Stream(options)
    known.partitions(second, second)
    assert known.latestOffset() == second


@pytest.mark.parametrize("name", ["archive_batches", "archived_registry", "stream_feed_items"])
def test_registered(name):
    assert name in plans.QUERIES and name in plans.SQL
