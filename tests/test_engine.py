"""Sources, sinks, edge cases of refining, the policies against plain loops, streams against batches."""

from __future__ import annotations

import math
import socket
import threading
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import bayes, dictionary, evaluate, policies, refine
from tidemark.operators.sequence import number_rows, running_mean
from tidemark.sources import http_feeds, readers, writers
from tidemark.streaming import jobs

TOY = [
    (0, 0, "sport", "ball goal team"),
    (1, 1, "politic", "vote law party"),
    (2, 2, "sport", "goal match ball"),
    (3, 3, "politic", "party vote state"),
    (4, 4, "sport", "team match win"),
    (5, 5, "politic", "law state court"),
    (6, 6, "sport", "ball match"),
    (7, 7, "politic", "vote court"),
    (8, 8, "sport", "win goal"),
    (9, 9, "politic", "party law"),
]


def toy(spark):
    docs = spark.createDataFrame(TOY, "doc_id long, seq long, label string, text string")
    return docs, dictionary.token_table(docs, ("doc_id", "seq", "label"), ())


def test_toy_corpus_is_classified(spark):
    docs, tokens = toy(spark)
    model = bayes.fit(tokens.where("seq < 6"), docs.where("seq < 6"), tokens.select("term").distinct())
    got = evaluate.judged(bayes.predict(bayes.scores(model, tokens.where("seq >= 6"), docs.where("seq >= 6"))), docs)
    assert evaluate.accuracy(got).first()["accuracy"] == 1.0


def test_scores_agree_with_the_library_classifier(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import CountVectorizer, StringIndexer

    docs, tokens = toy(spark)
    words = docs.withColumn("words", F.split("text", " "))
    vectors = CountVectorizer(inputCol="words", outputCol="features").fit(words).transform(words)
    vectors = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(vectors).transform(vectors)
    library = NaiveBayes(labelCol="y", smoothing=1.0, modelType="multinomial").fit(vectors.where("seq < 6"))
    model = bayes.fit(tokens.where("seq < 6"), docs.where("seq < 6"), tokens.select("term").distinct())
    ours = {r.label: r.prior for r in model.labels.collect()}
    assert sorted(ours.values()) == pytest.approx(sorted(library.pi.toArray().tolist()))
    raw = library.transform(vectors.where("seq >= 6")).select("doc_id", "rawPrediction").collect()
    mine = {(r.doc_id, r.label): r.score for r in bayes.scores(model, tokens.where("seq >= 6"), docs.where("seq >= 6")).collect()}
    for r in raw:
        assert [mine[r.doc_id, x] for x in ("politic", "sport")] == pytest.approx(list(r.rawPrediction))


def test_numbering_and_running_mean(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(1.0).alias("v"))
    got = number_rows(df, "k", name="n").collect()
    assert all(r.k == r.n for r in got)
    means = running_mean(df, F.col("k").cast("double"), "k").collect()
    assert all(r.running == pytest.approx(r.k / 2) for r in means)
    assert number_rows(df.limit(0), "k").count() == 0


@pytest.mark.parametrize(
    ("line", "text", "label"),
    [
        ("Mon, 12 Jan 2015 21:02:57 GMT, a title, body", "body", None),
        ("Mon, 12 Jan 2015 21:02:57 GMT, a title, body, sports", "body", "sports"),
        ("Mon, 12 Jan 2015 21:02:57 GMT, a title, one, two, sports", "one", "sports"),
        ("Mon, 12 Jan 2015 21:02:57 GMT, a title, one, two, three, sports", "one  three", "sports"),
    ],
)
def test_archive_lines(spark, line, text, label):
    row = refine.parse_archive(spark.createDataFrame([(line,)], "value string")).first()
    assert (row.ts_ms, row.text, row.label) == (1421096577000, text, label)


def test_four_day_boundary_is_in_neither_part(spark):
    edge = config.START_MS + 4 * config.A_DAY_MS
    rows = spark.createDataFrame([(edge - 1,), (edge,), (edge + 1,)], "ts_ms long")
    assert [r.part for r in refine.split_by_days(rows).orderBy("ts_ms").collect()] == ["train", None, "test"]
    with pytest.raises(ValueError):
        refine.in_period(rows, 2, 1)


def test_watermark_stays_without_new_items(spark):
    registry = spark.createDataFrame([("u1", "sports", 5), ("u2", "health", 7)], "url string, category string, last_update long")
    items = spark.createDataFrame([("u1", 9), ("u1", 3)], "url string, ts_ms long")
    assert [(r.url, r.ts_ms) for r in refine.newer_than_watermark(items, registry).collect()] == [("u1", 9)]
    assert sorted((r.url, r.last_update) for r in refine.advance_watermarks(registry, items).collect()) == [("u1", 9), ("u2", 7)]


def test_keep_last_by_text(spark):
    """Two texts with one hash are two texts."""
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (2, "a", "x"), (2, "Aa", "z"), (1, "BB", "v")], "ts_ms long, text string, label string")
    got = sorted((r.text, r.label, r.text_hash) for r in refine.last_by_text(rows).collect())
    assert got == [("Aa", "z", 2112), ("BB", "v", 2112), ("a", "y", 97)]


def test_numbering_with_hot_keys(spark):
    rows = [(5 if i % 3 else i, i) for i in range(900)] + [(None, 1000), (None, 1001)]
    got = number_rows(spark.createDataFrame(rows, "k long, id long"), "k", ("id",), "n", ranges=8).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.n)] == want


def test_equal_scores_go_to_the_first_name(spark):
    for names in (("sport", "sports"), ("sports", "sport"), ("b", "a"), ("", "a")):
        scored = spark.createDataFrame([(1, x, 0.5) for x in names] + [(1, "c", 0.1)], "doc_id long, label string, score double")
        assert bayes.predict(scored).first().prediction == min(names)


def test_replayer_keeps_pace(spark, tmp_path):
    rows = [(1_000_000, "a", "x"), (1_000_000 + 50_000 * 10, "b", "x"), (1_000_000 + 50_000 * 3500, "c", "y")]
    waited = []
    ticks = writers.replay(spark.createDataFrame(rows, "ts_ms long, text string, label string"), f"{tmp_path}/out", wait=waited.append)
    assert (ticks, waited) == (4, [0, 3.0])
    assert sorted(r.value for r in readers.lines(spark, f"{tmp_path}/out").collect()) == sorted(f"({t},{x},{y})" for t, x, y in rows)


def test_registry_replaces_itself(spark, tmp_path):
    path = f"{tmp_path}/registry"
    for last in (5, 9):
        writers.registry(spark.createDataFrame([("u", "c", last)], "url string, category string, last_update long"), path)
    writers.registry(readers.registry(spark, path).withColumn("last_update", F.col("last_update") + 1), path)
    assert [tuple(r) for r in readers.registry(spark, path).collect()] == [("u", "c", 10)]
    assert [x.name for x in tmp_path.iterdir()] == ["registry"]


def test_rates_that_can_occur():
    policy = config.Incremental()
    states, index = policies.rate_states(policy), math.tan(math.pi / 32)
    for k in range(40):
        at = k if k < len(states) else len(states) - 2 + (k - len(states)) % 2
        assert states[at] == pytest.approx(abs(math.atan(index)) / (math.pi / 2), abs=1e-12)
        index = abs(index - 0.01)


def test_sinks_and_sources_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1421280000000, "some text", "sports"), (1421280001000, "more", "health")], "ts_ms long, text string, label string")
    writers.refined_text(docs, f"{tmp_path}/text", single=True)
    assert sorted(map(tuple, refine.parse_refined(readers.lines(spark, f"{tmp_path}/text")).collect())) == sorted(map(tuple, docs.collect()))
    writers.refined(docs, f"{tmp_path}/refined")
    assert refine.since(readers.refined(spark, f"{tmp_path}/refined"), 1421280000500).count() == 1
    words = spark.createDataFrame([("b", 1), ("a", 0)], "term string, term_id int")
    writers.dictionary(words, f"{tmp_path}/dictionary")
    assert sorted(map(tuple, readers.dictionary(spark, f"{tmp_path}/dictionary").collect())) == [("a", 0), ("b", 1)]
    feeds = spark.createDataFrame([("http://x/rss", "sports", 3)], "url string, category string, last_update long")
    writers.registry(feeds, f"{tmp_path}/registry")
    assert readers.registry(spark, f"{tmp_path}/registry").first().last_update == 3
    assert readers.registry(spark, f"{tmp_path}/registry", reset=True).first().last_update == 0
    writers.stop_words(spark.createDataFrame([("the",), ("and",)], "word string"), f"{tmp_path}/stop", "2015-01-15")
    assert readers.stop_words(spark, f"{tmp_path}/stop") == ["and", "the"]
    series = spark.createDataFrame([(1, 0, 50.0, 0.0625)], readers.PREDICTIONS)
    writers.prediction_series(series, f"{tmp_path}/series")
    assert readers.lines(spark, f"{tmp_path}/series").first().value == "1\t0\t50.0\t0.0625"
    items = spark.createDataFrame([("d", "t", "x", "c")], "pubDate string, title string, description string, category string")
    writers.append_archive(items, f"{tmp_path}/archive")
    writers.append_archive(items, f"{tmp_path}/archive")
    assert [r.value for r in readers.lines(spark, f"{tmp_path}/archive").collect()] == ["d, t, x, c"] * 2


FEED = """<rss xmlns:dc="urn:dc"><channel><title>c</title>
<item><title>One &amp; two</title><link>http://a</link><pubDate>Mon, 12 Jan 2015 21:02:57 GMT</pubDate></item>
<item><title>Three</title><dc:author>me</dc:author></item></channel></rss>"""


def test_feed_items(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    rows = readers.feed_items(spark, str(tmp_path / "feed.xml"), "sports").orderBy("title").collect()
    assert [(r.title, r.link, r.category) for r in rows] == [("One & two", "http://a", "sports"), ("Three", None, "sports")]
    http_feeds.register(spark)
    url = (tmp_path / "feed.xml").as_uri()
    rows = spark.read.format("feeds").option("urls", f"{url} sports").load().orderBy("title").collect()
    assert [(r.title, r.author, r.category) for r in rows] == [("One & two", None, "sports"), ("Three", "me", "sports")]


def test_failing_feeds_are_skipped_if_asked(spark, tmp_path):
    (tmp_path / "good.xml").write_text("<rss><item><title>One</title></item></rss>")
    (tmp_path / "bad.xml").write_text("<rss><item><title>Two</title></item><item>")
    http_feeds.register(spark)
    urls = "\n".join(f"{(tmp_path / x).as_uri()} news" for x in ("good.xml", "bad.xml", "absent.xml"))
    reader = spark.read.format("feeds").option("urls", urls)
    assert sorted(r.title for r in reader.option("onError", "skip").load().collect()) == ["One", "Two"]
    with pytest.raises(Exception, match="absent|not well|no element|No such file"):
        reader.option("onError", "fail").load().collect()


def test_socket_and_console(spark, tmp_path):
    """Lines from a socket reach a console query."""
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        client, _ = server.accept()
        with client:
            client.sendall(b"(1,first,x)\n(2,second,y)\n")
            time.sleep(30)

    threading.Thread(target=serve, daemon=True).start()
    lines = readers.socket_lines(spark, "127.0.0.1", server.getsockname()[1])
    query = writers.console(refine.parse_stream(lines), f"{tmp_path}/cp")
    try:
        until = time.time() + 60
        while sum(p.numInputRows for p in query.recentProgress) < 2 and time.time() < until:
            query.processAllAvailable()
            time.sleep(0.2)
        assert sum(p.numInputRows for p in query.recentProgress) == 2
        assert "Console" in query.lastProgress.sink.description
    finally:
        query.stop()
        server.close()


# --- policies against plain loops ---------------------------------------------------------------


class Plain:
    """Multinomial naive Bayes over dicts; rows are (label, terms, weight)."""

    def __init__(self, rows, size):
        self.n = Counter(label for label, _, _ in rows)
        self.c, self.t, self.size = defaultdict(Counter), Counter(), size
        for label, terms, weight in rows:
            for term in terms:
                self.c[label][term] += weight
                self.t[label] += weight

    def predict(self, terms):
        def score(label):
            prior = math.log(self.n[label] + 1) - math.log(sum(self.n.values()) + len(self.n))
            return prior + sum(math.log(self.c[label][t] + 1) - math.log(self.t[label] + self.size) for t in terms)

        return min(self.n, key=lambda x: (-round(score(x), 9), x))


@pytest.fixture(scope="module")
def stream(spark, sf_dir):
    from tidemark.plans import inputs

    tokens = inputs.tokens(spark, sf_dir).persist()
    docs = inputs.numbered(spark, sf_dir).persist()
    terms = defaultdict(list)
    for r in tokens.select("seq", "term").collect():
        terms[r.seq].append(r.term)
    rows = [(r.label, terms[r.seq]) for r in docs.orderBy("seq").collect()]
    yield tokens, docs, rows, len({t for ts in terms.values() for t in ts})
    tokens.unpersist()
    docs.unpersist()


def in_order(df):
    return [r.prediction for r in df.orderBy("seq").collect()]


def test_periodic_policy(stream):
    tokens, docs, rows, size = stream
    policy = config.Periodic(initial=40, first=81, every=40, window=40)
    want, model, start = [], None, policy.first
    for i in range(policy.initial, len(rows)):
        if model is None:
            model = Plain([(a, b, 1) for a, b in rows[: policy.initial]], size)
        if i == start:
            model, start = Plain([(a, b, 1) for a, b in rows[i - policy.window : i]], size), start + policy.every
        want.append(model.predict(rows[i][1]))
    assert in_order(policies.periodic_predictions(tokens, docs, tokens.select("term").distinct(), policy)) == want


@pytest.mark.parametrize("enabled", [True, False])
def test_error_triggered_policy(stream, enabled):
    tokens, docs, rows, size = stream
    policy = config.ErrorTriggered(initial=20, window=20, threshold=0.97, sanity=10, enabled=enabled)
    want, seen, right, wait, updates = [], 0, 0, 0, 0
    model = Plain([(a, b, 1) for a, b in rows[:20]], size)
    for i in range(20, len(rows)):
        if enabled and wait <= 0 and seen and 0 < right / seen < policy.threshold:
            model, seen, right, wait, updates = Plain([(a, b, 1) for a, b in rows[i - 20 : i]], size), 0, 0, policy.sanity, updates + 1
        want.append(model.predict(rows[i][1]))
        seen, right, wait = seen + 1, right + (want[-1] == rows[i][0]), wait - 1
    labels = sorted({label for label, _ in rows})
    got = policies.error_triggered_predictions(tokens, docs, dictionary.first_seen_ids(tokens), labels, policy)
    assert in_order(got) == want
    assert got.agg(F.max("epoch")).first()[0] == updates


@pytest.mark.parametrize("decay", ["current", "compound"])
def test_incremental_policy(stream, decay):
    tokens, docs, rows, size = stream
    policy = config.Incremental(initial=50, every=25, low_accuracy=60.0, decay=decay)
    index = math.tan(math.pi / 32)
    batches = [[(a, b, 1.0) for a, b in rows[:50]]]
    model, want, right = Plain(batches[0], size), [], 0
    for i in range(50, len(rows)):
        if i > 50 and (i - 50) % 25 == 0:
            index = math.tan(math.pi / 32) if 100 * right / 25 < 60 else abs(index - 0.01)
            keep, right = 1 - abs(math.atan(index)) / (math.pi / 2), 0
            fresh = [(a, b, 1.0) for a, b in rows[i - 25 : i]]
            if decay == "compound":
                batches = [[(a, b, w * keep) for a, b, w in x] for x in batches] + [fresh]
            else:
                batches.append(fresh)
                batches = [[(a, b, keep**age) for a, b, _ in x] for age, x in zip(range(len(batches) - 1, -1, -1), batches, strict=True)]
            model = Plain([row for x in batches for row in x], size)
        want.append(model.predict(rows[i][1]))
        right += want[-1] == rows[i][0]
    labels = sorted({label for label, _ in rows})
    assert in_order(policies.incremental_predictions(tokens, docs, dictionary.first_seen_ids(tokens), labels, policy)) == want


# --- streams ------------------------------------------------------------------------------------

ROWS = [(i, i * 50_000 * 10, "sport" if i % 2 else "politic", t) for i, (_, _, _, t) in enumerate(TOY * 3)]
SCHEMA = "doc_id long, ts_ms long, label string, text string"


@pytest.fixture
def folder(spark, tmp_path):
    for k in range(0, len(ROWS), 5):
        spark.createDataFrame(ROWS[k : k + 5], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        import time

        time.sleep(0.05)
    return tmp_path


def streamed(spark, folder):
    from pyspark.sql.types import _parse_datatype_string

    return readers.file_rows(spark, f"{folder}/in", _parse_datatype_string(SCHEMA))


def test_stream_counts_equal_batch_counts(spark, folder):
    jobs.run_to_end(jobs.label_term_counts(streamed(spark, folder)), f"{folder}/cp", mode="complete", table="counts")
    batch = jobs.label_term_counts(spark.createDataFrame(ROWS, SCHEMA))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_phase_and_first_seen(spark, folder):
    jobs.run_to_end(jobs.first_seen_counts(streamed(spark, folder), 100, 50), f"{folder}/cp", table="firsts")
    last = {}
    for r in spark.table("firsts").collect():
        if (r.label, r.term) not in last or last[r.label, r.term][0] < r.n:
            last[r.label, r.term] = (r.n, r.first_ts)
    want = {}
    for _, ts, label, text in ROWS:
        if ts // 50_000 % 100 < 50:
            for t in text.split():
                n, first = want.get((label, t), (0, ts))
                want[label, t] = (n + 1, min(first, ts))
    assert last == want


def test_phase_machine_trains_then_predicts(spark, folder):
    machine = jobs.PhaseMachine(spark, f"{folder}/state", interval=200, training=100, smoothing=config.MULTINOMIAL)
    jobs.run_to_end(streamed(spark, folder), f"{folder}/cp", each=machine, mode="append")
    assert spark.read.parquet(f"{folder}/state/predictions").count() > 0
    metrics = spark.read.parquet(f"{folder}/state/metrics").collect()
    assert all(0 <= m.accuracy <= 1 for m in metrics)


@pytest.mark.parametrize("tf_idf", [False, True])
def test_phase_machine_goes_on_after_a_restart(spark, folder, tf_idf):
    """A new machine for each micro-batch comes to the same predictions as one for all; a replayed batch changes nothing."""
    batches = [spark.createDataFrame(ROWS[k : k + 5], SCHEMA) for k in range(0, len(ROWS), 5)]
    one = jobs.PhaseMachine(spark, f"{folder}/one", 200, 100, config.MULTINOMIAL, tf_idf)
    for number, batch in enumerate(batches):
        one(batch, number)
        for _ in (1, 2):
            jobs.PhaseMachine(spark, f"{folder}/many", 200, 100, config.MULTINOMIAL, tf_idf)(batch, number)
    got = [sorted(tuple(r) for r in spark.read.parquet(f"{folder}/{x}/predictions").select("doc_id", "prediction").collect()) for x in ("one", "many")]
    assert got[0] == got[1] and got[0]
    states = [r.state for r in spark.read.parquet(f"{folder}/one/state").orderBy("batch").collect()]
    assert states[0] == "train" and "predict" in states


def test_term_days_and_dedup(spark, folder):
    jobs.run_to_end(jobs.term_days(streamed(spark, folder), 0), f"{folder}/cp", mode="complete", table="days")
    assert spark.table("days").agg(F.sum("df")).first()[0] == sum(len(set(t.split())) for *_, t in ROWS)
    timed = streamed(spark, folder).withColumn("ts", F.timestamp_millis("ts_ms"))
    jobs.run_to_end(jobs.deduplicated(timed, "text", "ts", "1 hour"), f"{folder}/cp2", mode="append", table="once")
    assert spark.table("once").count() == len({t for *_, t in ROWS})
