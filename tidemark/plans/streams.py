"""Registered queries over streams whose state is bounded by watermarks, timers and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import config
from tidemark.config import START_MS
from tidemark.functions import numeric as N
from tidemark.functions import text as X
from tidemark.operators import bayes, evaluate, refine
from tidemark.plans import catalog as C
from tidemark.plans import inputs as I
from tidemark.plans.registry import query
from tidemark.sources import archive, http_feeds, readers, writers
from tidemark.storage import file_system, materialize, new_path
from tidemark.streaming import jobs, joins, progress, state

TTL = 2
#: A label comes up to 36 hours after its item here; those of the first 24 count.
LAG_HOURS, WITHIN_HOURS = 36, 24


def _lag() -> F.Column:
    return F.pmod(F.col("doc_id") * 7919, F.lit(LAG_HOURS))


@query(f"""WITH {I.ROWS}, {I.bayes_sql(C._TRAIN, C._TEST, add=0.1, vocabulary=False, prior=None)}
SELECT doc_id, prediction, label, prediction = label AS correct, (doc_id * 7919) % {LAG_HOURS} AS lag_hours FROM m_pred JOIN numbered USING (doc_id) WHERE (doc_id * 7919) % {LAG_HOURS} <= {WITHIN_HOURS}""")
def stream_late_labels(spark, sf):
    """A stream of predictions joined with a stream of labels that come later, each in micro-batches by time."""
    model, tokens, rows = C._offline(spark, sf, config.STREAM_RATIO)
    made = materialize(bayes.predict(bayes.scores(model, tokens, rows)).join(rows, "doc_id"), "late")
    sides = []
    for name, time, columns in (("prediction", "predicted_at", ["prediction"]), ("label", "labelled_at", ["label"])):
        ts = F.col("ts_ms") + (_lag() * config.AN_HOUR_MS if name == "label" else 0)
        side = made.select("doc_id", *columns, F.timestamp_millis(ts).alias(time))
        folder = new_path(spark, f"late-{name}")
        writers.in_slices(side, folder, F.floor((F.unix_millis(time) - START_MS) / (4 * config.A_DAY_MS)))
        sides.append(readers.sliced_rows(state.session(spark) if not sides else sides[0].sparkSession, folder, side.schema))
    met = joins.judged_late(*sides, f"{WITHIN_HOURS} HOURS")
    lag = F.expr("timestampdiff(HOUR, predicted_at, labelled_at)").alias("lag_hours")
    return C._drained(spark, met, "append").select("doc_id", "prediction", "label", "correct", lag)


@query(f"""WITH {I.TERMS}, seen AS (SELECT DISTINCT doc_id, (ts_ms - {START_MS}) // 86400000 AS day, unnest(words) AS term FROM termed),
d AS (SELECT term, day, count(*) AS n, day - lag(day) OVER (PARTITION BY term ORDER BY day) AS gap FROM seen GROUP BY 1, 2),
e AS (SELECT *, sum(CASE WHEN gap <= {TTL} THEN 0 ELSE 1 END) OVER (PARTITION BY term ORDER BY day) AS life FROM d)
SELECT term, min(day) AS init_day, max(day) AS last_day, sum(n)::BIGINT AS df, count(*) AS n_days FROM e GROUP BY term, life""")
def stream_dictionary_entries(spark, sf):
    """The dictionary as keyed state whose entries expire when their term is not seen for more than two days."""
    entries = state.dictionary_entries(C._by_time(spark, sf), X.tokens(F.col("text")), START_MS, TTL)
    return jobs.latest(C._drained(spark, entries, "update"), ("term", "init_day")).drop("expired")


@query(f"""WITH {I.ROWS}, {I.bayes_sql(C._TRAIN, C._TEST, add=0.1, vocabulary=False, prior=None)}, s AS (SELECT prediction = label AS ok, (ts_ms - {START_MS}) // {3 * config.A_DAY_MS} AS slice FROM m_pred JOIN numbered USING (doc_id))
SELECT dense_rank() OVER (ORDER BY slice) - 1 AS batch, count(*) AS n, count(*) FILTER (WHERE ok) AS n_correct, count(*) AS n_input FROM s GROUP BY slice""")
def stream_progress(spark, sf):
    """Accuracy of each micro-batch of three days of predictions, as a listener writes it down while the rows pass into a Parquet sink."""
    model, tokens, rows = C._offline(spark, sf, config.STREAM_RATIO)
    judged = evaluate.judged(bayes.predict(bayes.scores(model, tokens, rows)), rows).select("doc_id", "ts_ms", "label", "prediction", "correct")
    folder, metrics = new_path(spark, "progress-in"), new_path(spark, "progress")
    writers.in_slices(judged, folder, F.floor((F.col("ts_ms") - START_MS) / (3 * config.A_DAY_MS)))
    stream = progress.measured(readers.sliced_rows(spark, folder, judged.schema), F.col("correct"))
    progress.run(stream, new_path(spark, "progress-out"), new_path(spark, "progress-checkpoint"), f"progress-{uuid.uuid4().hex}", metrics)
    return progress.read(spark, metrics)


# --- phases -------------------------------------------------------------------------------------------

#: Twelve slices of time, four a cycle, of which the first two train.
SLICES = 12
CYCLE = 4 * I.SPAN_MS // SLICES // config.TIME_SCALE


def _phase_sql(tf_idf: bool) -> str:
    """CTEs up to ``judged`` (bn, doc_id, label, prediction): the phase machine's steps by recursion over micro-batches, and a model for each of its fits."""
    weigh = {
        # The dictionary of a model has the document frequencies of its training rows; other terms don't count.
        True: """dfs AS (SELECT model, term, count(DISTINCT doc_id) AS df FROM fits JOIN saved ON bn < model JOIN w USING (doc_id) GROUP BY 1, 2),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
wt AS (SELECT model, doc_id, term, (0.5 + 0.5 * tf / max(tf) OVER (PARTITION BY model, doc_id)) * ln((20000 // df)::DOUBLE) AS weight FROM tfs JOIN dfs USING (term))""",
        False: "wt AS (SELECT model, doc_id, term, count(*)::DOUBLE AS weight FROM fits CROSS JOIN w GROUP BY 1, 2, 3)",
    }[tf_idf]
    return f"""WITH RECURSIVE {I.TERMS}, cut AS (SELECT doc_id, ts_ms, label, words, (ts_ms - {START_MS}) * {SLICES} // {I.SPAN_MS} AS slice FROM termed),
r AS (SELECT *, dense_rank() OVER (ORDER BY slice) - 1 AS bn FROM cut), w AS (SELECT doc_id, unnest(words) AS term FROM r),
bt AS (SELECT bn, (min(ts_ms) // 50000) % {CYCLE} < {CYCLE // 2} AS training FROM r GROUP BY 1),
ph AS (SELECT -1::BIGINT AS bn, true AS train, NULL::BIGINT AS model, false AS held, false AS kept, NULL::BIGINT AS used
  UNION ALL SELECT bt.bn, CASE WHEN training THEN true WHEN train AND held THEN false ELSE train END,
    CASE WHEN NOT training AND train AND held THEN bt.bn ELSE model END, held OR (training AND train), training AND train,
    CASE WHEN training AND train THEN NULL WHEN train AND held THEN bt.bn ELSE model END FROM ph JOIN bt ON bt.bn = ph.bn + 1),
fits AS (SELECT DISTINCT used AS model FROM ph WHERE used IS NOT NULL), saved AS (SELECT r.bn, doc_id, label FROM r JOIN ph ON ph.bn = r.bn AND kept),
{weigh},
c AS (SELECT model, label, term, sum(weight) AS c FROM wt JOIN saved USING (doc_id) WHERE bn < model GROUP BY 1, 2, 3),
l AS (SELECT d.model, d.label, ln(coalesce(sum(c), 0) + 0.1) AS base FROM (SELECT DISTINCT model, label FROM fits JOIN saved ON bn < model) d LEFT JOIN c ON c.model = d.model AND c.label = d.label GROUP BY 1, 2),
t AS (SELECT r.bn, r.doc_id, r.label, used AS model FROM r JOIN ph ON ph.bn = r.bn WHERE used IS NOT NULL),
s AS (SELECT t.doc_id, l.label, sum(wt.weight * (ln(coalesce(c.c, 0) + 0.1) - base)) AS score FROM t JOIN wt ON wt.doc_id = t.doc_id AND wt.model = t.model JOIN l ON l.model = t.model
  LEFT JOIN c ON c.model = t.model AND c.label = l.label AND c.term = wt.term GROUP BY 1, 2),
judged AS (SELECT t.bn, t.doc_id, t.label, l.label AS prediction FROM t JOIN l ON l.model = t.model LEFT JOIN s ON s.doc_id = t.doc_id AND s.label = l.label
  QUALIFY row_number() OVER (PARTITION BY t.doc_id ORDER BY round(coalesce(score, 0), 9) DESC, l.label) = 1)"""


def _phases(spark, sf, tf_idf):
    """The folder in which a phase machine left its results, with a slice of time in each micro-batch."""
    rows, files, folder = I.docs(spark, sf), new_path(spark, "phase-in"), new_path(spark, "phase")
    writers.in_slices(rows, files, F.floor((F.col("ts_ms") - START_MS) * SLICES / I.SPAN_MS))
    machine = jobs.PhaseMachine(spark, folder, CYCLE, CYCLE // 2, tf_idf=tf_idf)
    jobs.run_to_end(readers.sliced_rows(spark, files, rows.schema), f"{folder}/checkpoint", machine, "append")
    empty = spark.createDataFrame([], "doc_id long, label string, prediction string, correct boolean")
    empty.write.mode("overwrite").parquet(f"{folder}/predictions/batch=-1")
    return spark.read.schema("doc_id long, label string, prediction string, correct boolean, batch int").option("basePath", f"{folder}/predictions").parquet(f"{folder}/predictions")


@query(f"{_phase_sql(False)} SELECT bn AS batch, count(*) AS n, count(*) FILTER (WHERE prediction = label) AS n_correct, count(*) FILTER (WHERE prediction = label) / count(*)::DOUBLE AS accuracy FROM judged GROUP BY 1")
def stream_phase_machine(spark, sf):
    """Training and predicting in turns of event time, each micro-batch a slice of it: accuracy of each that was predicted."""
    return evaluate.accuracy(_phases(spark, sf, False), ("batch",)).withColumn("batch", F.col("batch").cast("long"))


@query(f"{_phase_sql(True)} SELECT bn AS batch, doc_id, label, prediction FROM judged")
def stream_phase_tfidf_predictions(spark, sf):
    """Naive Bayes on tf-idf by phase: dictionary and model are those of the rows that the training phases kept."""
    return _phases(spark, sf, True).select(F.col("batch").cast("long").alias("batch"), "doc_id", "label", "prediction")


# --- feeds and archives -----------------------------------------------------------------------------

_EVENTS = "e AS (SELECT event_type AS feed, event_id, (epoch_us(ts) // 1000000) * 1000 AS ts_ms, props FROM events)"


def _feed_files(spark, sf):
    """A feed document for each type of event, and the middle of its times: [(url, category, last_update)]."""
    e = I.table(spark, sf, "events").select(F.col("event_type").alias("feed"), "event_id", (F.floor(N.epoch_ms(F.col("ts")) / 1000) * 1000).alias("ts_ms"), "props")
    date = F.date_format(N.utc_clock(F.col("ts_ms")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    escaped = F.replace(F.replace(F.coalesce("props", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit("<item><title>"), F.col("event_id").cast("string"), F.lit("</title><description>"), escaped, F.lit("</description><pubDate>"), date, F.lit("</pubDate></item>"))
    ends = e.groupBy("feed").agg(((F.min("ts_ms") + F.max("ts_ms")) / 2).cast("long").alias("middle"))
    lines = e.select("feed", F.lit(1).alias("part"), "ts_ms", item.alias("value"))
    for part, line in ((0, "<rss><channel>"), (2, "</channel></rss>")):
        lines = lines.unionByName(ends.select("feed", F.lit(part).alias("part"), F.lit(0).cast("long").alias("ts_ms"), F.lit(line).alias("value")))
    folder = new_path(spark, "feeds")
    lines.repartition("feed").sortWithinPartitions("feed", "part", "ts_ms").select("feed", "value").write.partitionBy("feed").text(folder)
    fs, at = file_system(spark, folder)
    files = {x.getPath().getName().split("=")[1]: fs.listStatus(x.getPath())[0].getPath().toUri() for x in fs.listStatus(at) if x.isDirectory()}
    return [(f"file://{files[r.feed].getPath()}", r.feed, r.middle) for r in ends.orderBy("feed").collect()]


@query(f"""WITH {_EVENTS}, m AS (SELECT feed, (min(ts_ms) + max(ts_ms)) // 2 AS middle FROM e GROUP BY 1)
SELECT feed AS category, event_id::VARCHAR AS title, coalesce(props, '') AS description, ts_ms FROM e JOIN m USING (feed) WHERE ts_ms > middle""")
def stream_feed_items(spark, sf):
    """Feeds as a stream that starts from the registry's watermarks, the middle of each feed's times."""
    session = state.session(spark)
    http_feeds.register(session)
    items = session.readStream.format("feeds").option("urls", http_feeds.urls_of(_feed_files(spark, sf))).load()
    ms = N.rfc822_ms(F.col("pubDate"))
    out = C._drained(spark, items, "append")
    return out.select("category", "title", F.coalesce("description", F.lit("")).alias("description"), ms.alias("ts_ms"))


@query("SELECT p_partkey, p_name, p_brand FROM part")
def archive_batches(spark, sf):
    """An archive to which a batch job appends half, twice under one id, and a stream the rest."""
    path = new_path(spark, "archive")
    rows = I.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    first, rest = rows.where("p_partkey % 2 = 0"), rows.where("p_partkey % 2 <> 0")
    for _ in (1, 2):
        archive.append(first, path, "first half")
    folder = new_path(spark, "archive-in")
    rest.write.parquet(folder)
    jobs.run_into(readers.file_rows(spark, folder, rows.schema), "archive", new_path(spark, "archive-checkpoint"), {"path": path, "batch": "second half"})
    return archive.read(spark, path, rows.schema)


@query("""SELECT user_id::VARCHAR AS url, 'news' AS category, max(epoch_us(ts) // 1000) AS last_update FROM events GROUP BY 1""")
def archived_registry(spark, sf):
    """A registry in an archive: written, then replaced by its advanced self, which reads it."""
    path = new_path(spark, "registry")
    items, registry = C._feeds(spark, sf)
    archive.replace(registry.withColumn("category", F.lit("news")).select("url", "category", "last_update"), path)
    archive.replace(refine.advance_watermarks(archive.read(spark, path, readers.REGISTRY), items).select("url", "category", "last_update"), path)
    return archive.read(spark, path, readers.REGISTRY)
