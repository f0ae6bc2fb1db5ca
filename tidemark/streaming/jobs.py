"""Structured Streaming: the classifier's jobs over replayable sources.

State that is a plain aggregate stays in Spark's state store. What a job does with each
micro-batch (train, predict, measure) is a normal plan in ``foreachBatch`` against tables
that carry the batch's number, so a replayed batch overwrites its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import STREAM_RATIO, Smoothing
from tidemark.functions.numeric import idf_whole, phase_divided
from tidemark.functions.text import tokens as text_tokens
from tidemark.operators import bayes, dictionary, evaluate, splitting
from tidemark.storage import materialize


def exploded(stream: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """keep columns and one row per term."""
    return stream.select(*keep, F.explode(text_tokens(F.col(text))).alias("term"))


def label_term_counts(stream: DataFrame, interval: int | None = None, training: int = 0, window: str | None = None, delay: str = "1 hour") -> DataFrame:
    """label, term, n over the stream; with a cycle, only rows of its training part count.

    window: counts are kept for each such stretch of the column ``time`` (its ``start`` is a column) and leave the state when the
    watermark, ``delay`` behind the latest time, has passed it. Without one they are kept for ever.
    """
    rows = stream if interval is None else stream.where(phase_divided(F.col("ts_ms"), interval, training))
    keys, rows = _windowed(rows, ("label",), window, delay)
    return rows.groupBy(*keys, "term").agg(F.count("*").alias("n")).select(*_plain(keys), "term", "n")


def first_seen_counts(stream: DataFrame, interval: int, training: int, window: str | None = None, delay: str = "1 hour") -> DataFrame:
    """label, term, n, first_ts over the stream: counts and the time of the first row, of the training part of each cycle; window as above.

    Both are plain aggregates, so the state stays in Spark's own store.
    """
    keys, rows = _windowed(stream.where(phase_divided(F.col("ts_ms"), interval, training)), ("label",), window, delay, ("ts_ms",))
    return rows.groupBy(*keys, "term").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ts")).select(*_plain(keys), "term", "n", "first_ts")


def _windowed(rows: DataFrame, keys: tuple[str, ...], window: str | None, delay: str, more: tuple[str, ...] = ()) -> tuple[list, DataFrame]:
    """(keys of a count, rows of single terms with them and the columns ``more``)."""
    if window is None:
        return list(keys), exploded(rows, (*keys, *more))
    return [*keys, F.window("time", window)], exploded(rows.withWatermark("time", delay), (*keys, *more, "time"))


def _plain(keys: list) -> list:
    return [k if isinstance(k, str) else F.col("window.start").alias("start") for k in keys]


def term_days(stream: DataFrame, start_ms: int, delay: str = "1 hour") -> DataFrame:
    """term, day, df over the stream: the documents of each day that have the term.

    With a column ``time`` a day leaves the state when the watermark, ``delay`` behind the latest, has passed it.
    """
    terms = F.explode(F.array_distinct(text_tokens(F.col("text")))).alias("term")
    day = F.floor((F.col("ts_ms") - start_ms) / 86_400_000).alias("day")
    if "time" not in stream.columns:
        return stream.select(day, terms).groupBy("term", "day").agg(F.count("*").alias("df"))
    rows = stream.withWatermark("time", delay).select("time", terms)
    counts = rows.groupBy(F.window("time", "1 day", startTime=f"{start_ms % 86_400_000} milliseconds"), "term").agg(F.count("*").alias("df"))
    return counts.select("term", F.floor((F.unix_millis(F.col("window.start")) - start_ms) / 86_400_000).alias("day"), "df")


def latest(versions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Of each key the row of the last ``batch``: what an update-mode stream has come to."""
    rest = [c for c in versions.columns if c not in (*keys, "batch")]
    # Column by column: of plain numbers it is a hash aggregate, of a struct a sort of all versions.
    return versions.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def term_frequencies(batch: DataFrame) -> DataFrame:
    """ts_ms, label, term, tf of one micro-batch; nothing is carried over.

    Rows are counted where they are read. Only those that share time and label with another row are added up, in a shuffle.
    """
    shared = materialize(batch.groupBy("ts_ms", "label").agg(F.count("*").alias("n")).where("n > 1").select("ts_ms", "label"), "shared-times")
    keep = ("ts_ms", "label")
    if shared.isEmpty():
        return splitting.counted_texts(batch, keep)
    a, b = batch.alias("a"), shared.alias("b")
    same = F.expr("a.ts_ms <=> b.ts_ms AND a.label <=> b.label")
    met = splitting.counted_texts(a.join(b, same, "left_semi"), keep)
    return splitting.counted_texts(a.join(b, same, "left_anti"), keep).unionByName(met.groupBy(*keep, "term").agg(F.sum("tf").alias("tf")))


def deduplicated(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Rows whose key did not come before within the watermark (an addition to the batch engine)."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "update", table: str | None = None):
    """Run a query over all that is there, then stop: to a function for each batch, or to an in-memory table."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(each) if each else writer.format("memory").queryName(table)).start()
    query.awaitTermination()
    return query


def run_into(stream: DataFrame, format: str, checkpoint: str, options: dict[str, str], mode: str = "append"):
    """Run a query over all that is there into a sink, then stop."""
    query = stream.writeStream.format(format).outputMode(mode).options(**options).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def counted(rows: DataFrame) -> DataFrame:
    """doc_id, term, weight: each term as often as it occurs."""
    return exploded(rows, ("doc_id",)).withColumn("weight", F.lit(1.0))


#: Labels of a model up to which its table of terms has a column for each.
WIDE_LABELS = 16


class PhaseMachine:
    """Train and predict in turns of scaled event time.

    A batch belongs to the phase of its first row. Training batches and their sums by label and term are appended to
    tables under their number; the first predicting batch after them fits the model, which is written once and
    read by all later batches; a batch that crosses back into training is still predicted.
    ``tf_idf``: terms count by their augmented tf-idf, with the document frequencies of the training rows.

    What a batch leaves (phase, model's folder) is a row written under its number. A batch
    starts from the row of the batch before it, so a restarted query goes on where it was, and a
    replayed batch comes to the same result.
    """

    #: Terms of a model that are broadcast.
    hot = dictionary.HOT_ROWS

    def __init__(self, spark: SparkSession, folder: str, interval: int, training: int, smoothing: Smoothing = STREAM_RATIO, tf_idf: bool = False):
        self.spark, self.folder, self.interval, self.training, self.smoothing, self.tf_idf = spark, folder, interval, training, smoothing, tf_idf

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")

    def _before(self, number: int) -> tuple[str, int | None, bool]:
        """(state, number of the batch whose model holds, whether there are training rows) after the batch before."""
        try:
            rows = self._read("state")
        except AnalysisException:  # the first batch
            return "train", None, False
        row = rows.where(F.col("batch") < number).orderBy(F.desc("batch")).first()
        return (row.state, row.model, row.has_rows) if row else ("train", None, False)

    def _after(self, number: int, state: str, model: int | None, has_rows: bool) -> None:
        self._write(self.spark.createDataFrame([(state, model, has_rows)], "state string, model int, has_rows boolean"), "state", number)

    def _weighed(self, rows: DataFrame, known: DataFrame | None) -> DataFrame:
        counts = dictionary.counted_terms(rows, ("doc_id",), text_tokens(F.col("text")))
        weighed = dictionary.weighed(counts, known) if known is not None else counts.select("doc_id", "term", F.col("tf").cast("double").alias("weight"))
        # Texts are split once for all that reads the weights.
        return materialize(weighed, "phase-weights")

    @staticmethod
    def _repeats(rows: DataFrame) -> bool:
        """Whether documents come several times: then their terms must meet before they are weighed."""
        return not rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()

    def _fit(self, number: int) -> None:
        rows = self._read("rows").where(F.col("batch") < number)
        if self._repeats(rows):
            self._fit_repeated(number, rows)
        else:
            self._fit_sums(number, rows)
        own, known = self._model(number)
        if own.labels.count() <= WIDE_LABELS:
            terms = bayes.gains_by_term(own, own.labels.collect())
            if known is not None:
                terms = known.select("term", F.col("df").alias("often"), idf_whole(20_000, F.col("df")).alias("idf")).join(terms.drop("often"), "term", "left")
            terms = materialize(terms, "phase-terms")
            hot = terms if terms.count() <= self.hot else terms.orderBy(F.desc("often")).limit(self.hot)
            self._write(hot, "hot", number)
            hot = self.spark.read.schema(hot.schema).parquet(f"{self.folder}/hot/batch={number}")
            self._write(terms.join(F.broadcast(hot.select("term")), "term", "left_anti"), "cold", number)

    def _fit_sums(self, number: int, rows: DataFrame) -> None:
        """Of documents that come once: training batches are added up; a document's weights are its own but for the idf, which is the term's."""
        sums = self._read("sums").where(F.col("batch") < number).groupBy("label", "term").agg(F.sum("n").alias("n"), F.sum("amount").alias("count"))
        sums = materialize(sums, "phase-sums")
        if self.tf_idf:
            self._write(sums.groupBy("term").agg(F.sum("n").alias("df")), "dictionary", number)
            known = self.spark.read.parquet(f"{self.folder}/dictionary/batch={number}")
            idf = idf_whole(20_000, F.col("df"))
            sums = sums.join(known, "term").select("label", "term", (F.col("count") * idf).alias("count"))
        model = bayes.fit_counts(sums.select("label", "term", "count"), rows.select("label"), sums.select("term").distinct(), self.smoothing)
        self._write(model.labels, "labels", number)
        self._write(model.conditionals, "conditionals", number)

    def _scores(self, batch: DataFrame, number: int) -> DataFrame:
        own, known = self._model(number)
        if self._repeats(batch) or own.labels.count() > WIDE_LABELS:
            return bayes.scores(own, self._weighed(batch, known), batch.select("doc_id", "label"), weight="weight")
        hot, cold = (self.spark.read.parquet(f"{self.folder}/{x}/batch={number}") for x in ("hot", "cold"))
        return bayes.scores_of_sums(splitting.counted_texts(batch, ("doc_id",)), batch, own.labels.collect(), hot, cold, self.tf_idf)

    def _fit_repeated(self, number: int, rows: DataFrame) -> None:
        known = None
        if self.tf_idf:
            self._write(dictionary.document_frequency(dictionary.counted_terms(rows, ("doc_id",), text_tokens(F.col("text")))), "dictionary", number)
            known = self.spark.read.parquet(f"{self.folder}/dictionary/batch={number}")
        tokens = self._weighed(rows, known).join(rows.select("doc_id", "label"), "doc_id")
        model = bayes.fit(tokens, rows.select("label"), tokens.select("term").distinct(), self.smoothing, weight="weight")
        self._write(model.labels, "labels", number)
        self._write(model.conditionals, "conditionals", number)

    def _model(self, number: int) -> tuple[bayes.Model, DataFrame | None]:
        labels, conditionals = (self.spark.read.parquet(f"{self.folder}/{x}/batch={number}") for x in ("labels", "conditionals"))
        known = self.spark.read.parquet(f"{self.folder}/dictionary/batch={number}") if self.tf_idf else None
        return bayes.Model(labels, conditionals, (), self.smoothing), known

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            state, model, has_rows = self._before(number)
            first = batch.agg(F.min("ts_ms").alias("ts")).first()["ts"]
            if first is None:
                return
            training = (first // 50_000) % self.interval < self.training
            if training and state == "train":
                self._write(batch.select("doc_id", "ts_ms", "label", "text"), "rows", number)
                self._write(splitting.summed_texts(batch, ("label",), augmented=self.tf_idf), "sums", number)
                self._after(number, state, model, True)
                return
            if state == "train" and has_rows:
                self._fit(number)
                state, model = "predict", number
            if model is not None:
                docs = batch.select("doc_id", "label")
                self._write(evaluate.judged(bayes.predict(self._scores(batch, model)), docs), "predictions", number)
                judged = self.spark.read.parquet(f"{self.folder}/predictions/batch={number}")
                self._write(evaluate.accuracy(judged).withColumn("batch_number", F.lit(number)), "metrics", number)
            self._after(number, "train" if training else state, model, has_rows)
        finally:
            batch.unpersist()
