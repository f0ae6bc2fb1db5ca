"""Naive Bayes as aggregations and joins.

A fit is three tables: priors (label), totals (label) and conditionals (label, term).
Only terms that a label has seen are stored; the score of a document starts from
"all its terms unseen" and is corrected for those that were seen:

    score = prior + length * unseen + sum over seen terms of (log theta - unseen)

so there is never a row for each document, term and label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import MULTINOMIAL, Smoothing
from tidemark.functions.numeric import ln
from tidemark.operators.dictionary import join_terms
from tidemark.storage import materialize

#: Rows of a labels' table (of a few numbers each) that a broadcast may have.
BROADCAST_LABELS = 10_000


@dataclass
class Model:
    """labels: key..., label, prior, unseen; conditionals: key..., label, term, count, gain (log theta - unseen)."""

    labels: DataFrame
    conditionals: DataFrame
    key: tuple[str, ...]
    smoothing: Smoothing


def fit(tokens: DataFrame, docs: DataFrame, vocabulary: DataFrame | int, smoothing: Smoothing = MULTINOMIAL, key: tuple[str, ...] = (), weight: str | None = None) -> Model:
    """Fit on tokens (key, label, term) and documents (key, label); one model for each value of ``key``.

    ``vocabulary`` is the size of the dictionary or a table whose rows are its terms. Term
    counts may be weighted, documents never are.
    """
    amount = F.sum(weight) if weight else F.count("*").cast("double")
    return fit_counts(tokens.groupBy(*key, "label", "term").agg(amount.alias("count")), docs, vocabulary, smoothing, key)


def fit_counts(counts: DataFrame, docs: DataFrame, vocabulary: DataFrame | int, smoothing: Smoothing = MULTINOMIAL, key: tuple[str, ...] = ()) -> Model:
    """`fit` on tokens that are added up: one row (key, label, term, count) for each label's term."""
    by = [*key, "label"]
    add = float(smoothing.add)
    counts = materialize(counts, "bayes-counts")
    totals = counts.groupBy(*by).agg(F.sum("count").alias("total"))
    documents = docs.groupBy(*by).agg(F.count("*").cast("double").alias("n"))
    labels = documents.join(totals, by, "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    every = labels.groupBy(*key).agg(F.sum("n").alias("all_n"), F.count("*").alias("k"), F.sum("total").alias("all_total"))
    labels = labels.join(every, list(key)) if key else labels.crossJoin(F.broadcast(every))  # without a key: one row
    if smoothing.vocabulary:
        size = F.lit(float(vocabulary)) if isinstance(vocabulary, int) else None
        if size is None:
            labels = labels.crossJoin(F.broadcast(vocabulary.agg(F.count("*").cast("double").alias("v"))))
            size = F.col("v")
        base = F.col("total") + size * add
    else:
        base = F.col("total") + add
    prior = {
        "documents": F.log(F.col("n") + add) - F.log(F.col("all_n") + F.col("k") * add),
        "words": ln(F.col("total") / F.col("all_total")),
        None: F.lit(0.0),
    }[smoothing.prior]
    unseen = F.lit(add) if smoothing.seen_only else F.log(F.lit(add)) - ln(base)
    labels = labels.select(*by, "n", "total", prior.alias("prior"), unseen.alias("unseen"), ln(base).alias("log_base"))
    gain = ln(F.col("count") + add) - F.col("log_base")
    if not smoothing.seen_only:
        gain = gain - F.col("unseen")
    labels = materialize(labels, "bayes-labels")
    conditionals = counts.join(_sized(labels), by).select(*by, "term", "count", (ln(F.col("count") + add) - F.col("log_base")).alias("log_theta"), gain.alias("gain"))
    labels = labels.withColumn("unseen", F.lit(0.0)) if smoothing.seen_only else labels
    return Model(labels, materialize(conditionals, "bayes-conditionals"), key, smoothing)


def _sized(labels: DataFrame) -> DataFrame:
    """A written table of labels (a row for each key and label), broadcast if it is small by count."""
    return F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels


def scores(model: Model, tokens: DataFrame, docs: DataFrame, doc: str = "doc_id", dictionary: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """key..., doc, label, score for each document and each label of its model.

    With ``dictionary`` (term) other terms are dropped; with ``weight`` a term counts that often. The labels' table has a row for each key and
    label; it is counted before it is broadcast.
    """
    key = list(model.key)
    if dictionary is not None:
        tokens = tokens.join(dictionary.select("term"), "term", "left_semi")
    tokens = tokens.select(*key, doc, "term", (F.col(weight) if weight else F.lit(1.0)).alias("weight"))
    length = tokens.groupBy(*key, doc).agg(F.sum("weight").alias("length"))
    gains = model.conditionals.select(*key, "label", "term", "gain", "count")
    # A weighted count may be minus infinity: that of a term in very many documents.
    seen = tokens.join(gains, [*key, "term"]) if key else join_terms(tokens, gains, F.abs("count"))
    seen = seen.groupBy(*key, doc, "label").agg(F.sum(F.col("weight") * F.col("gain")).alias("gain"))
    rows = docs.select(*key, doc).join(length, [*key, doc], "left")
    labels = model.labels.select(*key, "label", "prior", "unseen")
    rows = rows.join(_sized(labels), key) if key else rows.crossJoin(_sized(labels))
    rows = rows.join(seen, [*key, doc, "label"], "left")
    score = F.col("prior") + F.coalesce(F.col("length") * F.col("unseen"), F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))
    return rows.select(*key, doc, "label", score.alias("score"))


def gains_by_term(model: Model, labels: list) -> DataFrame:
    """term, often, gain_0, gain_1, ... of a model without a key: a row for each term, a gain (null: unseen) for each of its labels (rows of ``model.labels``)."""
    gains = [F.max(F.when(F.col("label") == row.label, F.col("gain"))).alias(f"gain_{i}") for i, row in enumerate(labels)]
    return model.conditionals.groupBy("term").agg(F.sum(F.abs("count")).alias("often"), *gains)


def scores_of_sums(counts: DataFrame, docs: DataFrame, labels: list, hot: DataFrame, cold: DataFrame, tf_idf: bool) -> DataFrame:
    """`scores` of counted terms (doc_id, term, tf), none of them twice, by a written table of `gains_by_term`; tf_idf: with a column ``idf``, other terms are dropped.

    hot: the part of that table that is broadcast. A document's terms add up where they are counted, except those that are not in it: only these meet
    the part ``cold``. The greatest frequency is not known before the end, so the sums are kept with and without the factor tf.
    """
    idf = F.col("idf") if tf_idf else F.lit(1.0)
    gains = [f"gain_{i}" for i in range(len(labels))]
    scaled = {"length": idf, **{g: idf * F.col(g) for g in gains}}
    sums = [F.max("tf").alias("most"), *[F.sum(F.col("tf") * x).alias(f"tf_{n}") for n, x in scaled.items()]]
    sums += [F.sum(x).alias(f"one_{n}") for n, x in scaled.items()] if tf_idf else []
    if cold.isEmpty():
        found = counts.join(F.broadcast(hot), "term", "inner" if tf_idf else "left").groupBy("doc_id").agg(*sums)
    else:
        met = counts.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "term", "left")
        met = materialize(met.groupBy("doc_id", F.when(F.col("_hot").isNull(), F.col("term")).alias("_far")).agg(*sums), "bayes-sums")
        far = met.where("_far is not null").select("doc_id", F.col("_far").alias("term"), F.col("most").alias("tf"))
        far = far.join(cold, "term", "inner" if tf_idf else "left").groupBy("doc_id").agg(*sums)
        added = [(F.max if c == "most" else F.sum)(c).alias(c) for c in far.columns if c != "doc_id"]
        found = met.where("_far is null").drop("_far").unionByName(far).groupBy("doc_id").agg(*added)
    of = (lambda n: (F.lit(0.5) * F.col(f"one_{n}") + F.lit(0.5) * F.col(f"tf_{n}") / F.col("most"))) if tf_idf else (lambda n: F.col(f"tf_{n}"))
    score = [F.lit(float(row.prior)) + F.coalesce(of("length") * F.lit(float(row.unseen)), F.lit(0.0)) + F.coalesce(of(g), F.lit(0.0)) for row, g in zip(labels, gains, strict=True)]
    names = F.array(*[F.lit(row.label).cast("string") for row in labels])
    rows = docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.posexplode(F.array(*score)).alias("_label", "score"))
    return rows.select("doc_id", F.get(names, F.col("_label")).alias("label"), "score")


def predict(scored: DataFrame, doc: str = "doc_id", key: tuple[str, ...] = ()) -> DataFrame:
    """key..., doc, prediction: the best label, of ties the first in order of names."""
    # Ordering by rounded score keeps ties stable against the order of summation. Of two names of which
    # one begins the other, the shorter is the first: its array ends with the larger number.
    turned = F.concat(F.transform(F.filter(F.split("label", ""), lambda c: c != ""), lambda c: -F.ascii(c)), F.array(F.lit(1)))
    best = F.max_by("label", F.struct(F.round("score", 9), turned))
    return scored.groupBy(*key, doc).agg(best.alias("prediction"))
