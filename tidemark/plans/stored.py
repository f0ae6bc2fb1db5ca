"""Registered queries over stored layouts, sketches, irregular windows and order-dependent counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import A_DAY_MS, START_MS
from tidemark.operators import dictionary, intervals
from tidemark.plans import inputs as I
from tidemark.plans.catalog import DAY4
from tidemark.plans.registry import query
from tidemark.sources import layout
from tidemark.storage import materialize

ERROR = 0.03


def _items(spark, sf):
    return layout.by_day(I.docs(spark, sf).select("doc_id", "ts_ms", "label"))


@query(f"WITH {I.DOCS} SELECT label, CASE WHEN ts_ms < {DAY4} THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts FROM docs WHERE ts_ms >= {START_MS} AND ts_ms <> {DAY4} GROUP BY 1, 2")
def split_by_stored_days(spark, sf):
    """The training and the test period, each read from the folders of its days."""
    items = _items(spark, sf)
    parts = [layout.between(items, START_MS, DAY4).withColumn("part", F.lit("train")), layout.between(items, DAY4 + 1).withColumn("part", F.lit("test"))]
    return parts[0].unionByName(parts[1]).groupBy("label", "part").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"))


@query(f"""WITH {I.DOCS}, d AS (SELECT *, CAST(epoch_ms(ts_ms) AS DATE) AS day FROM docs), toxic AS (SELECT day FROM d JOIN labels USING (doc_id) GROUP BY 1 HAVING sum(toxic) >= 3)
SELECT label, strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM d WHERE day IN (SELECT day FROM toxic) GROUP BY 1, 2""")
def items_on_toxic_days(spark, sf):
    """Items of the days with three toxic ones or more: which days, and so which folders, is known when the query runs."""
    items = _items(spark, sf)
    labels = layout.by_key(I.table(spark, sf, "labels"))
    days = items.join(labels, "doc_id").groupBy("day").agg(F.sum("toxic").alias("toxic")).where("toxic >= 3")
    days = materialize(days.select("day"), "toxic-days")
    return layout.on_days(items, days).groupBy("label", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query(f"WITH {I.DOCS} SELECT label, quality, toxic, count(*) AS n FROM docs JOIN labels USING (doc_id) GROUP BY 1, 2, 3")
def bucketed_labels(spark, sf):
    """Items and labels in the same buckets of doc_id are joined without a shuffle."""
    return _items(spark, sf).join(layout.by_key(I.table(spark, sf, "labels")).hint("merge"), "doc_id").groupBy("label", "quality", "toxic").agg(F.count("*").alias("n"))


@query(f"WITH {I.ROWS} SELECT (ts_ms - {START_MS}) // {7 * A_DAY_MS} AS week, count(DISTINCT term) AS n_terms, true AS near FROM tok GROUP BY 1")
def sketched_dictionary_size(spark, sf):
    """Distinct terms of each week from the sketches of its days: whether they are within 3 percent of the exact count."""
    tokens = I.tokens(spark, sf)
    week = F.floor(F.col("day") / 7).alias("week")
    about = dictionary.sketched_size(materialize(dictionary.daily_sketches(tokens), "sketches").withColumn("week", week), ("week",)).withColumnRenamed("n_terms", "about")
    exact = tokens.select(F.floor((F.col("ts_ms") - START_MS) / (7 * A_DAY_MS)).alias("week"), "term").distinct().groupBy("week").agg(F.count("*").alias("n_terms"))
    return exact.join(about, "week").select("week", "n_terms", (F.abs(F.col("about") - F.col("n_terms")) <= F.greatest(F.lit(1.0), ERROR * F.col("n_terms"))).alias("near"))


@query(f"""WITH {I.ROWS}, o AS (SELECT seq * 16777216 + pos AS place, seq, term FROM tok), f AS (SELECT *, min(place) OVER (PARTITION BY term) AS first FROM o),
k AS (SELECT seq, arg_min(term, place) AS term FROM f WHERE place > first GROUP BY 1), a AS (SELECT term, count(*) AS more FROM k GROUP BY 1)
SELECT d.term, 1 + coalesce(more, 0) AS df FROM (SELECT DISTINCT term FROM tok) d LEFT JOIN a USING (term)""")
def scanned_doc_freq(spark, sf):
    return dictionary.scanned_frequency(I.tokens(spark, sf))


_WINDOWS = "w AS (SELECT doc_id AS window_id, doc_id - (doc_id * 31) % 400 AS low, doc_id + 1 + (doc_id * doc_id) % (CASE WHEN doc_id % 50 = 0 THEN 5000 ELSE 90 END) AS high FROM labels WHERE quality = 0)"


@query(f"""WITH {I.ROWS}, {_WINDOWS} SELECT window_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, count(DISTINCT label) AS n_labels, sum(len(terms))::BIGINT AS n_terms
FROM w JOIN numbered ON seq >= low AND seq < high GROUP BY 1""")
def irregular_windows(spark, sf):
    """What lies in training windows of unequal length that overlap: one around each document of low quality."""
    windows = I.table(spark, sf, "labels").where("quality = 0").select(
        F.col("doc_id").alias("window_id"),
        (F.col("doc_id") - F.pmod(F.col("doc_id") * 31, F.lit(400))).alias("low"),
        (F.col("doc_id") + 1 + F.pmod(F.col("doc_id") * F.col("doc_id"), F.when(F.col("doc_id") % 50 == 0, 5000).otherwise(90))).alias("high"),
    )
    rows = I.items(spark, sf).select("seq", "label", F.size("terms").alias("size"))
    met = intervals.within(rows, windows, "seq", "low", "high")
    return met.groupBy("window_id").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count_distinct("label").alias("n_labels"), F.sum("size").alias("n_terms")
    )
