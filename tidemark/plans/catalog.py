"""The registered queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

import math
from pyspark.sql import functions as F

from tidemark import config
from tidemark.config import START_MS, STOP_WORDS
from tidemark.functions import numeric as N
from tidemark.functions import text as X
from tidemark.operators import bayes, dictionary, evaluate, policies, refine, splitting
from tidemark.operators.sequence import number_rows
from tidemark.plans import inputs as I
from tidemark.plans.registry import QUERIES, SQL, query
from tidemark.sources import readers, writers
from tidemark.storage import materialize, new_path
from tidemark.streaming import jobs, state

DAY4 = START_MS + 4 * 86_400_000
#: Policies at the size of the tables at hand.
PERIODIC = config.Periodic(initial=200, first=401, every=200, window=200)
RESETTING = config.Periodic(initial=120, first=201, every=200, window=120, reset=True)
TRIGGERED = config.ErrorTriggered(initial=200, window=200, threshold=0.9, sanity=50)
INCREMENTAL = config.Incremental(initial=200, every=50, low_accuracy=60.0)


# --- text and parsing ---------------------------------------------------------------------------


@query(f"WITH {I.RAW} SELECT doc_id, len(pieces) AS n_pieces, array_to_string(list_filter(pieces, lambda t: t <> ''), ' ') AS tokens FROM raw")
def tokenize(spark, sf):
    return I.docs(spark, sf).select("doc_id", F.size(X.raw_tokens(F.col("text"))).cast("long").alias("n_pieces"), F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


@query(f"WITH {I.TERMS} SELECT doc_id, len(terms) AS n_terms, array_to_string(terms, ' ') AS terms FROM termed")
def stopword_filter(spark, sf):
    t = X.terms(F.col("text"))
    return I.docs(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_terms"), F.array_join(t, " ").alias("terms"))


@query(f"WITH {I.TERMS} SELECT doc_id, label FROM termed WHERE len(terms) >= 2")
def min_terms_filter(spark, sf):
    return refine.enough_terms(I.docs(spark, sf), X.terms(F.col("text")), 2).select("doc_id", "label")


@query(f"WITH {I.TERMS} SELECT doc_id, label FROM termed WHERE len(words) >= 3")
def min_tokens_3(spark, sf):
    return refine.enough_words(I.docs(spark, sf), "text", 3).select("doc_id", "label")


@query(f"""WITH {I.DOCS}, p AS (SELECT doc_id, label, string_split_regex(text, ' |,') AS a FROM docs)
SELECT doc_id, label FROM p WHERE coalesce(list_max(list_transform(a, lambda x, i: CASE WHEN x <> '' THEN i ELSE 0 END)), 0) >= 10""")
def min_tokens_10(spark, sf):
    return refine.enough_pieces(I.docs(spark, sf), "text", 10).select("doc_id", "label")


@query(f"WITH {I.DOCS} SELECT doc_id, ts_ms FROM docs WHERE ts_ms >= {DAY4}")
def ts_filter(spark, sf):
    return refine.since(I.docs(spark, sf), DAY4).select("doc_id", "ts_ms")


@query(f"WITH {I.DOCS} SELECT doc_id, CASE WHEN ts_ms < {DAY4} THEN 'train' WHEN ts_ms > {DAY4} THEN 'test' END AS part FROM docs")
def train_test_split(spark, sf):
    return refine.split_by_days(I.docs(spark, sf)).select("doc_id", "part")


@query(f"WITH {I.DOCS} SELECT doc_id, ts_ms FROM docs WHERE ts_ms BETWEEN {START_MS} AND {DAY4}")
def period_filter(spark, sf):
    return refine.in_period(I.docs(spark, sf), START_MS, DAY4).select("doc_id", "ts_ms")


@query(f"WITH {I.DOCS} SELECT doc_id, ts_ms FROM docs WHERE ts_ms <= {DAY4}")
def period_filter_compat(spark, sf):
    return refine.in_period(I.docs(spark, sf), DAY4, DAY4 + 1, compat=True).select("doc_id", "ts_ms")


_SPLIT = "string_split(trim(lower(regexp_replace(value, '[()]', '', 'g'))), ',')"


@query(f"WITH {I.LINES} SELECT TRY_CAST(p[1] AS BIGINT) AS ts_ms, p[2] AS text, p[3] AS label FROM (SELECT {_SPLIT} AS p FROM lines)")
def parse_refined_line(spark, sf):
    return refine.parse_refined(I.refined_lines(spark, sf))


@query(f"WITH {I.LINES} SELECT TRY_CAST(p[1] AS BIGINT) AS ts_ms, p[3] AS label, p[2] AS text FROM (SELECT string_split(regexp_replace(value, '[()]', '', 'g'), ',') AS p FROM lines)")
def parse_stream_line(spark, sf):
    return refine.parse_stream(I.refined_lines(spark, sf))


@query(f"""WITH {I.LINES} SELECT TRY_CAST(p[1] AS BIGINT) AS ts_ms, regexp_replace(lower(p[2]), '[^\\s0-9A-Za-z]', '', 'g') AS text, replace(p[3], ')', '') AS label
FROM (SELECT string_split(regexp_replace(value, '\\(', ''), ',') AS p FROM lines)""")
def parse_batch_line(spark, sf):
    return refine.parse_batch(I.refined_lines(spark, sf))


@query(f"""WITH {I.ARCHIVE}, s AS (SELECT doc_id, string_split(value, ',') AS p FROM lines)
SELECT doc_id, epoch_ms(strptime(trim(p[2]), '%d %b %Y %H:%M:%S GMT')) AS ts_ms,
  trim(CASE WHEN len(p) > 6 THEN p[4] || ' ' || array_to_string(p[6:len(p) - 1], ' ') ELSE p[4] END) AS text,
  trim(CASE WHEN len(p) > 5 THEN p[len(p)] ELSE p[5] END) AS label FROM s""")
def parse_archive_line(spark, sf):
    lines = I.archive_lines(spark, sf)
    return refine.parse_archive(lines.select("doc_id", "value"), keep=("doc_id",))


@query(f"""WITH {I.RAW}, k AS (SELECT doc_id, label, list_filter(pieces, lambda t: NOT list_contains({I.quoted(STOP_WORDS)}, t))[1:10] AS a FROM raw)
SELECT doc_id, label, array_to_string(a, ' ') AS text FROM k WHERE len(a) >= 4""")
def truncate_terms(spark, sf):
    rows = I.docs(spark, sf).withColumn("a", X.leading_terms(F.col("text")))
    return rows.where(F.size("a") >= 4).select("doc_id", "label", F.array_join("a", " ").alias("text"))


@query("""SELECT DISTINCT event_type AS label, CASE event_type WHEN 'politics' THEN 0.0 WHEN 'sports' THEN 5.0 ELSE -1.0 END::DOUBLE AS label_id FROM events
UNION ALL SELECT t, i::DOUBLE FROM (VALUES ('politics', 0), ('business', 1), ('health', 2), ('technology', 3), ('entertainment', 4), ('sports', 5)) v(t, i)""")
def label_map(spark, sf):
    seen = I.table(spark, sf, "events").select(F.col("event_type").alias("label")).distinct()
    rows = seen.unionAll(spark.createDataFrame([(t,) for t in config.TOPICS], "label string"))
    return rows.select("label", N.label_id(F.col("label")).alias("label_id"))


@query(f"WITH {I.DOCS} SELECT doc_id, {I.quoted(config.TOPICS)}[doc_id % 7 + 1] AS label FROM docs")
def label_names(spark, sf):
    return I.docs(spark, sf).select("doc_id", N.label_name(F.col("doc_id") % 7).alias("label"))


@query(f"WITH {I.DOCS} SELECT text, label FROM docs")
def select_text_label(spark, sf):
    return I.docs(spark, sf).select("text", "label")


@query(f"WITH {I.DOCS} SELECT 1.0::DOUBLE AS weight, doc_id, label FROM docs")
def weight_one(spark, sf):
    return I.docs(spark, sf).select(F.lit(1.0).alias("weight"), "doc_id", "label")


@query("SELECT p_partkey, p_name || ' ' || p_type AS text, p_name || ', ' || p_type || ', ' || p_brand AS line, p_name = trim('  ' || p_name || ' ') AS same FROM part")
def item_format(spark, sf):
    rows = I.table(spark, sf, "part")
    padded = F.concat(F.lit("  "), "p_name", F.lit(" "))
    return rows.select("p_partkey", X.concat_title(F.col("p_name"), F.col("p_type")).alias("text"), X.item_line(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("line"), X.same_item(padded, F.col("p_name")).alias("same"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY word")
def word_count(spark, sf):
    return dictionary.word_count(I.table(spark, sf, "part"), "p_type")


_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(term, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)), lambda a, x: (a * 31 + x) % 4294967296)"
_SIGNED = f"(SELECT term, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS term_hash FROM (SELECT DISTINCT term, {_HASH} AS h FROM (SELECT DISTINCT term FROM tok)))"


@query(f"WITH {I.ROWS} SELECT term, term_hash, CAST(trunc(term_hash / 2.0) AS BIGINT) AS half FROM {_SIGNED}")
def java_hash(spark, sf):
    rows = I.tokens(spark, sf).select("term").distinct().withColumn("term_hash", X.java_hash(F.col("term")))
    return rows.select("term", "term_hash", X.half_toward_zero(F.col("term_hash")).alias("half"))


@query(f"WITH {I.DOCS} SELECT doc_id, ts_ms // 1000 * 1000 AS ts_ms, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE ts_ms // 1000 * 1000 END AS parsed FROM docs")
def rfc822_parse(spark, sf):
    rows = I.docs(spark, sf).select("doc_id", (F.floor(F.col("ts_ms") / 1000) * 1000).alias("ts_ms"))
    date = F.concat(F.date_format(N.utc_clock(F.col("ts_ms")), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return rows.select("doc_id", "ts_ms", N.rfc822_ms(F.when(F.col("doc_id") % 3 == 0, "no date").otherwise(date)).alias("parsed"))


@query("SELECT page_id, coalesce(url, '') AS link, 'page ' || page_id AS title, '' AS author FROM pages")
def xml_items(spark, sf):
    from tidemark.sources.readers import items_from_xml

    link = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit("<item><title>page "), F.col("page_id").cast("string"), F.lit("</title><link>"), F.coalesce(link, F.lit("")), F.lit("</link></item>"))
    return items_from_xml(I.table(spark, sf, "pages").select("page_id", xml.alias("xml"))).select("page_id", "link", "title", "author")


@query(f"SELECT array_to_string(list_sort({I.quoted(STOP_WORDS)}), ',') AS listing, {len(set(STOP_WORDS))}::BIGINT AS n")
def stopword_listing(spark, sf):
    words = F.array(*[F.lit(w) for w in STOP_WORDS])
    return spark.range(1).select(X.sorted_listing(words).alias("listing"), F.size(F.array_distinct(words)).cast("long").alias("n"))


@query(f"""WITH {I.ROWS}, w AS (SELECT unnest({I.quoted(STOP_WORDS)}) AS word)
SELECT 'unused' AS part, count(*) AS n FROM (SELECT word FROM w EXCEPT SELECT unnest(words) FROM termed)
UNION ALL SELECT 'used', count(*) FROM (SELECT word FROM w INTERSECT SELECT unnest(words) FROM termed)
UNION ALL SELECT 'all', count(*) FROM (SELECT word FROM w UNION SELECT unnest(words) FROM termed)""")
def stopword_set_ops(spark, sf):
    words = spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")
    used = I.docs(spark, sf).select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    parts = {"unused": words.join(used, "word", "left_anti"), "used": words.join(used, "word", "left_semi"), "all": words.unionAll(used).distinct()}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, df in parts.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


# --- dictionaries and features ------------------------------------------------------------------

_IDS = "ids AS (SELECT term, row_number() OVER (ORDER BY min(seq * 16777216 + pos)) - 1 AS term_id FROM tok GROUP BY term)"
_TF = "tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2)"
_DF = "df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1)"


def _dictionary_of(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.first_seen_ids(I.tokens(spark, sf))


@query(f"WITH {I.ROWS}, {_IDS} SELECT term, term_id FROM ids")
def dictionary_build(spark, sf):
    return _dictionary_of(spark, sf)


@query(f"WITH {I.ROWS}, {_IDS} SELECT doc_id, pos, term_id FROM tok JOIN ids USING (term)")
def dictionary_lookup(spark, sf):
    ids = materialize(dictionary.counted_ids(I.tokens(spark, sf)), "dictionary-ids")
    return dictionary.join_terms(I.tokens(spark, sf).select("doc_id", "pos", "term"), ids, F.col("n")).select("doc_id", F.col("pos").cast("long").alias("pos"), "term_id")


@query(f"WITH {I.ROWS}, b AS (SELECT DISTINCT unnest(string_split_regex(regexp_replace(lower(text), '[^0-9a-z]', ' ', 'g'), '\\s+')) AS term FROM benchmark) SELECT doc_id, count(*) AS known FROM tok WHERE term IN (SELECT term FROM b) GROUP BY 1")
def known_word_semi(spark, sf):
    known = I.table(spark, sf, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct()
    return I.tokens(spark, sf).join(known, "term", "left_semi").groupBy("doc_id").agg(F.count("*").alias("known"))


@query(f"WITH {I.ROWS}, {_TF} SELECT doc_id, term, tf FROM tf")
def doc_term_freq(spark, sf):
    return dictionary.term_frequency(I.tokens(spark, sf))


@query(f"WITH {I.ROWS} SELECT doc_id, term, round(sum(CASE WHEN pos % 2 = 0 THEN 1.0 ELSE 0.9375 END)::DOUBLE, 6) AS tf FROM tok GROUP BY 1, 2")
def weighted_tf(spark, sf):
    rows = I.tokens(spark, sf).withColumn("weight", F.when(F.col("pos") % 2 == 0, 1.0).otherwise(N.decay(F.lit(1.0), 0.0625)))
    return dictionary.weighted_frequency(rows).withColumn("tf", F.round("tf", 6))


@query(f"WITH {I.ROWS}, {_TF} SELECT doc_id, max(tf) AS most, sum(tf)::BIGINT AS length FROM tf GROUP BY 1")
def max_tf(spark, sf):
    return dictionary.term_frequency(I.tokens(spark, sf)).groupBy("doc_id").agg(F.max("tf").alias("most"), F.sum("tf").alias("length"))


@query(f"WITH {I.ROWS}, {_DF} SELECT term, df FROM df")
def doc_freq(spark, sf):
    return dictionary.document_frequency(I.tokens(spark, sf))


@query(f"""WITH {I.ROWS}, d AS (SELECT term, (ts_ms - {START_MS}) // 86400000 AS day, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1, 2)
SELECT term, string_agg(day || ':' || df, ' ' ORDER BY day) AS by_day, sum(df)::BIGINT AS total FROM d GROUP BY 1""")
def df_by_day_map(spark, sf):
    rows = dictionary.frequency_by_day(I.tokens(spark, sf))
    pairs = F.transform(F.map_entries("by_day"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return rows.select("term", F.array_join(pairs, " ").alias("by_day"), "total")


@query(f"""WITH {I.ROWS}, {_TF}, {_DF}, m AS (SELECT doc_id, max(tf) AS most FROM tf GROUP BY 1)
SELECT doc_id, term, tf, df, round((0.5 + 0.5 * tf / most) * ln((20000 // df)::DOUBLE), 6) AS weight FROM tf JOIN m USING (doc_id) JOIN df USING (term)""")
def tfidf_augmented(spark, sf):
    return dictionary.tf_idf(I.tokens(spark, sf)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {I.ROWS}, {_DF} SELECT term, round(ln((SELECT count(*) FROM numbered)::DOUBLE / df), 6) AS idf FROM df")
def idf_plain(spark, sf):
    n = I.numbered(spark, sf).agg(F.count("*").alias("n_docs"))
    rows = dictionary.document_frequency(I.tokens(spark, sf)).crossJoin(F.broadcast(n))
    return rows.select("term", F.round(N.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


_VEC = "{0}, {1}, {2} SELECT doc_id, string_agg(term_id, ' ' ORDER BY term_id) AS indices, string_agg(tf, ' ' ORDER BY {3}) AS vals FROM tf JOIN ids USING (term) GROUP BY 1"


@query("WITH " + _VEC.format(I.ROWS, _IDS, _TF, "term_id"))
def sparse_vectors(spark, sf):
    return _vectors(spark, sf, False)


@query("WITH " + _VEC.format(I.ROWS, _IDS, _TF, "tf"))
def sparse_vectors_compat(spark, sf):
    return _vectors(spark, sf, True)


def _vectors(spark, sf, compat):
    ids = materialize(dictionary.counted_ids(I.tokens(spark, sf)), "dictionary-ids")
    rows = dictionary.sparse_vectors(I.term_counts(spark, sf).select("doc_id", "term", "tf"), ids, compat=compat)
    return rows.select("doc_id", F.array_join(F.transform("indices", lambda x: x.cast("string")), " ").alias("indices"), F.array_join(F.transform("values", lambda x: x.cast("long").cast("string")), " ").alias("vals"))


@query(f"WITH {I.ROWS}, h AS {_SIGNED} SELECT doc_id, ((term_hash % 1000) + 1000) % 1000 AS bucket, count(*) AS tf FROM tok JOIN h USING (term) GROUP BY 1, 2")
def hashed_vectors(spark, sf):
    return dictionary.hashed_vectors(I.tokens(spark, sf))


@query(f"WITH {I.ROWS} SELECT doc_id, label, string_agg(term, ' ' ORDER BY term) AS terms, count(DISTINCT term) AS n_distinct FROM tok GROUP BY 1, 2")
def term_list_per_doc(spark, sf):
    t = X.terms(F.col("text"))
    rows = refine.enough_terms(I.docs(spark, sf), t, 2)
    return rows.select("doc_id", "label", F.array_join(F.array_sort(t), " ").alias("terms"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"""WITH {I.ROWS}, {_IDS}, {_DF}, w AS (SELECT term, ln((SELECT count(*) FROM numbered)::DOUBLE / df) AS idf FROM df)
SELECT doc_id, string_agg(term_id, ' ' ORDER BY term_id) AS indices, round(sum(idf), 4) AS total FROM (SELECT DISTINCT doc_id, term FROM tok) JOIN w USING (term) JOIN ids USING (term) GROUP BY 1""")
def idf_vectors(spark, sf):
    rows = dictionary.idf_vectors(I.tokens(spark, sf), _dictionary_of(spark, sf))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", F.array_join(F.transform("indices", lambda x: x.cast("string")), " ").alias("indices"), F.round(total, 4).alias("total"))


@query(f"WITH {I.ROWS} SELECT count(DISTINCT term) AS n_terms, count(*) AS n_tokens FROM tok")
def dictionary_size(spark, sf):
    counts = I.tokens(spark, sf).groupBy("term").agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("n_terms"), F.sum("n").alias("n_tokens"))


@query("SELECT p_size, array_to_string(range(0, p_size), ' ') AS idx, p_size::BIGINT AS n_zeros FROM (SELECT DISTINCT p_size::BIGINT AS p_size FROM part)")
def index_vectors(spark, sf):
    rows = I.table(spark, sf, "part").select(F.col("p_size").cast("long").alias("p_size")).distinct()
    zeros = dictionary.zero_vector(F.col("p_size").cast("int"))
    return rows.select("p_size", F.array_join(F.transform(dictionary.index_vector(F.col("p_size")), lambda x: x.cast("string")), " ").alias("idx"), F.size(F.filter(zeros, lambda x: x == 0)).cast("long").alias("n_zeros"))


# --- refining -----------------------------------------------------------------------------------


@query(f"WITH {I.DOCS} SELECT DISTINCT label, text FROM docs")
def dedup_distinct(spark, sf):
    return I.docs(spark, sf).select("label", "text").distinct()


@query("SELECT event_type AS text, arg_max(event_id, ((epoch_us(ts) // 1000), event_id)) AS event_id, max((epoch_us(ts) // 1000)) AS ts_ms FROM events GROUP BY 1")
def dedup_keep_last(spark, sf):
    rows = I.table(spark, sf, "events").select(N.epoch_ms(F.col("ts")).alias("ts_ms"), F.col("event_type").alias("text"), "event_id")
    return refine.last_by_text(rows).select("text", "event_id", "ts_ms")


@query(f"WITH {I.DOCS} SELECT doc_id, ts_ms, row_number() OVER (ORDER BY ts_ms, doc_id) - 1 AS seq FROM docs")
def sort_by_time(spark, sf):
    return number_rows(I.docs(spark, sf).select("doc_id", "ts_ms"), "ts_ms", ("doc_id",))


@query(f"""WITH {I.ROWS} (SELECT 'first' AS which, doc_id, ts_ms FROM numbered ORDER BY seq LIMIT 1) UNION ALL (SELECT 'last', doc_id, ts_ms FROM numbered ORDER BY seq DESC LIMIT 1)""")
def first_last_row(spark, sf):
    rows = I.numbered(spark, sf).select("doc_id", "ts_ms")
    ends = [rows.orderBy(order).limit(1).select(F.lit(which).alias("which"), "doc_id", "ts_ms") for which, order in (("first", F.col("doc_id")), ("last", F.desc("doc_id")))]
    return ends[0].unionAll(ends[1])


@query(f"WITH {I.ROWS} SELECT doc_id, seq FROM numbered WHERE seq < 300")
def prefix_slice(spark, sf):
    """The first 300 rows, which is what this operator selects."""
    return I.numbered(spark, sf).where("seq < 300").select("doc_id", "seq")


_FEED = "SELECT event_id, user_id::VARCHAR AS url, (epoch_us(ts) // 1000) AS ts_ms FROM events"


def _feeds(spark, sf):
    items = I.table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("url"), N.epoch_ms(F.col("ts")).alias("ts_ms"))
    registry = items.groupBy("url").agg(F.min("ts_ms").alias("last_update"))
    return items, registry


@query(f"WITH f AS ({_FEED}), r AS (SELECT url, min(ts_ms) AS last_update FROM f GROUP BY 1) SELECT event_id, url, ts_ms FROM f JOIN r USING (url) WHERE ts_ms > last_update")
def feed_watermark_filter(spark, sf):
    items, registry = _feeds(spark, sf)
    return refine.newer_than_watermark(items, registry).select("event_id", "url", "ts_ms")


@query(f"WITH f AS ({_FEED}), r AS (SELECT url, min(ts_ms) AS last_update FROM f GROUP BY 1) SELECT url, greatest(last_update, coalesce((SELECT max(ts_ms) FROM f WHERE f.url = r.url ), last_update)) AS last_update FROM r")
def feed_watermark_advance(spark, sf):
    items, registry = _feeds(spark, sf)
    return refine.advance_watermarks(registry, items)


@query(f"WITH f AS ({_FEED}) SELECT url, 0::BIGINT AS last_update, count(*) AS n_newer FROM f WHERE ts_ms > 0 GROUP BY 1")
def feed_registry_reset(spark, sf):
    """After a reset every item is newer than its feed's watermark."""
    items, registry = _feeds(spark, sf)
    reset = registry.withColumn("last_update", F.lit(0).cast("long"))
    return refine.newer_than_watermark(items, reset).groupBy("url").agg(F.first("last_update").alias("last_update"), F.count("*").alias("n_newer"))


@query(f"WITH {I.DOCS} SELECT doc_id, coalesce((ts_ms - lag(ts_ms) OVER (ORDER BY ts_ms, doc_id)) // 50000, 10) AS delay_ms FROM docs")
def replay_delay(spark, sf):
    return refine.replay_delays(I.docs(spark, sf).select("doc_id", "ts_ms")).select("doc_id", "delay_ms")


@query("SELECT event_id, ((epoch_us(ts) // 1000) // 50000) % 3456 < 1728 AS training FROM events")
def phase_gate(spark, sf):
    return I.table(spark, sf, "events").select("event_id", N.phase_divided(N.epoch_ms(F.col("ts")), 3456, 1728).alias("training"))


@query("SELECT event_id, ((epoch_us(ts) // 1000) * 50000) % 34560000 <= 17280000 AS training FROM events")
def phase_gate_mult(spark, sf):
    return I.table(spark, sf, "events").select("event_id", N.phase_multiplied(N.epoch_ms(F.col("ts")), 34_560_000, 17_280_000).alias("training"))


@query(f"WITH {I.DOCS} SELECT doc_id, (ts_ms - {START_MS}) // 86400000 AS day FROM docs")
def day_batch_number(spark, sf):
    return I.docs(spark, sf).select("doc_id", N.day_number(F.col("ts_ms")).alias("day"))


# --- naive Bayes --------------------------------------------------------------------------------

_TRAIN, _TEST = f"ts_ms < {DAY4}", f"ts_ms > {DAY4}"
_OFFLINE = f"WITH {I.ROWS}, {I.bayes_sql(_TRAIN, _TEST)}"


def _offline(spark, sf, smoothing=config.MULTINOMIAL):
    rows = refine.split_by_days(I.numbered(spark, sf)).select("doc_id", "ts_ms", "label", "part")
    tokens = refine.split_by_days(I.tokens(spark, sf)).select("doc_id", "label", "term", "part")
    vocabulary = tokens.select("term").distinct()
    model = bayes.fit(tokens.where("part = 'train'"), rows.where("part = 'train'"), vocabulary, smoothing)
    return model, tokens.where("part = 'test'"), rows.where("part = 'test'")


@query(f"{_OFFLINE} SELECT count(*) AS n, count(*) FILTER (WHERE prediction = label) AS n_correct, count(*) FILTER (WHERE prediction = label) / count(*)::DOUBLE AS accuracy FROM m_pred JOIN numbered USING (doc_id)")
def offline_nb_accuracy(spark, sf):
    model, tokens, rows = _offline(spark, sf)
    return evaluate.accuracy(evaluate.judged(bayes.predict(bayes.scores(model, tokens, rows)), rows))


@query(f"{_OFFLINE} SELECT doc_id, label, prediction, prediction = label AS correct FROM m_pred JOIN numbered USING (doc_id)")
def offline_nb_predictions(spark, sf):
    model, tokens, rows = _offline(spark, sf)
    return evaluate.judged(bayes.predict(bayes.scores(model, tokens, rows)), rows).select("doc_id", "label", "prediction", "correct")


@query(f"{_OFFLINE} SELECT label, n AS n_docs, t AS n_terms, round(prior, 6) AS prior FROM m_label")
def nb_priors(spark, sf):
    return _offline(spark, sf)[0].labels.select("label", F.col("n").alias("n_docs"), F.col("total").alias("n_terms"), F.round("prior", 6).alias("prior"))


@query(f"{_OFFLINE} SELECT label, term, c AS n, round(ln(c + 1) - log_base, 6) AS log_theta FROM m_count JOIN m_label USING (label)")
def nb_conditionals(spark, sf):
    return _offline(spark, sf)[0].conditionals.select("label", "term", F.col("count").alias("n"), F.round("log_theta", 6).alias("log_theta"))


@query(f"{_OFFLINE} SELECT doc_id, label, round(score, 4) AS score FROM m_score")
def nb_scores(spark, sf):
    model, tokens, rows = _offline(spark, sf)
    return bayes.scores(model, tokens, rows).select("doc_id", "label", F.round("score", 4).alias("score"))


@query(f"WITH {I.ROWS} SELECT label, term, count(*) AS n FROM tok GROUP BY 1, 2")
def label_term_counts(spark, sf):
    return I.tokens(spark, sf).groupBy("label", "term").agg(F.count("*").alias("n"))


@query(f"WITH {I.ROWS} SELECT label, count(*) AS n FROM tok GROUP BY 1")
def label_sums(spark, sf):
    return I.tokens(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {I.ROWS} SELECT count(*) AS n FROM tok")
def grand_total(spark, sf):
    return I.tokens(spark, sf).agg(F.count("*").alias("n"))


@query(f"WITH {I.ROWS} SELECT label, term, count(*) AS n, grouping(label, term)::BIGINT AS level FROM tok GROUP BY GROUPING SETS ((label, term), (label), ())")
def grouping_sets_counts(spark, sf):
    counts = I.tokens(spark, sf).groupBy("label", "term").agg(F.count("*").alias("c"))
    # Sums of counts: the three levels expand aggregated rows, not tokens.
    return counts.groupingSets([["label", "term"], ["label"], []], "label", "term").agg(F.sum("c").alias("n"), F.grouping_id().alias("level"))


@query(f"WITH {I.ROWS} SELECT label AS own, candidate, count(*) AS n FROM tok CROSS JOIN (SELECT unnest({I.quoted(I.LANGS)}) AS candidate) GROUP BY 1, 2")
def candidate_cross(spark, sf):
    counts = I.tokens(spark, sf).groupBy(F.col("label").alias("own")).agg(F.count("*").alias("n"))
    return counts.select("own", F.explode(F.array(*[F.lit(x) for x in I.LANGS])).alias("candidate"), "n")


def _variant(name: str, smoothing: config.Smoothing):
    sql = f"WITH {I.ROWS}, {I.bayes_sql(_TRAIN, _TEST, add=smoothing.add, vocabulary=smoothing.vocabulary, prior=smoothing.prior, seen_only=smoothing.seen_only)}"

    @query(f"{sql} SELECT doc_id, label, round(score, 4) AS score FROM m_score", f"{name}_scores")
    def scored(spark, sf):
        model, tokens, rows = _offline(spark, sf, smoothing)
        return bayes.scores(model, tokens, rows).select("doc_id", "label", F.round("score", 4).alias("score"))

    @query(f"{sql} SELECT doc_id, prediction FROM m_pred", f"{name}_predictions")
    def predicted(spark, sf):
        model, tokens, rows = _offline(spark, sf, smoothing)
        return bayes.predict(bayes.scores(model, tokens, rows))


_variant("stream_nb", config.STREAM_RATIO)
_variant("stream_nb_seen_only", config.STREAM_RATIO_SEEN)

_SHORT = f"""WITH {I.RAW}, cut AS (SELECT doc_id, label, list_filter(pieces, lambda t: NOT list_contains({I.quoted(STOP_WORDS)}, t))[1:10] AS terms FROM raw),
numbered AS (SELECT doc_id, label, terms, row_number() OVER (ORDER BY doc_id) - 1 AS seq FROM cut WHERE len(terms) >= 4),
tok AS (SELECT doc_id, seq, label, unnest(terms) AS term FROM numbered)"""


@query(f"{_SHORT}, {I.bayes_sql('seq < 300', 'seq > 300', vocabulary=False, prior='words')} SELECT doc_id, label, prediction FROM m_pred JOIN numbered USING (doc_id)")
def sequential_nb(spark, sf):
    cut = splitting.with_leading_terms(I.docs(spark, sf), ("doc_id", "label")).where(F.size("terms") >= 4)
    rows = materialize(number_rows(cut, "doc_id"), "leading-terms")
    tokens = rows.select("doc_id", "label", "seq", F.explode("terms").alias("term"))
    model = bayes.fit(tokens.where("seq < 300"), rows.where("seq < 300"), 0, config.WORD_RATIO)
    test = rows.where("seq > 300")
    return evaluate.judged(bayes.predict(bayes.scores(model, tokens.where("seq > 300"), test)), test).select("doc_id", "label", "prediction")


_PERIOD = f"ts_ms BETWEEN {DAY4} AND {DAY4 + 8 * 86_400_000}"


@query(f"""WITH {I.ROWS}, late AS (SELECT doc_id FROM numbered WHERE ts_ms > {DAY4 + 8 * 86_400_000} ORDER BY doc_id LIMIT 300),
{I.bayes_sql(_PERIOD, 'doc_id IN (SELECT doc_id FROM late)')} SELECT doc_id, label, prediction FROM m_pred JOIN numbered USING (doc_id)""")
def batch_period_nb(spark, sf):
    """Trained on one period; tested on the first 300 rows of the next, which is what this prototype does."""
    rows = I.numbered(spark, sf)
    train = refine.in_period(rows, DAY4, DAY4 + 8 * 86_400_000)
    test = rows.where(F.col("ts_ms") > DAY4 + 8 * 86_400_000).orderBy("doc_id").limit(300)
    tokens = I.tokens(spark, sf)
    model = bayes.fit(refine.in_period(tokens, DAY4, DAY4 + 8 * 86_400_000), train, tokens.select("term").distinct())
    scored = bayes.scores(model, tokens.join(F.broadcast(test.select("doc_id")), "doc_id", "left_semi"), test)
    return evaluate.judged(bayes.predict(scored), test).select("doc_id", "label", "prediction")


_CHAT = f"""WITH c AS (SELECT conv_id * 1000 + turn AS doc_id, conv_id, role AS label, text FROM conversations),
numbered AS (SELECT doc_id, conv_id, label, list_filter(list_transform(string_split(lower(text), ' '), lambda w: regexp_replace(w, '[^0-9A-Za-z]', '', 'g')), lambda t: t <> '') AS terms FROM c),
tok AS (SELECT doc_id, conv_id, label, unnest(terms) AS term FROM numbered)"""


@query(f"{_CHAT}, {I.bayes_sql('conv_id % 5 <> 0', 'conv_id % 5 = 0')} SELECT doc_id, label, prediction FROM m_pred JOIN numbered USING (doc_id)")
def toy_bow_nb(spark, sf):
    """Bag of words over roles: punctuation is removed inside words, every fifth conversation is tested."""
    rows = I.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "conv_id", F.col("role").alias("label"), "text")
    terms = F.filter(F.transform(F.split(F.lower("text"), " "), X.alnum_only), lambda t: t != "")
    tokens = rows.select("doc_id", "conv_id", "label", F.explode(terms).alias("term"))
    test = rows.where("conv_id % 5 = 0")
    model = bayes.fit(tokens.where("conv_id % 5 <> 0"), rows.where("conv_id % 5 <> 0"), tokens.select("term").distinct())
    return evaluate.judged(bayes.predict(bayes.scores(model, tokens.where("conv_id % 5 = 0"), test)), test).select("doc_id", "label", "prediction")


_ASKED = """first_words AS (SELECT term FROM tok WHERE doc_id = (SELECT min(doc_id) FROM numbered)),
asked_rows AS (SELECT doc_id, label FROM numbered UNION ALL SELECT -1, NULL), asked_tok AS (SELECT doc_id, label, term FROM tok UNION ALL SELECT -1, NULL, term FROM first_words)"""


@query(f"WITH {I.ROWS}, {_ASKED}, {I.bayes_sql('doc_id >= 0', 'doc_id = -1', 'asked_rows', 'asked_tok')} SELECT label, round(score, 6) AS score FROM m_score")
def single_document(spark, sf):
    """One document, here the words of the first, scored by a model of all."""
    tokens, rows = I.tokens(spark, sf), I.numbered(spark, sf)
    model = bayes.fit(tokens, rows, tokens.select("term").distinct())
    first = rows.agg(F.min("doc_id").alias("doc_id"))
    asked = tokens.join(F.broadcast(first), "doc_id", "left_semi").select(F.lit(-1).cast("long").alias("doc_id"), "term")
    return bayes.scores(model, asked, spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"))).select("label", F.round("score", 6).alias("score"))


@query(f"""WITH {I.ROWS}, last AS (SELECT (count(*) - 1) // 50 * 50 AS fresh FROM numbered),
w AS (SELECT label, term, CASE WHEN seq < fresh THEN 0.9375 ELSE 1.0 END AS weight FROM tok CROSS JOIN last)
SELECT label, term, round(sum(weight)::DOUBLE, 6) AS weight FROM w GROUP BY 1, 2""")
def union_decayed(spark, sf):
    """Decayed past and fresh rows in one set, as an incremental refit takes them: the last batch is fresh, all before it past."""
    rows = I.tokens(spark, sf)
    fresh_from = (max(I.numbered(spark, sf).count(), 1) - 1) // 50 * 50
    past = rows.where(F.col("seq") < fresh_from).select("label", "term", N.decay(F.lit(1.0), 0.0625).alias("weight"))
    fresh = rows.where(F.col("seq") >= fresh_from).select("label", "term", F.lit(1.0).alias("weight"))
    return past.unionByName(fresh).groupBy("label", "term").agg(F.round(F.sum("weight"), 6).alias("weight"))


# --- policies -----------------------------------------------------------------------------------


def _periodic_sql(p: config.Periodic = PERIODIC) -> str:
    epoch = f"CASE WHEN seq < {p.first} THEN 0 ELSE 1 + (seq - {p.first}) // {p.every} END"
    return f"""WITH {I.ROWS}, win AS (SELECT 0::BIGINT AS epoch, 0::BIGINT AS low, {p.initial}::BIGINT AS high
  UNION ALL SELECT 1 + i, {p.first} + i * {p.every} - {p.window}, {p.first} + i * {p.every} FROM range(0, 100000) r(i) WHERE {p.first} + i * {p.every} < (SELECT count(*) FROM numbered)),
e AS (SELECT doc_id, seq, label, terms, {epoch} AS epoch FROM numbered WHERE seq >= {p.initial}),
tr AS (SELECT epoch, seq, label, terms FROM numbered JOIN win ON seq >= low AND seq < high),
n AS (SELECT epoch, label, count(*)::DOUBLE AS n FROM tr GROUP BY 1, 2),
c AS (SELECT epoch, label, term, count(*)::DOUBLE AS c FROM (SELECT epoch, label, unnest(terms) AS term FROM tr) GROUP BY 1, 2, 3),
l AS (SELECT n.epoch, n.label, ln(n + 1) - ln(sum(n) OVER (PARTITION BY n.epoch) + count(*) OVER (PARTITION BY n.epoch)) AS prior,
  ln(coalesce(t, 0) + (SELECT count(DISTINCT term) FROM tok)) AS base FROM n LEFT JOIN (SELECT epoch, label, sum(c) AS t FROM c GROUP BY 1, 2) t ON t.epoch = n.epoch AND t.label = n.label),
s AS (SELECT e.doc_id, l.label, any_value(prior) + sum(ln(coalesce(c.c, 0) + 1) - base) AS score FROM (SELECT doc_id, epoch, unnest(terms) AS term FROM e) e
  JOIN l ON l.epoch = e.epoch LEFT JOIN c ON c.epoch = l.epoch AND c.label = l.label AND c.term = e.term GROUP BY 1, 2),
pred AS (SELECT doc_id, label AS prediction FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, label) = 1),
j AS (SELECT e.doc_id, e.seq, e.epoch, e.label, prediction, (prediction = e.label)::INT AS ok FROM e JOIN pred USING (doc_id))"""


def _periodic(spark, sf, policy=PERIODIC):
    items = I.items(spark, sf)
    return policies.windowed_predictions(items, splitting.distinct_terms(items).count(), policy)


@query(f"{_periodic_sql()} SELECT doc_id, seq, epoch, prediction FROM j")
def bruteforce_epochs(spark, sf):
    return _periodic(spark, sf).select("doc_id", "seq", "epoch", "prediction")


@query(f"{_periodic_sql()} SELECT count(*) AS n, sum(ok)::BIGINT AS n_correct, avg(ok)::DOUBLE AS accuracy FROM j")
def bruteforce_accuracy(spark, sf):
    return policies.measured(_periodic(spark, sf), PERIODIC)


@query(f"{_periodic_sql(RESETTING)} SELECT epoch, count(*) AS n, sum(ok)::BIGINT AS n_correct, avg(ok)::DOUBLE AS accuracy FROM j GROUP BY 1")
def bruteforce_reset_accuracy(spark, sf):
    """The variant that retrains from the first period on, and counts anew after each retraining."""
    return policies.measured(_periodic(spark, sf, RESETTING), RESETTING)


@query(f"{_periodic_sql()} SELECT seq, round(avg(ok * 100.0) OVER (ORDER BY seq), 6)::DOUBLE AS cumulative_pct FROM j")
def cumulative_accuracy(spark, sf):
    return evaluate.cumulative_accuracy(_periodic(spark, sf)).select("seq", F.round("cumulative_pct", 6).alias("cumulative_pct"))


@query(f"{_periodic_sql()} SELECT seq, epoch, round(avg(ok * 100.0) OVER (PARTITION BY epoch ORDER BY seq), 6)::DOUBLE AS cumulative_pct FROM j")
def epoch_running_accuracy(spark, sf):
    return evaluate.cumulative_accuracy(_periodic(spark, sf), by=("epoch",)).select("seq", "epoch", F.round("cumulative_pct", 6).alias("cumulative_pct"))


@query(f"{_periodic_sql()} SELECT seq // 50 AS batch, count(*) AS n, sum(ok)::BIGINT AS n_correct, avg(ok)::DOUBLE AS accuracy FROM j GROUP BY 1")
def batch50_accuracy(spark, sf):
    return evaluate.batch_accuracy(_periodic(spark, sf))


@query(f"WITH s AS (SELECT i, tan(pi() / 32) - 0.01 * i AS x FROM range(0, 9) r(i)) SELECT i::BIGINT AS step, round(abs(atan(x)) / (pi() / 2), 9) AS rate FROM s")
def learning_rate_trace(spark, sf):
    index = F.lit(math.tan(math.pi / 32)) - F.lit(0.01) * F.col("id")
    return spark.range(9).select(F.col("id").alias("step"), F.round(N.learning_rate(index), 9).alias("rate"))


@query(f"""WITH {I.ROWS}, b AS (SELECT label, seq // 50 AS batch, count(*) AS n FROM tok GROUP BY 1, 2), last AS (SELECT max(batch) AS last FROM b)
SELECT label, round(sum(n * power(0.9375, last - batch)), 6)::DOUBLE AS weight FROM b CROSS JOIN last GROUP BY 1""")
def decay_weights(spark, sf):
    counts = I.tokens(spark, sf).groupBy("label", F.floor(F.col("seq") / 50).alias("batch")).agg(F.count("*").alias("n"))
    last = counts.agg(F.max("batch").alias("last"))
    return counts.crossJoin(F.broadcast(last)).groupBy("label").agg(F.round(F.sum(F.col("n") * F.pow(F.lit(0.9375), F.col("last") - F.col("batch"))), 6).alias("weight"))


_RATES = policies.rate_states(INCREMENTAL)


@query(f"""WITH {I.ROWS}, u AS (SELECT seq, (seq - {INCREMENTAL.initial}) // {INCREMENTAL.every} AS update FROM numbered WHERE seq >= {INCREMENTAL.initial})
SELECT seq, update, round({_RATES}[CASE WHEN update < {len(_RATES) - 2} THEN update ELSE {len(_RATES) - 2} + (update - {len(_RATES) - 2}) % 2 END + 1], 9)::DOUBLE AS rate FROM u""")
def batch_rates(spark, sf):
    """Each row with the learning rate of its batch, were there no reset."""
    rows = I.numbered(spark, sf)
    updates = max(rows.count() - INCREMENTAL.initial, 0) // INCREMENTAL.every + 1
    return policies.with_rate(rows, policies.rate_series(updates, INCREMENTAL, spark), INCREMENTAL).select("seq", "update", F.round("rate", 9).alias("rate"))


@query()
def incremental_nb(spark, sf):
    """Its learning rate depends on its own accuracy, which SQL can't express; tests hold it against a plain loop."""
    tokens = I.tokens(spark, sf)
    ids = materialize(dictionary.counted_ids(tokens), "dictionary-ids")
    return policies.incremental_predictions(tokens, I.numbered(spark, sf), ids, list(I.LANGS), INCREMENTAL)


@query()
def error_triggered_nb(spark, sf):
    """Its retrainings depend on its own accuracy; tests hold it against a plain loop."""
    tokens = I.tokens(spark, sf)
    ids = materialize(dictionary.counted_ids(tokens), "dictionary-ids")
    return policies.error_triggered_predictions(tokens, I.numbered(spark, sf), ids, list(I.LANGS), TRIGGERED)


# --- streams ------------------------------------------------------------------------------------


def _stream(spark, sf, name="documents"):
    """A table's file as a stream, with the columns of `inputs.docs`."""
    still = I.docs(spark, sf)
    path = f"{sf}/{name}.parquet"
    # As a pattern, the path may name one file or a folder of files.
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/{name}.parque[t]")
    n = max(I.table(spark, sf, name).count(), 1)
    ts = F.lit(START_MS) + F.floor(F.col("doc_id") * F.lit(I.SPAN_MS) / F.lit(n))
    return rows.select("doc_id", ts.cast("long").alias("ts_ms"), F.col("lang").alias("label"), "text").select(still.columns)


def _drained(spark, stream, mode, each=None):
    """All that a query writes until its source is drained, as a table; a replayed batch overwrites its own rows."""
    out = new_path(spark, "stream-out")

    def put(df, number):
        (each(df) if each else df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    jobs.run_to_end(stream, new_path(spark, "stream-checkpoint"), put, mode)
    return spark.read.parquet(out)


def _by_time(spark, sf, slices=6):
    """The documents as a stream of one micro-batch for each slice of time, with their time as a timestamp; its session keeps state in RocksDB."""
    folder = new_path(spark, "slices")
    rows = I.docs(spark, sf)
    writers.in_slices(rows, folder, F.floor((F.col("ts_ms") - START_MS) * slices / I.SPAN_MS))
    return readers.sliced_rows(state.session(spark), folder, rows.schema).withColumn("time", F.timestamp_millis("ts_ms"))


@query(f"WITH {I.TERMS}, w AS (SELECT label, unnest(words) AS term FROM termed) SELECT label, term, count(*) AS n FROM w GROUP BY 1, 2")
def stream_label_term_counts(spark, sf):
    """Counts by day are state for as long as the watermark lets the day change; each micro-batch writes what changed."""
    daily = jobs.latest(_drained(spark, jobs.label_term_counts(_by_time(spark, sf), window="1 day"), "update"), ("label", "term", "start"))
    return daily.groupBy("label", "term").agg(F.sum("n").alias("n"))


@query(f"WITH {I.TERMS}, w AS (SELECT doc_id, (ts_ms - {START_MS}) // 86400000 AS day, unnest(words) AS term FROM termed) SELECT term, day, count(DISTINCT doc_id) AS df FROM w GROUP BY 1, 2")
def stream_dictionary(spark, sf):
    """Document frequencies by term and day: a day is state until the watermark has passed it."""
    return jobs.latest(_drained(spark, jobs.term_days(_by_time(spark, sf), START_MS), "update"), ("term", "day")).select("term", "day", "df")


@query(f"""WITH {I.TERMS}, w AS (SELECT label, ts_ms, unnest(words) AS term FROM termed WHERE (ts_ms // 50000) % 3456 < 1728)
SELECT label, term, count(*) AS n, min(ts_ms) AS first_ts FROM w GROUP BY 1, 2""")
def stream_first_seen_counts(spark, sf):
    """Counts and first times of each cycle are state until the watermark has passed the cycle."""
    cycles = jobs.latest(_drained(spark, jobs.first_seen_counts(_by_time(spark, sf), 3456, 1728, window="172800 seconds"), "update"), ("label", "term", "start"))
    return cycles.groupBy("label", "term").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"))


@query(f"WITH {I.TERMS}, w AS (SELECT ts_ms, label, unnest(words) AS term FROM termed) SELECT ts_ms, label, term, count(*) AS tf FROM w GROUP BY 1, 2, 3")
def stream_term_frequencies(spark, sf):
    return _drained(spark, _stream(spark, sf), "append", jobs.term_frequencies).select("ts_ms", "label", "term", "tf")


@query(f"""WITH {I.ROWS}, dfs AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok WHERE {_TRAIN} GROUP BY 1),
tfs AS (SELECT doc_id, ts_ms, label, term, df, count(*) AS tf FROM tok JOIN dfs USING (term) GROUP BY ALL),
wt AS (SELECT doc_id, ts_ms, label, term, (0.5 + 0.5 * tf / max(tf) OVER (PARTITION BY doc_id)) * ln((20000 // df)::DOUBLE) AS w FROM tfs),
c AS (SELECT label, term, sum(w) AS c FROM wt WHERE {_TRAIN} GROUP BY 1, 2), l AS (SELECT label, ln(sum(c) + 0.1) AS base FROM c GROUP BY 1),
s AS (SELECT doc_id, l.label, sum(w * (ln(coalesce(c.c, 0) + 0.1) - base)) AS score FROM wt CROSS JOIN l LEFT JOIN c ON c.label = l.label AND c.term = wt.term WHERE {_TEST} GROUP BY 1, 2),
p AS (SELECT n.doc_id, n.label, l.label AS prediction FROM numbered n CROSS JOIN l LEFT JOIN s ON s.doc_id = n.doc_id AND s.label = l.label WHERE {_TEST}
  QUALIFY row_number() OVER (PARTITION BY n.doc_id ORDER BY round(coalesce(score, 0), 9) DESC, l.label) = 1)
SELECT doc_id, label, prediction FROM p""")
def stream_tfidf_nb_predictions(spark, sf):
    """Naive Bayes on tf-idf: the dictionary and the model are those of the training period, each micro-batch is weighed and scored by them."""
    train = I.term_counts(spark, sf).where(F.col("ts_ms") < DAY4)
    rows = I.numbered(spark, sf).where(F.col("ts_ms") < DAY4)
    known = materialize(dictionary.document_frequency(train), "tfidf-dictionary")
    weighed = dictionary.weighed(train, known).join(rows.select("doc_id", "label"), "doc_id")
    model = bayes.fit(weighed, rows, known, config.STREAM_RATIO, weight="weight")

    def score(batch):
        usable = refine.enough_terms(batch, X.terms(F.col("text")), 2)
        tokens = materialize(dictionary.weighed(dictionary.counted_terms(usable, ("doc_id",), X.terms(F.col("text"))), known), "tfidf")
        docs = usable.select("doc_id", "label")
        return evaluate.judged(bayes.predict(bayes.scores(model, tokens, docs, weight="weight")), docs)

    return _drained(spark, _stream(spark, sf).where(F.col("ts_ms") > DAY4), "append", score).select("doc_id", "label", "prediction")


@query(f"""WITH {I.ROWS}, h AS {_SIGNED}, hashed AS (SELECT doc_id, ts_ms, label, ((term_hash % 1000) + 1000) % 1000 AS term FROM (SELECT doc_id, seq, label, term FROM tok) JOIN h USING (term) JOIN (SELECT doc_id, ts_ms FROM numbered) USING (doc_id)),
{I.bayes_sql(_TRAIN, _TEST, tok='hashed')} SELECT doc_id, label, prediction FROM m_pred JOIN numbered USING (doc_id)""")
def stream_hashed_nb_predictions(spark, sf):
    """Naive Bayes on terms hashed to 1000 indices: fitted on the training period, each micro-batch is hashed and scored."""
    items = I.items(spark, sf)
    train = dictionary.hashed_counts(items, ("ts_ms", "label")).withColumnRenamed("bucket", "term")
    size = train.select("term").distinct()
    train = train.where(F.col("ts_ms") < DAY4).withColumn("tf", F.col("tf").cast("double"))
    model = bayes.fit(train, items.where(F.col("ts_ms") < DAY4).select("label"), size, weight="tf")

    def score(batch):
        usable = refine.enough_terms(batch, X.terms(F.col("text")), 2)
        tokens = dictionary.hashed_counts(usable.select("doc_id", X.terms(F.col("text")).alias("terms")), ("doc_id",)).withColumnRenamed("bucket", "term")
        docs = usable.select("doc_id", "label")
        tokens = materialize(tokens.withColumn("tf", F.col("tf").cast("double")), "hashed")
        return evaluate.judged(bayes.predict(bayes.scores(model, tokens, docs, weight="tf")), docs)

    return _drained(spark, _stream(spark, sf).where(F.col("ts_ms") > DAY4), "append", score).select("doc_id", "label", "prediction")


@query(f"WITH {I.ROWS}, {I.bayes_sql(_TRAIN, _TEST, add=0.1, vocabulary=False, prior=None)} SELECT doc_id, label, prediction, prediction = label AS correct FROM m_pred JOIN numbered USING (doc_id)")
def stream_accuracy(spark, sf):
    """Each micro-batch is scored by the model of the training period."""
    model = _offline(spark, sf, config.STREAM_RATIO)[0]

    def score(batch):
        usable = refine.enough_terms(batch, X.terms(F.col("text")), 2)
        rows = usable.select("doc_id", "label")
        tokens = dictionary.token_table(usable, ("doc_id",))
        return evaluate.judged(bayes.predict(bayes.scores(model, tokens, rows)), rows).select("doc_id", "label", "prediction", "correct")

    stream = _stream(spark, sf).where(F.col("ts_ms") > DAY4)
    return _drained(spark, stream, "append", score).select("doc_id", "label", "prediction", "correct")


# --- sinks and sources: what is written is read back ------------------------------------------------


_PARSED = f"WITH {I.LINES} SELECT TRY_CAST(p[1] AS BIGINT) AS ts_ms, p[2] AS text, p[3] AS label FROM (SELECT {_SPLIT} AS p FROM lines)"


def _line_items(spark, sf):
    return I.docs(spark, sf).select("ts_ms", F.regexp_replace("text", r"[,()\r\n]", " ").alias("text"), "label")


@query(_PARSED)
def text_save_round_trip(spark, sf):
    path = new_path(spark, "lines")
    writers.refined_text(_line_items(spark, sf), path)
    return refine.parse_refined(readers.lines(spark, path))


@query(_PARSED)
def replayed_stream(spark, sf):
    """Items dropped as files by the paced replayer (here without waiting), read as a stream and parsed."""
    folder = new_path(spark, "replayed")
    writers.replay(_line_items(spark, sf), folder, tick_ms=10_000, wait=lambda seconds: None)
    return _drained(spark, refine.parse_refined(readers.file_lines(spark, folder)), "append").select("ts_ms", "text", "label")


@query(f"WITH {I.ROWS}, {_IDS} SELECT term, term_id FROM ids")
def dictionary_round_trip(spark, sf):
    path = new_path(spark, "dictionary")
    writers.dictionary(_dictionary_of(spark, sf), path)
    return readers.dictionary(spark, path).select("term", F.col("term_id").cast("long").alias("term_id"))


@query("""SELECT user_id::VARCHAR AS url, 'news' AS category, max(epoch_us(ts) // 1000) AS last_update FROM events GROUP BY 1""")
def registry_round_trip(spark, sf):
    """The registry is written, advanced, and put in its own place."""
    path = new_path(spark, "registry")
    items, registry = _feeds(spark, sf)
    writers.registry(registry.withColumn("category", F.lit("news")), path)
    writers.registry(refine.advance_watermarks(readers.registry(spark, path), items), path)
    return readers.registry(spark, path)


@query(f"SELECT unnest({I.quoted(STOP_WORDS)}) AS word")
def stopword_round_trip(spark, sf):
    path = new_path(spark, "stop-words")
    writers.stop_words(spark.createDataFrame([(w,) for w in STOP_WORDS], "word string"), path, "2015-01-15")
    return spark.createDataFrame([(w,) for w in readers.stop_words(spark, path)], "word string")


@query("SELECT 'Mon, 12 Jan 2015 21:02:57 GMT, ' || p_name || ', ' || p_type || ', ' || p_brand AS line, 2::BIGINT AS n FROM part")
def archive_appended_twice(spark, sf):
    path = new_path(spark, "archive")
    items = I.table(spark, sf, "part").select(F.lit("Mon, 12 Jan 2015 21:02:57 GMT").alias("pubDate"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.col("p_brand").alias("category"), "p_partkey")
    for _ in (1, 2):
        writers.append_archive(items, path)
    lines = readers.lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("m"))
    own = items.select(X.item_line(F.col("pubDate"), F.col("title"), F.col("description"), F.col("category")).alias("line"))
    per_line = own.groupBy("line").agg(F.count("*").alias("c"))
    return own.join(lines.join(per_line, "line"), "line").select("line", (F.col("m") / F.col("c")).cast("long").alias("n"))


@query(f"WITH {I.ROWS} SELECT ts_ms, (seq + 1)::INTEGER AS position, round(100.0 * (seq + 1) / (seq + 2), 6)::DOUBLE AS cumulative_pct, 0.0625::DOUBLE AS learning_rate FROM numbered")
def series_round_trip(spark, sf):
    path = new_path(spark, "series")
    seq = F.col("seq")
    rows = I.numbered(spark, sf).select("ts_ms", (seq + 1).alias("position"), F.round(100 * (seq + 1) / (seq + 2), 6).alias("cumulative_pct"), F.lit(0.0625).alias("learning_rate"))
    writers.prediction_series(rows, path)
    return readers.prediction_series(spark, path)


_WORDS = "SELECT {0} AS seq, unnest(a) AS term, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT {0}, list_transform(string_split_regex({1}, '\\s+'), lambda w: regexp_replace(lower(w), '[^0-9A-Za-z]', '', 'g')) AS a FROM {2})"


@query(f"""WITH b AS ({_WORDS.format('item_id', 'text', 'benchmark')}), base AS (SELECT term, row_number() OVER (ORDER BY min(seq * 16777216 + pos)) - 1 AS term_id FROM b WHERE pos >= 7 AND term <> '' GROUP BY 1),
p AS ({_WORDS.format('p_partkey', 'p_name', 'part')}), fresh AS (SELECT term, row_number() OVER (ORDER BY min(seq * 16777216 + pos)) - 1 AS term_id FROM p WHERE term <> '' AND term NOT IN (SELECT term FROM base) GROUP BY 1)
SELECT term, term_id FROM base UNION ALL SELECT term, term_id + (SELECT coalesce(max(term_id), -1) + 1 FROM base) FROM fresh""")
def toy_dictionary(spark, sf):
    """The bag-of-words dictionary: words of lines from the eighth on, grown by the words of further items."""
    lines = dictionary.words_after(I.table(spark, sf, "benchmark"), "item_id", "text")
    more = dictionary.words_after(I.table(spark, sf, "part"), "p_partkey", "p_name", 0)
    base = materialize(dictionary.first_seen_ids(lines, "item_id"), "toy-dictionary")
    return dictionary.grown(base, more, "p_partkey")
