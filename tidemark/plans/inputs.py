"""The engine's inputs taken from the tables at hand, as DataFrames and as SQL.

``documents`` serve as items: label is the language, event time spreads the ids over three
weeks from the start of the observed period. Rows are items with two terms or more,
numbered in order of doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import START_MS, STOP_WORDS
from tidemark.functions.numeric import utc_clock
from tidemark.operators.dictionary import counted_terms
from tidemark.operators.sequence import LEAST, MOST, in_ranges, rows_before
from tidemark.operators.splitting import with_terms
from tidemark.storage import shared_table

LANGS = ("de", "en", "es", "fr")
SPAN_MS = 21 * 86_400_000
#: Texts of a range in which items are numbered, in one task.
RANGE_TEXTS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ts_ms, label, text."""
    rows = table(spark, sf_dir, "documents")
    n = max(rows.count(), 1)  # from Parquet footers
    ts = F.lit(START_MS) + F.floor(F.col("doc_id") * F.lit(SPAN_MS) / F.lit(n))
    return rows.select("doc_id", ts.cast("long").alias("ts_ms"), F.col("lang").alias("label"), "text")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, ts_ms, label, terms (array) of the items with two terms or more.

    Texts are read, shuffled to the ranges of their ids and split once: the table is written, and all queries of the application share it.
    """

    source = f"{sf_dir}/documents.parquet"

    def make() -> DataFrame:
        texts = docs(spark, sf_dir)
        ranges = min(max(texts.count() // RANGE_TEXTS, LEAST), MOST)
        return with_terms(in_ranges(texts, "doc_id", texts.select("doc_id"), ranges), ("doc_id", "ts_ms", "label", "_range"), least=2, within="_range")

    rows = shared_table(spark, "items-ranged", source, make)
    before = shared_table(spark, "items-before", source, lambda: rows_before(rows))
    return rows.join(F.broadcast(before), "_range").select("doc_id", (F.col("_at") + F.col("_before")).alias("seq"), "ts_ms", "label", "terms")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, ts_ms, label of the items."""
    return items(spark, sf_dir).select("doc_id", "seq", "ts_ms", "label")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, ts_ms, label, pos, term: a row for each term of an item."""
    return items(spark, sf_dir).select("doc_id", "seq", "ts_ms", "label", F.posexplode("terms").alias("pos", "term"))


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, ts_ms, label, term, tf: a row for each distinct term of an item."""
    return counted_terms(items(spark, sf_dir), ("doc_id", "seq", "ts_ms", "label"))


def refined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, value: items as ``(ts,text,label)``."""
    text = F.regexp_replace("text", r"[,()\r\n]", " ")
    return docs(spark, sf_dir).select("doc_id", F.concat(F.lit("("), F.col("ts_ms").cast("string"), F.lit(","), text, F.lit(","), "label", F.lit(")")).alias("value"))


def archive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, value: items as ``weekday, date, title, description, category``; descriptions keep their commas."""
    date = F.date_format(utc_clock(F.col("ts_ms")), "dd MMM yyyy HH:mm:ss")
    body = F.regexp_replace("text", r"[\r\n]", " ")
    line = F.concat(F.lit("Mon, "), date, F.lit(" GMT, title "), F.col("doc_id").cast("string"), F.lit(", "), body, F.lit(", "), "label")
    return docs(spark, sf_dir).select("doc_id", line.alias("value"))


def quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


DOCS = f"docs AS (SELECT doc_id, {START_MS} + (doc_id * {SPAN_MS}) // (SELECT count(*) FROM documents) AS ts_ms, lang AS label, text FROM documents)"
RAW = f"{DOCS}, raw AS (SELECT *, string_split_regex(regexp_replace(lower(text), '[^0-9a-z]', ' ', 'g'), '\\s+') AS pieces FROM docs)"
TERMS = f"""{RAW}, worded AS (SELECT *, list_filter(pieces, lambda t: t <> '') AS words FROM raw),
termed AS (SELECT *, list_filter(words, lambda t: NOT list_contains({quoted(STOP_WORDS)}, t)) AS terms FROM worded)"""
ROWS = f"""{TERMS}, numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS seq, ts_ms, label, terms FROM termed WHERE len(terms) >= 2),
tok AS (SELECT doc_id, seq, ts_ms, label, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM numbered)"""
LINES = f"{DOCS}, lines AS (SELECT doc_id, '(' || ts_ms || ',' || regexp_replace(text, '[,()\\r\\n]', ' ', 'g') || ',' || label || ')' AS value FROM docs)"
ARCHIVE = f"""{DOCS}, lines AS (SELECT doc_id, 'Mon, ' || strftime(epoch_ms(ts_ms), '%d %b %Y %H:%M:%S') || ' GMT, title ' || doc_id || ', '
 || regexp_replace(text, '[\\r\\n]', ' ', 'g') || ', ' || label AS value FROM docs)"""


def bayes_sql(train: str, test: str, rows: str = "numbered", tok: str = "tok", add: float = 1.0, vocabulary: bool = True, prior: str | None = "documents", seen_only: bool = False, prefix: str = "m") -> str:
    """CTEs <prefix>_count, _label, _score, _pred of a model fitted where ``train`` and applied where ``test``."""
    p = prefix
    base = f"(t + (SELECT count(DISTINCT term) FROM {tok}) * {add})" if vocabulary else f"(t + {add})"
    pri = {"documents": f"ln(n + {add}) - ln((SELECT sum(n) FROM {p}_n) + (SELECT count(*) FROM {p}_n) * {add})", "words": f"ln(t / (SELECT sum(t) FROM {p}_t))", None: "0.0"}[prior]
    join = "JOIN" if seen_only else "LEFT JOIN"
    return f"""{p}_count AS (SELECT label, term, count(*)::DOUBLE AS c FROM {tok} WHERE {train} GROUP BY 1, 2),
{p}_n AS (SELECT label, count(*)::DOUBLE AS n FROM {rows} WHERE {train} GROUP BY 1),
{p}_t AS (SELECT n.label, n, coalesce(sum(c), 0) AS t FROM {p}_n n LEFT JOIN {p}_count c ON n.label = c.label GROUP BY 1, 2),
{p}_label AS (SELECT label, n, t, {pri} AS prior, ln{base} AS log_base FROM {p}_t),
{p}_sum AS (SELECT x.doc_id, l.label, sum(ln(coalesce(c.c, 0) + {add}) - l.log_base) AS s
  FROM (SELECT doc_id, term FROM {tok} WHERE {test}) x CROSS JOIN {p}_label l {join} {p}_count c ON c.label = l.label AND c.term = x.term GROUP BY 1, 2),
{p}_score AS (SELECT d.doc_id, l.label, l.prior + coalesce(s.s, 0) AS score FROM (SELECT doc_id FROM {rows} WHERE {test}) d CROSS JOIN {p}_label l
  LEFT JOIN {p}_sum s ON s.doc_id = d.doc_id AND s.label = l.label),
{p}_pred AS (SELECT doc_id, label AS prediction FROM {p}_score QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, label) = 1)"""
