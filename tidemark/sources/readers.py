"""Sources: text lines, dictionaries, registries, stop words, feed XML, sockets and replayed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import java_trim
from tidemark.storage import file_system

DICTIONARY = T.StructType([T.StructField("term", T.StringType()), T.StructField("term_id", T.IntegerType())])
REGISTRY = T.StructType([T.StructField("url", T.StringType()), T.StructField("category", T.StringType()), T.StructField("last_update", T.LongType())])
ITEM_FIELDS = ("title", "description", "link", "author", "guid", "pubDate", "category")
ITEM = T.StructType([T.StructField(f, T.StringType()) for f in ITEM_FIELDS])
REFINED = T.StructType([T.StructField("ts_ms", T.LongType()), T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])
PREDICTIONS = T.StructType(
    [T.StructField("ts_ms", T.LongType()), T.StructField("position", T.IntegerType()), T.StructField("cumulative_pct", T.DoubleType()), T.StructField("learning_rate", T.DoubleType())]
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of text files."""
    return spark.read.text(path)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """term, term_id of ``term,id`` lines."""
    return spark.read.csv(path, schema=DICTIONARY)


def registry(spark: SparkSession, path: str, reset: bool = False) -> DataFrame:
    """url, category, last_update of space-separated lines; reset starts all watermarks at 0."""
    out = spark.read.csv(path, schema=REGISTRY, sep=" ")
    return out.withColumn("last_update", F.lit(0).cast("long")) if reset else out


def prediction_series(spark: SparkSession, path: str) -> DataFrame:
    """ts_ms, position, cumulative_pct, learning_rate of tab-separated lines."""
    return spark.read.csv(path, schema=PREDICTIONS, sep="\t")


def stop_words(spark: SparkSession, path: str) -> list[str]:
    """The words of a list, one a line; lines that start with # are comments. A list is small by nature."""
    rows = lines(spark, path).where(~F.startswith("value", F.lit("#"))).select(java_trim(F.lower("value")).alias("word")).where("word <> ''").distinct()
    return sorted(r.word for r in rows.collect())


def feed_items(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """The items of feed XML files; a missing element is null. category: given by the caller, as a feed's is."""
    out = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    return out.withColumn("category", F.lit(category)) if category is not None else out


def items_from_xml(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Items of a column that holds one ``<item>`` a row; missing elements are empty."""
    got = F.from_xml(xml, ITEM)
    return df.select("*", *[F.coalesce(got[f], F.lit("")).alias(f) for f in ITEM_FIELDS])


def refined(spark: SparkSession, path: str) -> DataFrame:
    """ts_ms, text, label of refined Parquet files; an explicit schema, so time filters reach the scan."""
    return spark.read.schema(REFINED).parquet(path)


def socket_lines(spark: SparkSession, host: str = "localhost", port: int = 9999) -> DataFrame:
    """value: a stream of lines from a socket (for development: it can't be replayed)."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def file_lines(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """value: a stream of the lines of files that appear in a folder; replayable."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def file_rows(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet rows of files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sliced_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream of what `writers.in_slices` wrote, one slice's files in each micro-batch, in order: each slice has the same number of them."""
    fs, root = file_system(spark, path)
    folders = [x.getPath() for x in fs.listStatus(root) if x.isDirectory()]
    return file_rows(spark, f"{path}/_slice=*", schema, max((len(fs.listStatus(x)) for x in folders), default=1))


def in_memory(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
