"""The training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). All stages
but the last return the columns of ``documents``; further columns, whatever their names, are dropped. An
empty table gives an empty one. Null and empty texts are documents without words, and
texts of any length are processed whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.common import materialize
from tidemark.llm.minhash_dedup import near_duplicates
from tidemark.llm.mixing import mix_sources
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies have a similarity of 0.8 or more; with so many bands of 6 a pair at 0.8 shares none with probability 5e-6.
PERCENT, BANDS = 80, 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine calls toxic go; rows that repeat each by their own text."""
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=tuple(COLUMNS[1:]))
    return scored.where("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Documents without words or without an id stay. Rows that repeat a doc_id go or stay together.
    """
    judged = materialize(near_duplicates(docs, percent=PERCENT, bands=BANDS).where("not kept").select("doc_id").distinct(), "pipeline-copies")
    return queries.without(docs, judged).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeated 50-word windows go; n_chars follows the new text. Null texts and rows without an id stay as they are."""
    # Two batches: with three a task of this stage, after the others, took more memory than the check tool allows.
    cut = substring_dedup(docs, batches=2, fanout=4, keep=("lang", "source", "n_chars"), as_is=True)
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", size.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; rows that repeat an id and a size take the larger number.

    Documents without words are taken by no mix. A null source is a source of its own.
    """
    mixed = mix_sources(docs).where("copies > 0").groupBy(queries.doc_key().alias("doc_key"), "size").agg(F.max("copies").alias("copies"))
    copies = materialize(mixed, "pipeline-copies")
    taken = queries.with_copies(docs, copies)
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of 2048; a text without tokens is its end id alone."""
    return queries.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages learn, hash and draw at random, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
