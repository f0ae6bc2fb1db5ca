"""Measures of predictions: accuracy overall, by batch, running."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequence import running_mean


def judged(predictions: DataFrame, docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """docs with prediction and correct."""
    return docs.join(predictions, doc).withColumn("correct", F.col("prediction") == F.col("label"))


def accuracy(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("n_correct"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def cumulative_accuracy(rows: DataFrame, order: str = "seq", by: tuple[str, ...] = ()) -> DataFrame:
    """rows with cumulative_pct: percent correct up to and with each row."""
    return running_mean(rows, F.col("correct").cast("double") * 100, order, by, "cumulative_pct")


def batch_accuracy(rows: DataFrame, size: int = 50, order: str = "seq") -> DataFrame:
    return accuracy(rows.withColumn("batch", F.floor(F.col(order) / size)), ("batch",))
