"""Joins of two streams by key and event time.

Both sides are kept in Spark's symmetric hash join. Watermarks and the time range of the
condition say when a row can meet no other any more: it is then dropped from the state, so the state
holds the rows of about ``within`` and the two delays, however long the streams run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_range(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, how: str = "inner", delays: tuple[str, str] = ("1 hour", "1 hour")) -> DataFrame:
    """Rows of ``left`` with those of ``right`` of the same key whose time is at or after theirs, by ``within`` at most.

    how: inner, or leftOuter: a row of ``left`` that met none comes out with nulls once the watermark has passed its range.
    Both times are timestamps; rows whose key or time is null meet none (and are dropped). Other columns' names must
    differ. A row later than its delay behind its stream's latest is dropped.
    """
    a = left.where(F.col(key).isNotNull() & F.col(left_time).isNotNull()).withWatermark(left_time, delays[0])
    b = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).withColumnRenamed(key, "_key").withWatermark(right_time, delays[1])
    near = F.expr(f"{key} = _key AND {right_time} >= {left_time} AND {right_time} <= {left_time} + INTERVAL {within}")
    return a.join(b, near, how).drop("_key")


def judged_late(predictions: DataFrame, labels: DataFrame, within: str, how: str = "inner", delays: tuple[str, str] = ("1 hour", "1 hour")) -> DataFrame:
    """doc_id, predicted_at, labelled_at, prediction, label, correct: predictions and the labels that come up to ``within`` later.

    predictions: doc_id, prediction, predicted_at; labels: doc_id, label, labelled_at. With leftOuter, a prediction whose
    label did not come in time has nulls.
    """
    met = within_range(predictions, labels, "doc_id", "predicted_at", "labelled_at", within, how, delays)
    return met.select("doc_id", "predicted_at", "labelled_at", "prediction", "label", (F.col("prediction") == F.col("label")).alias("correct"))
