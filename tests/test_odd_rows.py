"""Weights of odd rows are those of SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.oracle import differences, tables
from tidemark.functions import text as X
from tidemark.operators import splitting
from tidemark.plans import registry

#: A capital I with a dot, and a Kelvin sign, whose small letters are ASCII.
DOTTED = "\u0130stanbul \u0130 D\u0130 \u212aelvin ab x"
CASES = {
    "dotted": [(1, DOTTED, "en"), (2, "x x istanbul", "tr"), (3, "\u0130", "tr"), (4, "i\u0307x i\u0307y", "tr")],
    "without id": [(None, "x x y", "en"), (None, "z z z y", "en"), (2, "x z", "de"), (3, "q q r", "fr")],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("name", ["sql_tf_idf", "tfidf_augmented"])
def test_weights_of_odd_rows_are_those_of_sql(spark, tmp_path, name, case):
    spark.createDataFrame(CASES[case], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/out")
    (file,) = (tmp_path / "out").glob("*.parquet")
    (tmp_path / "sf").mkdir()
    file.rename(tmp_path / "sf" / "documents.parquet")
    sf = f"{tmp_path}/sf"
    assert differences(registry.QUERIES[name](spark, sf), tables(sf), registry.SQL[name]) == ([], [])


def test_all_ways_to_split_agree_on_a_dotted_capital(spark):
    df = spark.createDataFrame([(1, DOTTED)], "doc_id long, text string")
    want = ["istanbul", "i", "di", "kelvin", "ab", "x"]
    assert df.select(X.tokens(F.col("text")).alias("t")).first().t == want
    assert splitting.with_terms(df, ("doc_id",), stop_words=()).first().terms == want
