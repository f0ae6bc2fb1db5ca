"""SQL functions give what their DataFrame twins give; the table function what a plan over slots gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import numeric as N
from tidemark.functions import sql
from tidemark.functions import text as X
from tidemark.operators import bayes, dictionary
from tidemark.plans import registry


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark)
    return spark


def test_scalar_functions_equal_their_twins(session):
    texts = ["hello", "polygenelubricants", "", None, "Ünï cödé  a-b", " \t", "aaaaaaaaaaaaaaaaaaaa"]
    dates = ["Mon, 12 Jan 2015 21:02:57 GMT", "12 Jan 2015 21:02:57 GMT", "soon", None, "Mon, 12 Jan 2015 21:02:57 GMT", "", "Tue, 30 Feb 2015 00:00:00 GMT"]
    rows = [(t, d, k * 7 - 20, k + 1, k + 3, 2 * k + 1) for k, (t, d) in enumerate(zip(texts, dates, strict=True))]
    df = session.createDataFrame(rows, "t string, d string, v long, tf long, most long, df long")
    twins = {
        "words_of(t)": X.tokens(F.col("t")),
        "string_hash(t)": X.java_hash(F.col("t")),
        "half_toward_zero(v)": X.half_toward_zero(F.col("v")),
        "rfc822_ms(d)": N.rfc822_ms(F.col("d")),
        "idf_whole(20000, df)": N.idf_whole(20_000, F.col("df")),
        "idf(20000, df)": N.idf(20_000, F.col("df")),
        "augmented_tf(tf, most)": N.augmented_tf(F.col("tf"), F.col("most")),
        "log_ratio(tf, most, 0.1D)": N.log_ratio(F.col("tf"), F.col("most"), 0.1),
    }
    assert {k.split("(")[0] for k in twins} | {"tf_idf"} == {k.split("(")[0] for k in sql.FUNCTIONS}
    for text, twin in twins.items():
        a, b = (df.select(x.alias("x")).collect() for x in (F.expr(text), twin))
        assert [r.x for r in a] == [pytest.approx(r.x) if isinstance(r.x, float) else r.x for r in b], text


def test_a_query_in_sql_has_the_rows_and_the_kind_of_plan_of_its_twin(session, sf_dir):
    got = registry.QUERIES["sql_tf_idf"](session, sf_dir)
    docs = session.read.parquet(f"{sf_dir}/documents.parquet")
    twin = dictionary.tf_idf(docs.select("doc_id", F.explode(X.tokens(F.col("text"))).alias("term"))).select("doc_id", "term", "tf", "df", F.round("weight", 6).alias("weight"))
    rows = got.select(twin.columns)
    assert rows.count() == twin.count() > 0 and rows.exceptAll(twin).count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "ArrowEval" not in got._jdf.queryExecution().executedPlan().toString()


def test_slots_train_and_predict_as_a_plan_does(session, sf_dir):
    from tidemark.plans import inputs as I
    from tidemark.plans.in_sql import SLOT, TRAINING

    items = I.items(session, sf_dir).withColumn("slot", F.floor(F.col("seq") / SLOT)).withColumn("training", F.col("seq") % SLOT < TRAINING)
    tokens = items.select("slot", "training", "doc_id", "label", F.explode("terms").alias("term"))
    model = bayes.fit(tokens.where("training"), items.where("training"), tokens.select("term").distinct(), config.STREAM_RATIO, key=("slot",))
    asked = items.where("not training").select("slot", "doc_id", "label")
    want = bayes.predict(bayes.scores(model, tokens.where("not training"), asked), key=("slot",)).join(asked, ["slot", "doc_id"])
    got = registry.QUERIES["sql_slot_predictions"](session, sf_dir)
    columns = ["slot", "doc_id", "label", "prediction"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_odd_slots(session):
    rows = [(1, "a", ["x", "y"], True, 0), (2, "b", ["x", None], True, 0), (3, None, ["x"], True, 0), (4, "a", ["y"], False, 0), (5, None, [], False, 0), (6, "a", None, False, 0),
            (7, "a", ["x"], False, 1), (8, "a", ["x"], True, 2)]
    df = session.createDataFrame(rows, "doc_id long, label string, terms array<string>, training boolean, slot long")
    got = session.sql("SELECT doc_id, label, prediction FROM slot_bayes(TABLE({df}) PARTITION BY slot)", df=df).collect()
    assert sorted(map(tuple, got)) == [(4, "a", "a"), (5, None, "a"), (6, "a", "a")]
    assert session.sql("SELECT * FROM slot_bayes(TABLE({df}) PARTITION BY slot)", df=df.limit(0)).count() == 0
