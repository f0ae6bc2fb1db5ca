from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.config import Incremental
from tidemark.functions import numeric as N
from tidemark.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [("hello", 99162322), ("polygenelubricants", -2147483648), ("", 0)])
def test_java_hash(spark, text, want):
    assert value(spark, X.java_hash(F.lit(text))) == want


def test_dates(spark):
    assert value(spark, N.rfc822_ms(F.lit("Mon, 12 Jan 2015 21:02:57 GMT"))) == 1421096577000
    assert value(spark, N.rfc822_ms(F.lit("15 Jan 2015 00:00:00 GMT"))) == 1421280000000
    assert value(spark, N.rfc822_ms(F.lit("no date"))) is None


def test_learning_rate_steps():
    index, rates = N.start_index(), []
    for _ in range(12):
        rates.append(round(N.rate_of(index), 6))
        index = N.next_index(index, Incremental())
    assert rates[:3] == [0.0625, 0.056189, 0.049867]
    assert 0.00096 in rates and rates.count(0.005406) == 2


def test_tangent_identity(spark):
    assert value(spark, F.atan(F.tan(F.lit(math.pi / 4))) / F.lit(math.pi / 2)) == pytest.approx(0.5)


def test_whole_idf(spark):
    assert value(spark, N.idf_whole(20000, F.lit(3))) == pytest.approx(8.804775, abs=1e-6)


def test_day_and_labels(spark):
    assert value(spark, N.day_number(F.lit(1421280000000 + 86_400_000))) == 1
    assert value(spark, N.label_id(F.lit("sports"))) == 5.0
    assert value(spark, N.label_id(F.lit("weather"))) == -1.0
    assert value(spark, N.label_name(F.lit(1))) == "business"
    assert value(spark, N.label_name(F.lit(9))) is None


def test_tokens(spark):
    assert value(spark, X.tokens(F.lit(" -Über the Moon, 2x!"))) == ["ber", "the", "moon", "2x"]
    assert value(spark, X.tokens(F.lit(None).cast("string"))) == []
    assert value(spark, X.terms(F.lit("the moon and a cat"))) == ["moon", "cat"]
    assert value(spark, X.raw_tokens(F.lit("-a b-"))) == ["", "a", "b", ""]
    assert value(spark, X.drop_trailing_empty(F.split(F.lit("a,,b,,"), ","))) == ["a", "", "b"]
    assert value(spark, X.java_trim(F.lit("\t a \x01\n"))) == "a"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=126), max_size=30), min_size=1, max_size=20))
def test_java_hash_is_the_recurrence(spark, texts):
    def plain(t: str) -> int:
        h = 0
        for c in t:
            h = (h * 31 + ord(c)) % (1 << 32)
        return h - (1 << 32) if h >= 1 << 31 else h

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.java_hash(F.col("t")).alias("h")).collect()
    assert all(r.h == plain(r.t) for r in got)


@pytest.mark.parametrize("zone", ["UTC", "Pacific/Chatham"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert value(spark, N.epoch_ms(F.lit("2024-01-15 10:00:00.263999").cast("timestamp_ntz"))) == 1705312800263
        assert value(spark, F.date_format(N.utc_clock(F.lit(1421096577000)), "dd MMM yyyy HH:mm:ss")) == "12 Jan 2015 21:02:57"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
