from __future__ import annotations

import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import queries
from tidemark.llm.quality import CUT, LAGS, SIZE, best_cut, features, fit_weights, loss, pairs, quality

DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def sentence(rng, n):
    return " ".join(rng.choice(["the", "river", "runs", "by", "green", "hills", "and", "old", "stones", "where", "birds", "sing"]) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = sentence(rng, rng.randint(8, 200))
        if not good:
            text = [text.upper().replace(" ", "!! "), " ".join(w + "$$$" for w in text.split()), " ".join(w for w in text.split()[:20] for _ in range(12))][i // 4 % 3]
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    return docs, labels


def test_features_equal_a_plain_count():
    texts = ["Ab cd, cd x9!\nxy cd\n", "", None, "aaa aaa aaa", "ü", " \n ", "w " * 500, "x" * 21 + " y"]
    got = features(pa.array(texts))
    assert got.shape == (len(texts), SIZE)
    for row, text in zip(got, texts, strict=True):
        data, words = (text or "").encode(), brute.words(text)

        def kind(b):
            c = chr(b)
            return 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if c.isdigit() and b < 128 else 3 if c in " \t" else 4 if c in "\n\r" else 5 if c in ".," else 7 if b > 127 else 6

        want = np.zeros(64)
        for a, b in zip(data, data[1:], strict=False):
            want[kind(a) * 8 + kind(b)] += 1
        assert np.allclose(row[:64], np.sqrt(want / max(len(data) - 1, 1)))
        for k, lag in enumerate(LAGS):
            again = sum(a == b for a, b in zip(words, words[lag:], strict=False))
            assert row[64 + k] == pytest.approx((again / max(len(words), 1)) ** 0.5)
        assert row[72] == pytest.approx(np.mean([len(w.encode()) for w in words]) if words else 0)
        assert row[73] == pytest.approx((sum(len(w.encode()) > 20 for w in words) / max(len(words), 1)) ** 0.5)


def test_features_of_a_text_do_not_depend_on_its_chunk():
    texts = ["A b b a.", "b a", "", "zz zz! A b"]
    together = features(pa.array(texts))
    assert np.array_equal(together, np.concatenate([features(pa.array([t])) for t in texts]))


def test_weights_are_where_the_loss_has_no_slope():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) + [0.4, 0, -0.2, 0, 1]
    w = fit_weights(x, 1e-2)
    for k in range(5):
        step = np.zeros(5)
        step[k] = 1e-5
        assert abs(loss(w + step, x, 1e-2) - loss(w - step, x, 1e-2)) / 2e-5 < 1e-6
    assert loss(w, x, 1e-2) < loss(np.zeros(5), x, 1e-2)


def test_pairs_prefer_the_good_and_reach_every_document():
    label = np.array([1, 0, 1, 1, 0, 1])
    winner, loser = pairs(label)
    assert (label[winner] == 1).all() and (label[loser] == 0).all() and set(winner) | set(loser) == set(range(6))
    assert not len(pairs(np.ones(4, int))[0])


def test_cut_errs_least():
    rng = np.random.default_rng(2)
    values = [(int(v), int(rng.random() < 1 / (1 + np.exp(-v / 9)))) for v in rng.normal(scale=20, size=300)]
    bins = {}
    for v, y in values:
        bins[v, y] = bins.get((v, y), 0) + 1

    def errors(cut):
        return sum((v >= cut * 64) != y for v, y in values)

    cut = best_cut([(v, y, n) for (v, y), n in bins.items()])
    assert errors(cut) == min(errors(c / 64) for c in range(-100, 101))
    assert best_cut([(0, 0, 5), (10, 1, 5)]) == pytest.approx(5.5 / 64)


def test_junk_is_told_from_prose_on_the_held_out_fold(spark):
    docs, labels = corpus()
    got = quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    good = {i: q for i, q, _ in labels}
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= CUT) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert len(held) > 60 and sum(r.predicted == good[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_labels_and_other_columns_are_no_inputs(spark):
    docs, labels = corpus(200)
    turned = [(i, 1 - q if crc32(str(i).encode()) % 4 == 2 else q, 1 - t) for i, q, t in labels]
    other = [(i, t, "xx", None, 1) for i, t, *_ in docs]
    a = quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    b = quality(spark.createDataFrame(other, DOCS).repartition(5), spark.createDataFrame(turned, LABELS).repartition(3)).collect()
    for x, y in zip(sorted(map(tuple, a)), sorted(map(tuple, b)), strict=True):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=1e-9) and x[3] == y[3]


def test_the_query_on_the_given_tables(spark, sf_dir):
    got = queries.op13_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got) > 0


def test_odd_rows(spark):
    docs, labels = corpus(80)
    schema = DOCS + ", _text int, label int, f0 int, score int"
    odd = [(1000, None), (1001, ""), (None, "the hills."), (3, "the same id, again."), (3, "the same id, again."), (1002, " \n\t"), (1003, sentence(random.Random(1), 200_000))]
    rows = [(*d, 1, 2, 3, 4) for d in docs] + [(i, t, None, None, None, 1, 2, 3, 4) for i, t in odd]
    more = labels + [(None, 1, 0), (1000, None, None), (5, 7, 0), (3, 0, 0), (3, 1, 1)]
    got = quality(spark.createDataFrame(rows, schema), spark.createDataFrame(more, LABELS).withColumn("doc_key", F.lit(1))).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(r.score is not None and r.held_out is not None for r in got)
    assert len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1
    assert [r for r in got if r.doc_id == 1003][0].predicted == 1
    kept = quality(spark.createDataFrame(rows, schema), spark.createDataFrame(more, LABELS), keep=("lang",)).where("doc_id = 1").first()
    assert kept.lang == "en"


def test_without_labels_nothing_is_rejected(spark):
    docs, labels = corpus(20)
    df = spark.createDataFrame(docs, DOCS)
    for known in ([], [r for r in labels if r[1]]):
        got = quality(df, spark.createDataFrame(known, LABELS)).collect()
        assert len(got) == 20 and all(r.predicted == 1 and r.score >= CUT for r in got)
    assert quality(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0
