from __future__ import annotations

from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import curve_search
from tidemark.llm.curve_search import nearest
from tidemark.llm.hilbert import curve_keys
from tidemark.llm import itq_dedup
from tidemark.llm.itq_dedup import Coding, learn_rotations, near_duplicate_vectors, partners, roots_of, substring_bits, unit_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def near_copies(seed: int, n: int = 400, size: int = 24):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.normal(size=(n // 8, size))
    for i in range(n):
        v = rng.normal(size=size) if i % 2 else base[rng.integers(len(base))] + rng.normal(scale=rng.choice([0.0, 0.05, 0.2, 0.3]), size=size)
        rows.append((i, [float(np.float32(x)) for x in v], None if i % 37 == 0 else int(i % 3)))
    return rows


def test_links_and_components_equal_brute_force(spark):
    rows = near_copies(1)
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [float("nan")] + [1.0] * 23, 1), (1004, [None] + [1.0] * 23, 1), (1005, [float("inf")] + [1.0] * 23, 1), (1006, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("class_id", F.lit(1)).withColumn("n", F.lit(2))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df, miss=1e-5).collect()}
    links = []
    for k, (i, a, x) in enumerate(rows):
        for j, b, y in rows[k + 1 :]:
            if x is not None and x == y:
                p, q = np.array(a), np.array(b)
                if p @ q >= 0.93 * np.sqrt((p @ p) * (q @ q)):
                    links.append((i, j))
    root = brute.groups([i for i, *_ in rows] + [i for i, *_ in odd], links)
    want = {i: (sum(i in e for e in links), r, r == i) for i, r in root.items()}
    assert links and got == want


def test_crowded_bucket_is_cut_into_blocks(spark):
    """More equal codes than a block holds: all are near copies of one vector."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in base + rng.normal(scale=0.002, size=16)], 0) for i in range(1300)]
    got = near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).agg(F.min("n_links"), F.max("n_links"), F.count_distinct("component_id")).first()
    assert tuple(got) == (1299, 1299, 1)


def test_links_at_the_threshold_are_found_with_the_query_s_settings(spark):
    """Pairs planted at a cosine of 0.930 to 0.945 among 64-dimensional vectors of three labels: at least 99 of 100 link."""
    rng = np.random.default_rng(12)
    rows, planted = [], []
    for k in range(1500):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        rows.append((2 * k, a.tolist(), k % 3))
        b = rng.normal(size=64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        if k % 2:
            c = rng.uniform(0.93001, 0.945)
            b = c * a + np.sqrt(1 - c * c) * b
            planted.append(2 * k)
        rows.append((2 * k + 1, b.tolist(), k % 3))
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(got.values()) == sum(got[i] + got[i + 1] for i in planted)
    assert sum(got[i] == got[i + 1] == 1 for i in planted) >= 0.99 * len(planted)


def test_one_id_for_two_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 1), (5, [1.0, 0.02], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (5, 2, 1, False)]


def test_roots_of_row_blocks():
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 30):
        near = rng.random((n, n)) < 1.5 / n
        near |= near.T
        want = brute.groups(range(n), [tuple(map(int, e)) for e in np.argwhere(near)])
        assert roots_of([near[:4], near[4:]], n).tolist() == [want[i] for i in range(n)]


def test_vector_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicate_vectors(empty).count() == 0 and nearest(empty).count() == 0
    rows = [(7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [2.0, 0.0], None)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(7, 2, 7, True), (7, 2, 7, True), (None, 0, None, True), (9, 2, 7, False), (10, 0, 10, True)], key=str)


def test_rotations_are_rotations():
    for r in islice(learn_rotations(np.random.default_rng(0).normal(size=(500, 12))), 2):
        assert np.allclose(r.T @ r, np.eye(12))
    for classes in (0, 50_000, 10**11):
        assert classes / 10 / 2 ** substring_bits(classes, 10, 64) <= 4096


def one_label(mean, n=6000, size=64, planted=300, seed=3, cosine=(0.9301, 0.945)):
    """Unit vectors of one label whose mean cosine is ``mean``, and pairs planted at or above the threshold: (vectors, pairs)."""
    rng = np.random.default_rng(seed)
    shared = np.zeros(size)
    shared[0] = 1.0
    own = rng.normal(size=(n, size))
    own[:, 0] = 0
    rows = np.sqrt(mean) * shared + np.sqrt(1 - mean) * unit_rows(own)
    turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
    rows = rows @ turn
    pairs = [(k, n - 1 - k) for k in range(planted)]
    for a, b in pairs:
        c = rng.uniform(*cosine)
        aside = rng.normal(size=size)
        aside -= (aside @ rows[a]) * rows[a]
        rows[b] = c * rows[a] + np.sqrt(1 - c * c) * aside / np.linalg.norm(aside)
    return rows, pairs


@pytest.mark.parametrize("mean", [0.0, 0.5, 0.8])
def test_bits_are_balanced_and_tell_pairs_from_strangers(mean):
    rows, pairs = one_label(mean)
    coding = Coding(rows[:4096], np.zeros(4096, np.int64), 6, 0.93)
    bits = coding.signs(rows, np.zeros(len(rows), np.int64))
    assert np.abs(bits.mean(axis=0) - 0.5).max() < 0.1
    own = bits[:, : coding.bits]
    apart = np.array([(own[a] != own[b]).sum() for a, b in pairs])
    assert (apart <= coding.radius).mean() >= 0.99
    strangers = (own[1000:1200, None] != own[None, 2000:2200]).sum(axis=2)
    assert (strangers <= coding.radius).mean() < (2e-3 if mean > 0.7 else 1e-4)


@pytest.mark.parametrize("mean", [0.5, 0.7, 0.8])
def test_a_label_with_a_common_direction_does_not_become_one_group(spark, mean, monkeypatch):
    rows, pairs = one_label(mean)
    sizes = []
    whole = itq_dedup.connected_components

    def watched(edges, name="components"):
        out = whole(edges, name)
        if name == "itq-groups":
            sizes.append(max([r["count"] for r in out.groupBy("root").count().collect()], default=0))
        return out

    monkeypatch.setattr(itq_dedup, "connected_components", watched)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(df).collect()}
    near = rows @ rows.T >= 0.93 * np.sqrt(np.outer((rows**2).sum(axis=1), (rows**2).sum(axis=1)))
    links = near.sum(axis=1) - 1
    assert sizes[0] < 100
    assert sum(got.values()) >= 0.99 * links.sum() > 0 and all(got[i] <= links[i] for i in got)


def test_partners_lie_at_the_threshold():
    unit = unit_rows(np.random.default_rng(1).normal(size=(50, 9)))
    assert np.allclose((partners(unit, 0.93, np.random.default_rng(2)) * unit).sum(axis=1), 0.93)


@pytest.mark.parametrize(("axes", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curves_are_continuous(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = curve_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 16)).astype(np.float32).astype(np.float64)
    vectors[1500:1560] = vectors[0]  # one vector that many share
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(90_000, None, 0), (90_100, [0.0] * 16, 0), (90_200, [1.0], 0)]
    got = nearest(spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit(1)).withColumn("curve", F.lit(1))).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(by) == list(range(0, 3000, 100))
    hits = 0
    for q, found in by.items():
        found.sort()
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        assert [k for k, *_ in found] == list(range(1, 11))
        assert [s for *_, s in found] == [d[v] for _, v, _ in found] == sorted(s for *_, s in found)
        hits += len({v for _, v, _ in found} & set(best.tolist()))
    assert hits / (10 * len(by)) >= 0.9
    assert [v for _, v, _ in sorted(by[0])] == list(range(1500, 1510))
    few = nearest(spark.createDataFrame(rows[:4], SCHEMA)).collect()
    assert [(r["rank"]) for r in few] == [1, 2, 3]


def test_windows_are_small_where_vectors_have_structure(spark):
    """Vectors of a curved surface: the measured reach is a few ranges of rows, and finds their neighbours."""
    rng = np.random.default_rng(4)
    at = rng.random((6000, 2))
    turn = np.linalg.qr(rng.normal(size=(32, 32)))[0][:, :5]
    vectors = np.stack([np.cos(3 * at[:, 0]), np.sin(3 * at[:, 0]), at[:, 1], at[:, 0] * at[:, 1], at[:, 1] ** 2], axis=1) @ turn.T
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    fitted = curve_search.Curves(vectors[:4096], 8)
    edges = [curve_search._cuts(x, 94) for x in fitted.keys(vectors).T]
    used, reach = curve_search.measured_reach(df.withColumnRenamed("embedding", "vector"), fitted, edges, vectors[:128], 10)
    assert used * (2 * reach + 1) <= 0.4 * 94
    hits = 0
    got = nearest(df, range_rows=64).collect()
    for q in range(0, 6000, 100):
        d = np.linalg.norm(vectors - vectors[q], axis=1)
        d[q] = np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 600


def test_a_vector_that_asks_repeatedly_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 3.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (100, [1.0, 1.0]), (None, [1.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 100, 5**0.5), (0, 2, 1, 10**0.5), (100, 1, 0, 1.0), (100, 2, 1, 1.0)]
