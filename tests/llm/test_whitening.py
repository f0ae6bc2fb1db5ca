from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, whitening
from tidemark.llm.whitening import lobpcg, whitened

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, components=4):
    """{(vec_id, component): (n, deviation, whitened up to its sign, explained)} by a full eigendecomposition and Python's whole numbers."""
    xs = [(i, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)) for i, v in rows]
    fit = sorted({x for _, x in xs})
    n, size = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(size)]
    centred = np.array([[(n * x[d] - sums[d]) / n for d in range(size)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, x in xs:
        exact = sum((n * x[d] - sums[d]) ** 2 for d in range(size))
        c = np.array([(n * x[d] - sums[d]) / n for d in range(size)])
        for k in range(min(components, size)):
            out[i, k + 1] = (n, exact, c @ vectors[:, -1 - k] / np.sqrt(values[-1 - k]), values[-1 - k] / values.sum())
    return out


def check(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want)
    sign = {}
    for r in got:
        n, exact, w, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, exact)
        assert r.explained == pytest.approx(share, rel=1e-9) and r.identity_error < 1e-9
        assert abs(r.whitened) == pytest.approx(abs(w), rel=1e-7, abs=1e-8)
        if abs(w) > 1e-6:
            sign.setdefault(r.component, set()).add(bool(r.whitened * w > 0))
    assert all(len(s) == 1 for s in sign.values())


def vectors(seed, n=300, size=24):
    rng = np.random.default_rng(seed)
    scale = rng.uniform(0.1, 2, size)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=size) * scale + 0.7]) for i in range(n)]


def test_rows_equal_a_full_decomposition(spark):
    rows = vectors(1) + [(500, vectors(1)[3][1]), (501, vectors(1)[3][1]), (502, [0.0] * 24), (7, vectors(2)[0][1])]
    rows = [r for k, r in enumerate(rows) if r[0] != 7 or k > 300]
    odd = [(900, None), (901, [None] + [1.0] * 23), (902, [float("nan")] * 24), (903, [float("-inf")] * 24), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], SCHEMA).withColumn("x", F.lit(1)).withColumn("n", F.lit(2)).withColumn("w", F.lit("z"))
    check(whitened(df).collect(), brute(rows))
    check(whitened(df.repartition(6)).collect(), brute(rows))


def test_the_query_on_the_given_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(queries.op12_whitening(spark, sf_dir).collect(), brute(rows))


def test_few_or_equal_vectors(spark):
    def run(rows):
        return whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()

    assert run([]) == [] and run([(1, [1.0, 2.0])]) == [] and run([(1, [1.0, 2.0])] * 5) == []
    check(run([(1, [1.0, 2.0]), (2, [3.0, 5.0])]), {k: v for k, v in brute([(1, [1.0, 2.0]), (2, [3.0, 5.0])], 1).items()})
    same = run([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0])])
    assert len(same) == 8 and all(r.explained == pytest.approx(0.5) and r.identity_error < 1e-9 for r in same)


def test_a_deviation_beyond_a_long_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e14, 0.0], 0), (2, [-1e14, 0.0], 0), (3, [0.0, 1.0], 0)], SCHEMA.replace("float", "double"))
    with pytest.raises(Exception, match="NUMERIC|CAST|OVERFLOW|overflow"):
        whitened(df).collect()


@pytest.mark.parametrize("gap", [1.0, 1e-3, 0.0])
def test_iteration_certifies_close_eigenvalues(gap):
    rng = np.random.default_rng(4)
    size = 120
    q = np.linalg.qr(rng.normal(size=(size, size)))[0]
    values = np.concatenate([10 + gap * np.arange(5, 0, -1), rng.uniform(0, 9.5, size - 5)])
    a = (q * values) @ q.T
    found, x, residuals, steps = lobpcg(lambda b: a @ b, size, 4)
    assert found == pytest.approx(values[:4], rel=1e-12) and residuals.max() < 1e-11 * 15 and steps < whitening.ITERATIONS
    assert np.allclose(x.T @ x, np.eye(4), atol=1e-12)
    if gap:
        assert np.abs((x * q[:, :4]).sum(axis=0)) == pytest.approx(np.ones(4), abs=1e-9)


def test_the_covariance_is_never_built(monkeypatch):
    """Products are of the size of the block, not of the dimension."""
    seen = []

    def product(b):
        seen.append(b.shape[1])
        return np.arange(500, 0, -1)[:, None] * b

    values, *_ = lobpcg(product, 500, 4)
    assert values == pytest.approx([500, 499, 498, 497]) and max(seen) <= 3 * 16
