import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, wanted=8):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    kept = [(i, v) for i, v in kept if len(v) == d]
    n, sums = len(kept), [sum(v[k] for _, v in kept) for k in range(d)]
    dev = [sum((n * v[k] - sums[k]) ** 2 for k in range(d)) for _, v in kept]
    centred = np.array([[(n * v[k] - sums[k]) / n for k in range(d)] for _, v in kept]).reshape(-1, d)
    values, vectors = np.linalg.eigh(centred.T @ centred / max(n, 1))
    order = [k for k in np.argsort(-values) if values[k] > 1e-9 * max(1e-300, values.max())][:wanted]
    return kept, dev, values[order], vectors[:, order], values.sum(), centred


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("clash")).withColumn("_id", F.lit(0)).repartition(5)


def check(spark, rows, distinct=True):
    got, made = whitening.whiten(frame(spark, rows))
    got = got.collect()
    kept, dev, values, vectors, trace, centred = brute(rows)
    assert made.n == len(kept) and made.identity_error < 1e-6
    assert sorted((r._id is not None, r._id or 0, int(r.deviation)) for r in got) == sorted((i is not None, i or 0, x) for (i, _), x in zip(kept, dev))
    assert len(made.eigenvalues) == len(values) and np.allclose(made.eigenvalues, values, rtol=1e-9)
    if len(values):
        assert math.isclose(made.trace, trace, rel_tol=1e-12)
    if distinct and len(values):
        want = centred @ vectors / np.sqrt(values)
        basis = np.abs(np.sum(made.components.T * vectors, axis=0))
        assert np.all(basis > 1 - 1e-10)
        by = {}
        for (i, _), w in zip(kept, want):
            by.setdefault(i, []).append(np.abs(w))
        for r in got:
            assert min(np.abs(np.abs(r.whitened) - w).max() for w in by[r._id]) < 1e-6
    return made


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(12, 12)) * np.linspace(3, 0.1, 12)
    rows = [(k if k % 40 else None, [float(c) for c in mixing @ rng.normal(size=12)]) for k in range(400)]
    rows += [rows[3], rows[3], (900, None), (901, []), (902, [1.0] * 11), (903, [None, *[1.0] * 11]), (904, [float("nan")] * 12), (905, [float("inf"), *[0.0] * 11])]
    check(spark, rows)


def test_equal_eigenvalues_few_rows_and_no_rows(spark):
    unit = [(k, [float(k % 6 == j) * 100 for j in range(10)]) for k in range(24)]
    assert len(check(spark, unit, distinct=False).eigenvalues) == 5
    assert len(check(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0, 0.0, 1.0])]).eigenvalues) == 1
    assert not len(check(spark, [(1, [1.1, 2.3])] * 7).eigenvalues)
    assert not len(check(spark, [(1, [5.0, 2.3])]).eigenvalues)
    got, made = whitening.whiten(frame(spark, [(1, None), (2, [])]))
    assert got.count() == 0 and made.n == 0
    got, made = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and made.n == 0


def test_large_entries_stay_exact(spark):
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-1e9, 1e9), rng.uniform(-1e8, 1e8), rng.uniform(-1e7, 1e7)]) for k in range(60)]
    check(spark, rows)
    kept, dev, *_ = brute(rows)
    assert max(dev) > 1 << 63


def test_sums_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rows = [(k, [float(k), float(k * k % 17)]) for k in range(200)]
    grid, d = whitening.on_grid(spark.createDataFrame(rows, SCHEMA).repartition(20), "vec_id", "embedding")
    n, sums = whitening.exact_sums(whitening.packed(grid.repartition(20), d).repartition(20), d)
    assert (n, sums) == (200, [sum(math.floor(1024 * v[k]) + 100_000 for _, v in rows) for k in range(2)])


@pytest.mark.parametrize("d", [1, 3, 30])
def test_bidiagonalisation_alone(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(50, d)) * np.geomspace(1, 1e-6, d)
    a -= a.mean(axis=0)
    products = lambda ys, p: (np.vstack([ys, p]) @ a.T @ (a @ p), a.T @ (a @ p))
    values, vectors, steps = whitening.bidiagonalise(products, d, 8, 1e-14)
    want = np.linalg.svd(a)[1]
    assert steps <= d and np.allclose(values, want[: len(values)], rtol=1e-9) and len(values) == min(8, d)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
