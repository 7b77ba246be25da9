import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecatlas.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def reference(data):
    x = np.floor(1024 * np.asarray(data, np.float32).astype(np.float64)) + 100_000
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    exact = x.astype(np.int64).astype(object)
    deviation = ((len(x) * exact - exact.sum(axis=0)) ** 2).sum(axis=1)
    return centred, values[::-1], vectors[:, ::-1], deviation


def compare(spark, data, solver=True):
    rows = [(i, np.asarray(v, np.float32).tolist()) for i, v in enumerate(data)]
    got = whitening.whitened_rows(spark.createDataFrame(rows, SCHEMA)).toPandas()
    centred, values, vectors, deviation = reference(data)
    made = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    k = made.shape[1]
    want = centred @ vectors[:, :k] / np.sqrt(values[:k])
    if solver:
        assert np.abs(want * np.sign((want * made).sum(axis=0)) - made).max() < 1e-8
    first = got[got.component == 1].sort_values("vec_id")
    assert [int(v) for v in first.deviation] == list(deviation)
    assert np.allclose(got.groupby("component").explained.first(), values[:k] / values.sum(), rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    assert set(got.n) == {len(data)}
    return k


def test_against_a_symmetric_solver(spark):
    pick = np.random.default_rng(1)
    assert compare(spark, pick.normal(size=(600, 20)) * np.geomspace(1, 100, 20)) == 8
    assert compare(spark, pick.normal(size=(300, 5)) + 1000) == 5


def test_large_entries_are_exact(spark):
    pick = np.random.default_rng(3)
    compare(spark, pick.normal(size=(200, 6)) * np.array([1e-1, 1, 1e2, 1e4, 1e5, 1e6]), solver=False)


def test_lower_rank(spark):
    pick = np.random.default_rng(2)
    base = np.round(pick.normal(size=(200, 2)) * 64) / 16
    data = np.concatenate([base, base[:, :1] * 2, np.full((200, 1), 3.0)], axis=1)
    assert compare(spark, data) == 2
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], SCHEMA)
    assert whitening.whitened_rows(same).collect() == []


def test_odd_rows(spark):
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (4, [0.0, 0.0])]
    odd = [(5, None), (6, []), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [1.0, float("-inf")]), (10, [1.0, 2.0, 3.0]), (11, [1e30, 1.0])]
    wide = spark.createDataFrame([(v, 1, i, 0.5, "k") for i, v in good + odd], "embedding array<float>, n int, vec_id long, whitened double, deviation string")
    got = whitening.whitened_rows(wide).collect()
    assert sorted((r["vec_id"] or -1, r["component"]) for r in got) == [(-1, 1), (-1, 2), (1, 1), (1, 1), (1, 2), (1, 2), (4, 1), (4, 2)]
    assert {r["n"] for r in got} == {4}
    known = whitening.usable(wide, "embedding")
    kept, white, deviation = whitening.with_whitened(known, whitening.fit(known, "embedding"), "embedding")
    assert (white, deviation) == ("_whitened", "_deviation") and kept.columns[:5] == wide.columns and kept.count() == 4
    none = whitening.whitened_rows(wide.limit(0))
    assert none.collect() == [] and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(0, 2**32 - 1), st.integers(1, 9))
def test_factorisation(dim, seed, rank):
    pick = np.random.default_rng(seed)
    half = pick.normal(size=(dim, min(rank, dim))) * pick.choice([1e-3, 1, 1e3], min(rank, dim))
    scatter = half @ half.T
    factor = whitening.pivoted_cholesky(scatter)
    assert np.allclose(factor @ factor.T, scatter, atol=1e-10 * np.abs(scatter).max())
    values, vectors = whitening.one_sided_jacobi(factor)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-9) and (np.diff(values) <= 0).all()
    assert np.allclose((vectors.T * values) @ vectors, scatter, atol=1e-9 * np.abs(scatter).max())


@pytest.mark.parametrize("spread", [1, 1 << 20, 1 << 40])
def test_limbs(spread):
    values = np.random.default_rng(0).integers(-spread, spread, 50)
    parts = whitening._limbs(values)
    assert (sum(p.astype(np.int64) << (21 * k) for k, p in enumerate(parts)) == values).all()
    assert all(np.abs(p).max() <= 1 << 20 for p in parts[:2])
