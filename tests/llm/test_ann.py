import numpy as np
import pytest
from pyspark.sql import functions as F

from vecatlas.llm import ann


def brute(rows, every, k):
    ids = np.array([r[0] for r in rows])
    data = np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        far = np.sqrt(((data - data[i]) ** 2).sum(axis=1))
        found = [(far[j], int(ids[j])) for j in np.flatnonzero(ids != ids[i])]
        out[int(ids[i])] = sorted(found)[:k]
    return out


def table(spark, data):
    rows = [(i, np.asarray(v, np.float32).tolist()) for i, v in enumerate(data)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def lists(found):
    out = {}
    for r in sorted(found.collect()):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return out


def clustered(n, copies=0.0, dim=24, seed=5):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(20, dim))
    data = centres[pick.integers(0, 20, n)] + 0.1 * pick.normal(size=(n, dim)) * pick.choice([0.3, 1, 3], n)[:, None]
    data[pick.random(n) < copies] = data[0]
    return data


@pytest.mark.parametrize("copies", [0.0, 0.34])
def test_recall_and_exact_scores(spark, copies):
    rows, df = table(spark, clustered(4000, copies))
    want = brute(rows, 50, 10)
    got = lists(ann.nearest(df, 50))
    assert set(got) == set(want)
    found = total = 0
    by_id = {i: np.array(v, np.float64) for i, v in rows}
    for query, best in want.items():
        assert len(got[query]) == 10 and got[query] == sorted(got[query])
        for score, other in got[query]:
            assert score == np.sqrt(((by_id[query] - by_id[other]) ** 2).sum())
        found += len({v for _, v in got[query]} & {v for _, v in best})
        total += len(best)
    assert found / total >= 0.9


def test_recall_without_structure(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    want = brute([tuple(r) for r in df.collect()], 50, 10)
    got = lists(ann.nearest(df, 50))
    hits = [len({v for _, v in got[q]} & {v for _, v in best}) for q, best in want.items()]
    assert np.mean(hits) / 10 >= 0.9


def test_parts_of_a_hot_bucket_give_the_same(spark):
    rows, df = table(spark, clustered(1200, 0.5))
    points = ann.usable(df, "vec_id", "embedding")
    model = ann.fit(points)
    whole = lists(ann.search(points, F.pmod("vec_id", F.lit(100)) == 0, 10, model))
    split = lists(ann.search(points, F.pmod("vec_id", F.lit(100)) == 0, 10, model, block=64))
    assert whole == split and len(whole) == 12


def test_visits_are_ordered_and_hold_the_own_bucket(spark):
    _, df = table(spark, clustered(1000))
    model = ann.fit(ann.usable(df, "vec_id", "embedding"))
    vector = clustered(1000)[7]
    for t, visited in enumerate(model.visits(vector)):
        assert len(set(visited.tolist())) == len(visited)
        assert model.buckets(model.cells(vector[None]))[0, t] in visited


def test_few_candidates_are_searched_exactly(spark):
    pick = np.random.default_rng(2)
    far = 100 * pick.normal(size=(7, 8))
    rows, df = table(spark, np.concatenate([far, 1000 + pick.normal(size=(60, 8))]))
    got, want = lists(ann.nearest(df, 1)), brute(rows, 1, 10)
    assert all(len(got[i]) == 10 for i in want) and all(got[i] == want[i] for i in range(7))
    short, df = table(spark, far)
    assert lists(ann.nearest(df, 1)) == brute(short, 1, 10)


def test_odd_rows(spark):
    odd = [(0, None), (100, [0.0, 0.0]), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (500, []), (None, [1.0, 1.0]),
           (600, [1.0, 2.0, 3.0]), (700, [1.0, 0.0]), (700, [2.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [5.0, 0.0]), (3, [1.0, 0.5])]
    df = spark.createDataFrame([(v, i, 1, 2, 3) for i, v in odd], "embedding array<float>, vec_id long, tab int, grp int, score int")
    assert lists(ann.nearest(df)) == {700: [(0.5, 3), (1.0, 1), (1.0, 2)]}
    assert ann.nearest(df.limit(0)).collect() == []
    assert ann.nearest(df.where("vec_id = 700")).collect() == []
