import numpy as np
import pytest
from pyspark.sql import functions as F

from vecatlas.operators import quantize
from vecatlas.operators.neighbour_graph import graph_neighbours, neighbour_graph
from vecatlas.operators.topk import Sieve, distances, topk_search, unit_rows
from vecatlas.session import scratch_path

SCHEMA = "slot long, embedding array<float>"


def table(spark, data):
    return spark.createDataFrame([(i, None if v is None else np.asarray(v, np.float32).tolist()) for i, v in enumerate(data)], SCHEMA)


def noise(n, dim=16, seed=1):
    return list(np.random.default_rng(seed).normal(size=(n, dim)))


def asked(df):
    return df.select(F.col("slot").alias("query_id"), "embedding")


def pairs(hits):
    return {(r["query_id"], r["rank"], r["slot"]) for r in hits.collect()}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_reranking_all_candidates_is_exact(spark, metric):
    data = noise(300, 10)
    data[5], data[7], data[9] = None, data[8], np.zeros(10)
    df = table(spark, data)
    books = quantize.train_codebooks(df, metric, parts=4, codes=32)
    codes = books.encode(df)
    assert codes.count() == 299 and {len(r["codes"]) for r in codes.collect()} == {4}
    want = pairs(topk_search(df, asked(df), 7, metric))
    assert pairs(quantize.pq_search(books, codes, df, asked(df), 7, refine=300)) == want
    # Query tables beyond one block give the same.
    assert pairs(quantize.pq_search(books, codes, df, asked(df), 7, refine=300, max_queries=100)) == want
    assert quantize.pq_search(books, codes, df, asked(df).limit(0), 7).count() == 0
    assert quantize.pq_search(books, codes, df, asked(df), 0).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_all_candidates_of_many_queries_become_no_rows(spark, metric, monkeypatch):
    data = noise(300, 10)
    data[5], data[7], data[9] = None, data[8], np.zeros(10)
    df = table(spark, data)
    books = quantize.train_codebooks(df, metric, parts=4, codes=32, rounds=2)
    want = pairs(topk_search(df, asked(df), 7, metric))
    staged, write = [], quantize.materialize
    monkeypatch.setattr(quantize, "MAX_REFINE", 50)
    monkeypatch.setattr(quantize, "materialize", lambda rows, tag: staged.append(tag) or write(rows, tag))
    assert pairs(quantize.pq_search(books, books.encode(df), df, asked(df), 7, refine=299)) == want
    assert "candidates" not in staged


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_many_queries_in_one_stream_find_what_few_do(spark, metric, monkeypatch):
    """Blocks of queries are tasks of one plan, whatever their number, and candidates become no rows."""
    data = noise(300, 10)
    data[5], data[7], data[9] = None, data[8], np.zeros(10)
    df = table(spark, data)
    twice = df.unionByName(df.filter("slot in (3, 8)"))
    queries = df.select(F.concat(F.lit("q"), "slot").alias("query_id"), "embedding")
    books = quantize.train_codebooks(df, metric, parts=4, codes=32, rounds=2)
    want = pairs(quantize.pq_search(books, books.encode(twice), twice, queries, 7, refine=30))
    staged, write = [], quantize.materialize
    monkeypatch.setattr(quantize, "_MAX_HELD", 30 * 40)
    monkeypatch.setattr(quantize, "_CODES", 100)
    monkeypatch.setattr(quantize, "materialize", lambda rows, tag: staged.append(tag) or write(rows, tag))
    hits = quantize.pq_search(books, books.encode(twice), twice, queries, 7, refine=30, max_queries=50)
    assert staged == ["queries"]
    got = hits.collect()
    assert {(r["query_id"], r["rank"], r["slot"]) for r in got} == want and len(got) == 299 * 7
    # More candidates than may be rows, and still not all.
    monkeypatch.setattr(quantize, "MAX_REFINE", 20)
    assert pairs(quantize.pq_search(books, books.encode(twice), twice, queries, 7, refine=30)) == want


@pytest.mark.parametrize("keep", [3, 40])
def test_candidates_are_the_nearest_by_look_ups(keep, monkeypatch):
    pick = np.random.default_rng(4)
    centres = [pick.normal(size=(n, 3)) for n in (40, 256, 7)]
    books = quantize.Codebooks("l2", [0, 3, 6, 9], centres)
    queries = pick.normal(size=(70, 9))
    codes = np.stack([pick.integers(0, len(c), 5000) for c in centres], axis=1).astype(np.uint8)
    codes[2500:] = codes[pick.integers(0, 2500, 2500)]  # copies
    slots = pick.permutation(5000)
    far = sum(((queries[:, None, 3 * p : 3 * p + 3] - c[None]) ** 2).sum(axis=2)[:, codes[:, p]] for p, c in enumerate(centres))
    order = np.lexsort((np.broadcast_to(slots, far.shape), far), axis=1)[:, :keep]
    monkeypatch.setattr(quantize, "_CODES", 1500)
    monkeypatch.setattr(quantize, "_TILE", 32)
    found = quantize._Candidates(books, queries, keep)
    for lo in range(0, 5000, 700):
        found.add(codes[lo : lo + 700], slots[lo : lo + 700])
    best = found.found()
    assert (best.slot == slots[order]).all() and (best.distance == np.take_along_axis(far, order, axis=1)).all()


def test_codes_rule_out_no_hit():
    pick = np.random.default_rng(2)
    points, asked = pick.normal(size=(400, 8)), pick.normal(size=(50, 8))
    near = points + 0.1 * pick.normal(size=(400, 8))
    for metric in ("cosine", "l2"):
        p, q = (unit_rows(points), unit_rows(asked)) if metric == "cosine" else (points, asked)
        far = distances(metric, q, p)
        worst = np.sort(far, axis=1)[:, 1]
        left = Sieve(metric, q, p, near).left(np.arange(50), 0, 400, worst)
        assert left is None or set(np.flatnonzero(far <= worst[:, None])) <= set(left)
        far_codes = Sieve(metric, q, p, p * 1.0).left(np.arange(50), 0, 400, worst)
        assert set(np.flatnonzero(far <= worst[:, None])) <= set(far_codes)


def test_recall_at_the_default(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("slot"), "embedding")
    books = quantize.train_codebooks(df)
    want = {(q, s) for q, _, s in pairs(topk_search(df, asked(df), 10))}
    got = {(q, s) for q, _, s in pairs(quantize.pq_search(books, books.encode(df), df, asked(df), 10))}
    assert len(got & want) / len(want) >= 0.95
    graph = {(q, s) for q, _, s in pairs(graph_neighbours(df, 10))}
    assert len(graph & want) / len(want) >= 0.9


def test_codebooks_fall_in_error_and_can_be_kept(spark):
    df = table(spark, noise(800, 9))
    points = np.array(noise(800, 9), np.float32).astype(float)

    def error(books):
        codes = books.codes(points)
        return sum(((points[:, a:b] - c[codes[:, p]]) ** 2).sum() for p, (a, b, c) in enumerate(zip(books.edges, books.edges[1:], books.centres)))

    first, later = (quantize.train_codebooks(df, "l2", parts=4, codes=16, rounds=n) for n in (1, 8))
    assert error(later) < error(first)
    path = scratch_path(spark, "books")
    later.write(spark, path)
    kept = quantize.Codebooks.load(spark, path)
    assert kept.edges == later.edges == [0, 2, 4, 6, 9] and kept.metric == "l2"
    assert all((a == b).all() for a, b in zip(kept.centres, later.centres))
    with pytest.raises(ValueError):
        quantize.train_codebooks(df.limit(0))
    with pytest.raises(ValueError):
        quantize.train_codebooks(df, codes=300)


def test_more_centres_than_vectors_and_narrow_vectors(spark):
    df = table(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])
    books = quantize.train_codebooks(df, "l2")
    hits = quantize.pq_search(books, books.encode(df), df, asked(df), 2, refine=2)
    assert pairs(hits) == {(0, 1, 0), (0, 2, 2), (1, 1, 1), (1, 2, 0), (2, 1, 0), (2, 2, 2)}


def test_graph_of_clusters_with_a_hub_and_copies(spark):
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(6, 12)) * 5
    data = list(centres[pick.integers(0, 6, 900)] + 0.3 * pick.normal(size=(900, 12)))
    for i in range(0, 900, 3):
        data[i] = data[0]
    data[4] = None
    df = table(spark, data)
    want = topk_search(df, asked(df), 5, "l2")
    exact = {(r["query_id"], r["rank"]): r["distance"] for r in want.collect()}
    got = {(r["query_id"], r["rank"]): r["distance"] for r in graph_neighbours(df, 5, "l2").collect()}
    assert set(got) == set(exact)
    assert sum(got[key] <= exact[key] + 1e-6 for key in exact) / len(exact) >= 0.9


def test_graph_of_few_vectors_is_exact(spark):
    df = table(spark, noise(60, 4))
    assert pairs(graph_neighbours(df, 6)) == pairs(topk_search(df, asked(df), 6))
    assert neighbour_graph(df.limit(0)).count() == 0
    assert neighbour_graph(df.limit(1)).count() == 1


def test_vectors_travel_by_edge(spark):
    """What meets has a row per edge and direction at most, never a row per pair."""
    from vecatlas.operators import neighbour_graph as g

    df = table(spark, noise(400, 6))
    edges = neighbour_graph(df, degree=8)
    members = g._meetings(edges.withColumn("fresh", F.lit(True)), 8, 0).count()
    assert members <= 2 * edges.count()
