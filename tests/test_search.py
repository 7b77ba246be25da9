import numpy as np
import pytest
from pyspark.sql import functions as F

from vecatlas.operators import cells, topk
from vecatlas.operators.hits import resized, sorted_by, with_paths, with_result_columns, with_row_ids
from vecatlas.plans.search import neighbours, search
from vecatlas.session import scratch_path


def make_vectors(n=300, dim=8, seed=3):
    """Random vectors; a third of them are copies of one vector, and one vector is zero."""
    rng = np.random.default_rng(seed)
    matrix = rng.normal(size=(n, dim)).astype(np.float32)
    matrix[::3] = matrix[0]
    matrix[1] = 0
    return matrix


def brute_force(vectors, queries, k, metric):
    v, q = vectors.astype(np.float64), queries.astype(np.float64)
    if metric == "cosine":
        norm = lambda m: np.where((s := np.linalg.norm(m, axis=1)) > 0, s, 1)[:, None]
        distance = 1 - (q / norm(q)) @ (v / norm(v)).T
        score = 100 * (1 - distance)
    else:
        distance = ((q[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)
        score = 100 * (1 - np.tanh(distance / 3000))
    rows = []
    for i in range(len(q)):
        order = sorted(range(len(v)), key=lambda j: (round(distance[i, j], 8), j))[:k]
        rows += [(i, rank + 1, j, round(score[i, j], 5)) for rank, j in enumerate(order)]
    return rows


def vector_df(spark, matrix, key="slot", parts=5):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} long, embedding array<float>").repartition(parts)


def collected(hits):
    rows = hits.select("query_id", "rank", "slot", F.round("score", 5).alias("score")).collect()
    return sorted((r["query_id"], r["rank"], r["slot"], r["score"] + 0.0) for r in rows)


def same(left, right):
    assert [r[:3] for r in left] == [r[:3] for r in right]
    assert np.allclose([r[3] for r in left], [r[3] for r in right], atol=2e-5)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_topk_equals_brute_force(spark, metric):
    matrix = make_vectors()
    hits = topk.topk_search(vector_df(spark, matrix), vector_df(spark, matrix, "query_id"), 12, metric)
    same(collected(hits), brute_force(matrix, matrix, 12, metric))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_large_query_table_goes_through_cells(spark, metric, monkeypatch):
    # Tiny blocks: the cell of the copies is cut into many blocks on both sides.
    monkeypatch.setattr(cells, "VECTORS_PER_BLOCK", 16)
    monkeypatch.setattr(cells, "QUERIES_PER_BLOCK", 16)
    matrix = make_vectors()
    index = cells.build_cell_index(vector_df(spark, matrix), scratch_path(spark, "cells"), 6, metric)
    hits = cells.bounded_search(index, vector_df(spark, matrix, "query_id"), 12)
    same(collected(hits), brute_force(matrix, matrix, 12, metric))
    loaded = cells.CellIndex.load(spark, index.path)
    monkeypatch.setattr(cells, "MAX_DIRECT_QUERIES", 10)
    full = cells.probed_search(loaded, vector_df(spark, matrix, "query_id"), 12, 6)
    same(collected(full), brute_force(matrix, matrix, 12, metric))


def test_query_bound_switches_to_cells(spark):
    matrix = make_vectors(60)
    hits = topk.topk_search(
        vector_df(spark, matrix), vector_df(spark, matrix, "query_id"), 3, max_broadcast_queries=20
    )
    same(collected(hits), brute_force(matrix, matrix, 3, "cosine"))


def test_more_than_all_vectors(spark):
    matrix = make_vectors(6)
    hits = topk.topk_search(vector_df(spark, matrix), vector_df(spark, matrix, "query_id"), 50)
    assert hits.count() == 36
    assert topk.topk_search(vector_df(spark, matrix), vector_df(spark, matrix, "query_id"), 0).count() == 0


def test_unknown_metric_and_ragged_vectors(spark):
    df = vector_df(spark, make_vectors(6))
    with pytest.raises(ValueError):
        topk.topk_search(df, df.withColumnRenamed("slot", "query_id"), 3, "dot")
    ragged = df.unionByName(spark.createDataFrame([(99, [1.0])], df.schema))
    with pytest.raises(Exception, match="dimension"):
        topk.topk_search(ragged, df.withColumnRenamed("slot", "query_id"), 3).collect()


def test_single_query(spark):
    matrix = make_vectors()
    found = topk.single_query_topk(vector_df(spark, matrix), list(matrix[4]), 5).collect()
    expected = brute_force(matrix, matrix[4:5], 5, "cosine")
    assert [r["slot"] for r in found] == [r[2] for r in expected]


def test_probed_cells_on_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 16))
    matrix = (centers[np.arange(600) % 12] + rng.normal(size=(600, 16)) * 0.05).astype(np.float32)
    index = cells.build_cell_index(vector_df(spark, matrix), scratch_path(spark, "cells"), 12)
    hits = cells.probed_search(index, vector_df(spark, matrix, "query_id"), 10, 2)
    exact = {(r[0], r[2]) for r in brute_force(matrix, matrix, 10, "cosine")}
    found = {(r[0], r[2]) for r in collected(hits)}
    assert len(exact & found) / len(exact) > 0.95


def test_plan_cuts_before_the_shuffle(spark, explain, tmp_path):
    vector_df(spark, make_vectors(50)).withColumn("path", F.lit("x")).write.parquet(str(tmp_path / "v"))
    vectors = spark.read.parquet(str(tmp_path / "v"))
    plan = explain(topk.topk_search(vectors, vector_df(spark, make_vectors(5), "query_id"), 3))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "ReadSchema: struct<slot:bigint,embedding:array<float>>" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hits_and_display(spark):
    catalog = spark.createDataFrame([(0, "/a.png"), (1, "/a.png"), (2, "/c.png")], "slot long, path string")
    hits = spark.createDataFrame(
        [("q", 1, 0, 0.1, 99.0), ("q", 2, 1, 0.2, 98.0), ("q", 3, 2, 0.3, 97.0)],
        "query_id string, rank int, slot long, distance double, score double",
    )
    paths = with_paths(hits, catalog)
    ids = [r["row_id"] for r in with_row_ids(paths).orderBy("rank").collect()]
    assert ids[1] == ids[0] + "#" and len(ids[0]) == 16 and "#" not in ids[2]
    listing = spark.sql("select '/a.png' as path, 131072L as size, timestamp'2024-01-02 03:04:05' as modified")
    shown = with_result_columns(paths, listing).orderBy("rank").collect()
    assert [(r["size_text"], r["modified_text"], r["score_text"]) for r in shown] == [
        ("0.12MB", "2024-01-02 03:04:05", "99.00%"), ("0.12MB", "2024-01-02 03:04:05", "98.00%")]
    order = sorted_by(with_result_columns(paths, listing), "size", True).orderBy("position")
    assert [r["rank"] for r in order.collect()] == [1, 2]
    assert resized(paths, 2).count() == 2


def test_search_drops_missing_files_after_topk(spark):
    matrix = make_vectors(20)
    vectors = vector_df(spark, matrix).withColumn("path", F.concat(F.lit("/p"), "slot"))
    queries = vector_df(spark, matrix[:1], "query_id")
    everything = search(vectors, queries, 5).count()
    gone = vectors.select("path").filter("path <> '/p0'")
    assert (everything, search(vectors, queries, 5, listing=gone).count()) == (5, 4)
    assert neighbours(vectors, 2).filter("rank = 1").count() == 20


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_near_copies_rank_alike_on_every_route(spark, metric, tmp_path):
    """Groups of vectors that differ by less than the grid of distances, spread over cells."""
    import numpy as np

    from vecatlas.operators.cells import bounded_search, build_cell_index, probed_search

    pick = np.random.default_rng(4)
    centers = pick.normal(size=(40, 8))
    rows = []
    for c in centers:
        for _ in range(6):
            rows.append((c + pick.normal(scale=2e-6, size=8)).astype(np.float32))
    order = pick.permutation(len(rows))
    vectors = spark.createDataFrame([(int(s), rows[i].tolist()) for s, i in enumerate(order)], "slot long, embedding array<float>")
    queries = vectors.selectExpr("slot as query_id", "embedding")
    index = build_cell_index(vectors, str(tmp_path / metric), 24, metric)
    routes = [topk.topk_search(vectors, queries, 3, metric), bounded_search(index, queries, 3), probed_search(index, queries, 3, 24)]
    found = [{(r["query_id"], r["rank"], r["slot"]) for r in hits.collect()} for hits in routes]
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("bound", [4, 1000])
def test_the_nearest_window_counts(spark, metric, bound):
    pick = np.random.default_rng(9)
    matrix = pick.normal(size=(400, 5)).astype(np.float32)
    slots = np.sort(pick.integers(0, 60, 400))
    matrix[slots == 7] = matrix[0] + 0.01 * matrix[slots == 7]  # one slot could take all places
    vectors = spark.createDataFrame([(int(s), v.tolist()) for s, v in zip(slots, matrix)], "slot long, embedding array<float>")
    queries = spark.createDataFrame([(i, matrix[i * 9].tolist()) for i in range(12)], "query_id long, embedding array<float>")
    hits = topk.topk_windows(vectors.repartition(3), queries, 8, metric, bound).collect()
    for i in range(12):
        q = matrix[i * 9].astype(float)
        v = matrix.astype(float)
        d = ((v - q) ** 2).sum(1) if metric == "l2" else 1 - v @ q / np.linalg.norm(v, axis=1) / np.linalg.norm(q)
        best = {int(s): min(d[slots == s]) for s in set(slots.tolist())}
        want = sorted(best, key=lambda s: (round(best[s], 9), s))[:8]
        assert [r["slot"] for r in sorted((r for r in hits if r["query_id"] == i), key=lambda r: r["rank"])] == want


def test_cells_take_changes(spark):
    matrix = make_vectors()
    index = cells.build_cell_index(vector_df(spark, matrix), scratch_path(spark, "cells"), 6, "l2")
    changed = matrix.copy()
    changed[::3] = -changed[::3] + 1
    schema = "slot long, embedding array<float>"
    index.apply(spark.createDataFrame([(i, None) for i in range(0, len(matrix), 6)], schema), 1)
    index.apply(spark.createDataFrame([(i, changed[i].tolist()) for i in range(0, len(matrix), 3)], schema), 2)
    queries = vector_df(spark, matrix, "query_id")
    same(collected(cells.probed_search(index, queries, 5, 6)), brute_force(changed, matrix, 5, "l2"))
    same(collected(cells.bounded_search(cells.CellIndex.load(spark, index.path), queries, 5)), brute_force(changed, matrix, 5, "l2"))


def test_wide_queries_of_windows_are_split_by_bytes(spark, monkeypatch):
    from vecatlas.operators import topk

    pick = np.random.default_rng(4)
    rows = lambda n: [(i, pick.normal(size=16).tolist()) for i in range(n)]
    vectors = spark.createDataFrame(rows(20), "slot long, embedding array<float>")
    queries = spark.createDataFrame(rows(9), "query_id long, embedding array<float>")
    found = lambda: sorted((r["query_id"], r["rank"], r["slot"]) for r in topk.topk_windows(vectors, queries, 2).collect())
    want = found()
    monkeypatch.setattr(topk, "MAX_BROADCAST_BYTES", 600)
    assert found() == want and len(want) == 18


def test_paths_come_from_the_catalog(spark, explain):
    from vecatlas.plans.search import log_search
    from vecatlas.sources.commitlog import CommitLog, puts

    log = CommitLog(spark, scratch_path(spark, "atlas"))
    rows = spark.createDataFrame([(i, f"/{i}", 1, [float(i), 1.0]) for i in range(9)], "slot long, path string, size long, embedding array<float>")
    log.append(puts(rows), "c-0")
    hits = log_search(log, rows.select(F.col("slot").alias("query_id"), "embedding"), 1)
    assert {(r["query_id"], r["path"]) for r in hits.collect()} == {(i, f"/{i}") for i in range(9)}
    scans = [line.split("ReadSchema")[-1] for line in explain(hits).splitlines() if "FileScan" in line]
    assert len(set(scans)) == 2 and sum("embedding" in line for line in set(scans)) == 1  # the search's own scan


def test_all_of_a_query_counts(spark):
    from vecatlas.operators.encode import HashingEncoder, encode_texts
    from vecatlas.plans.search import window_search

    words = [f"w{i}" for i in range(200)]
    vocabulary = spark.createDataFrame([(t, i) for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *words])], "token string, id long")
    docs = spark.createDataFrame([(0, "/a", " ".join(words[100:150])), (1, "/b", " ".join(words[150:200]))], "slot long, path string, text string")
    windows = encode_texts(docs, "slot", "text", vocabulary, HashingEncoder(32), windows=True).select("slot", "path", "embedding")
    # The rewritten query begins with the words of no document; a later window is one document's, word for word.
    asked = spark.createDataFrame([(7, "x" * 3 + "".join(f".{w}" for w in words[:25]))], "query_id long, text string")
    long = spark.createDataFrame([(8, ".".join(words[:25] + words[100:150]))], "query_id long, text string")
    assert window_search(windows, asked, vocabulary, HashingEncoder(32), 2).count() == 2
    found = window_search(windows, long, vocabulary, HashingEncoder(32), 2).orderBy("rank").collect()
    assert [r["slot"] for r in found] == [0, 1] and found[0]["score"] > found[1]["score"]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_cells_in_two_steps(spark, metric, monkeypatch):
    """With a lowered limit the centres form a tree: the same hits, kept and changed as with one list."""
    monkeypatch.setattr(cells, "BRANCH", 4)
    pick = np.random.default_rng(8)
    data = np.concatenate([pick.normal(size=(60, 6)) * 0.1 + 3, pick.normal(size=(240, 6))]).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(900, None)], "slot long, embedding array<float>")
    asked = vectors.select(F.col("slot").alias("query_id"), "embedding").filter("slot % 5 = 0")
    found = lambda hits: sorted((r["query_id"], r["rank"], r["slot"]) for r in hits.collect())
    want = found(topk.topk_search(vectors, asked, 6, metric))
    path = scratch_path(spark, "cells")
    built = cells.build_cell_index(vectors, path, 30, metric)
    index = cells.CellIndex.load(spark, path)
    assert built.tree is not None and len(index.tree.coarse) == 6 and (index.tree.starts == built.tree.starts).all()
    assert 20 <= len(index.centers) <= 40 and index.tree.starts[-1] == len(index.centers)
    assert found(cells.probed_search(index, asked, 6, len(index.centers))) == want == found(cells.bounded_search(index, asked, 6))
    index.apply(vectors.filter("slot = 3").select("slot", F.transform("embedding", lambda x: -x).alias("embedding")), 1)
    turned = vectors.withColumn("embedding", F.when(F.col("slot") == 3, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")))
    assert found(cells.bounded_search(index, asked, 6)) == found(topk.topk_search(turned, asked, 6, metric))
    monkeypatch.setattr(cells, "MAX_CENTER_BYTES", 480)
    with pytest.raises(ValueError):
        cells.build_cell_index(vectors, scratch_path(spark, "cells"), 30, metric)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_large_query_tables_meet_vectors_in_blocks(spark, metric, monkeypatch):
    def probes(*_):
        raise AssertionError("a row per query and cell")

    monkeypatch.setattr(cells, "_probes", probes)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "_FIRST", 20)
    matrix = make_vectors(200)
    vectors, queries = vector_df(spark, matrix), vector_df(spark, matrix, "query_id")
    hits = topk.topk_search(vectors, queries, 5, metric, max_broadcast_queries=20)
    same(collected(hits), brute_force(matrix, matrix, 5, metric))
    # Ids of queries may repeat or be null, in blocks as in a broadcast.
    odd = queries.withColumn("query_id", F.when(F.col("query_id") % 4 > 0, F.col("query_id") % 40))
    found = [sorted(map(str, topk.topk_search(vectors, odd, 5, metric, bound).select("query_id", "rank", "slot").collect())) for bound in (20, 1000)]
    assert found[0] == found[1]


def test_large_query_table_without_vectors(spark):
    queries = vector_df(spark, make_vectors(60), "query_id")
    none = spark.createDataFrame([(1, None)], "slot long, embedding array<float>")
    assert topk.topk_search(none, queries, 3, max_broadcast_queries=20).count() == 0
    assert topk.topk_search(none.limit(0), queries, 3, max_broadcast_queries=20).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("scale", [1.0, 1e-22, 1e12, 1e18])
def test_single_precision_rules_out_no_hit(metric, scale, monkeypatch):
    pick = np.random.default_rng(8)
    matrix = pick.normal(size=(900, 24)) * scale
    matrix[300:600] = matrix[pick.integers(0, 300, 300)] * (1 + 1e-7 * pick.normal(size=(300, 1)))
    matrix[700], matrix[710:730] = 0, matrix[5]
    if metric == "cosine":
        matrix = topk.unit_rows(matrix)
    slots, rows = pick.permutation(900), np.arange(900)
    best, plain = topk.RunningTopK(900, 6), topk.RunningTopK(900, 6)
    monkeypatch.setattr(topk, "_FIRST", 100)
    best.scan(metric, matrix, rows, matrix, slots)
    plain.update(rows, topk.distances(metric, matrix, matrix), slots)
    # Pairs are summed in another order, which may move a distance by a step of the grid.
    assert (best.slot == plain.slot).mean() > 0.999 and np.allclose(best.distance, plain.distance, rtol=1e-6, atol=1e-9)
    sieve = topk.Sieve(metric, matrix, matrix)
    if sieve.usable:
        worst = plain.distance[:, -1]
        near = np.flatnonzero(topk.distances(metric, matrix, matrix) <= worst[:, None])
        for i in range(0, 900, 90):
            left = sieve.left(rows[i : i + 90], 0, 900, worst[i : i + 90])
            assert left is None or set(near[(near >= i * 900) & (near < (i + 90) * 900)] - i * 900) <= set(left)
