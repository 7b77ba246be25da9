import random

from pyspark.sql import functions as F

from vecatlas.operators.topk import topk_search, topk_with_bound
from vecatlas.session import scratch_path
from vecatlas.sources.commitlog import CommitLog, deletes, puts
from vecatlas.streaming import standing as st

VECTORS = "slot long, path string, size long, embedding array<float>"


def rows(spark, vectors):
    return spark.createDataFrame([(s, f"/{s}", 1, v) for s, v in vectors.items()], VECTORS)


def hits(df):
    return sorted((r["query_id"], r["rank"], r["slot"], round(r["distance"], 8)) for r in df.collect())


def test_results_follow_every_commit(spark):
    pick = random.Random(1)
    vector = lambda: [round(pick.uniform(-1, 1), 1) for _ in range(2)]
    asked = spark.createDataFrame([(q, vector()) for q in range(12)], "query_id long, embedding array<float>")
    log = CommitLog(spark, scratch_path(spark, "atlas"))
    standing = st.StandingQueries(log, asked, scratch_path(spark, "standing"), 3, "l2")
    live = {}
    for n in range(5):
        new = {pick.randrange(40): vector() for _ in range(pick.randrange(1, 6))}
        gone = pick.sample(sorted(set(live) - set(new)), min(len(set(live) - set(new)), n))
        log.append(puts(rows(spark, new)).unionByName(deletes(rows(spark, {s: live[s] for s in gone}))), f"c-{n}")
        live = {s: v for s, v in (live | new).items() if s not in gone}
        if n == 2:
            log.compact()  # the commits are folded before the results have seen them
        assert hits(standing.refresh()) == hits(topk_search(rows(spark, live), asked, 3, "l2"))
        assert hits(standing.refresh()) == hits(standing.results())


def test_unchanged_vectors_are_read_only_for_queries_that_lost_a_hit(spark):
    vectors = {s: [1.0, s / 100] for s in range(20)}
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.2])], "query_id long, embedding array<float>")
    before = topk_search(rows(spark, vectors), asked, 2)
    calls = []

    def state(left):
        def read():
            calls.append(1)
            return rows(spark, left)
        return read

    def change(new):
        return spark.createDataFrame(list(new.items()), "slot long, embedding array<float>")

    # A new near vector and the loss of one that is in no result: nothing else is read.
    new = {30: [1.0, 0.001], 10: None}
    left = {s: v for s, v in (vectors | new).items() if v}
    got = st.refreshed(before, asked, change(new), state(left), 2)
    assert hits(got) == hits(topk_search(rows(spark, left), asked, 2)) and not calls
    # A hit is replaced by a nearer vector: still nothing.
    new = {0: None, 31: [1.0, 0.0]}
    left = {s: v for s, v in (vectors | new).items() if v}
    got = st.refreshed(before, asked, change(new), state(left), 2)
    assert hits(got) == hits(topk_search(rows(spark, left), asked, 2)) and not calls
    # A hit is lost: its query searches again.
    left = {s: v for s, v in vectors.items() if s}
    got = st.refreshed(before, asked, change({0: None}), state(left), 2)
    assert hits(got) == hits(topk_search(rows(spark, left), asked, 2)) and len(calls) == 1
    # A list that was short held all vectors, so nothing is searched.
    few = {1: [1.0, 0.0]}
    short = topk_search(rows(spark, few), asked, 2)
    assert st.refreshed(short, asked, change({1: None}), state({}), 2).count() == 0 and len(calls) == 1


def test_as_a_stream(spark):
    log, folder = CommitLog(spark, scratch_path(spark, "atlas")), scratch_path(spark, "feed")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    for vectors in ({0: [0.0, 1.0]}, {1: [1.0, 0.1]}, {0: [1.0, 0.0]}):
        rows(spark, vectors).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(VECTORS).option("maxFilesPerTrigger", 1).parquet(folder)
    standing = st.StandingQueries(log, asked, scratch_path(spark, "standing"), 2)
    apply = lambda batch, commit: log.append(puts(batch), commit)
    st.start_standing(standing, stream, scratch_path(spark, "checkpoint"), apply).awaitTermination()
    assert [r["slot"] for r in standing.results().orderBy("rank").collect()] == [0, 1]
    assert standing.results().filter(F.col("distance") > 0.1).count() == 0


def test_deletes_alone_with_more_queries_than_a_block(spark, monkeypatch):
    """Changes without a vector leave nothing to score, however many queries stand."""
    monkeypatch.setattr(st, "topk_search", lambda *a: topk_search(*a, max_broadcast_queries=5))
    vectors = {s: [1.0, s / 100] for s in range(20)}
    asked = spark.createDataFrame([(i, [1.0, i / 50]) for i in range(12)], "query_id long, embedding array<float>")
    left = {s: v for s, v in vectors.items() if s % 3}
    gone = spark.createDataFrame([(s, None) for s in vectors if s % 3 == 0], "slot long, embedding array<float>")
    got = st.refreshed(topk_search(rows(spark, vectors), asked, 2), asked, gone, lambda: rows(spark, left), 2)
    assert hits(got) == hits(topk_search(rows(spark, left), asked, 2))


def test_commits_with_more_queries_than_a_block(spark, monkeypatch):
    """The commits of ``standing_topk_after_commits``: puts, puts, deletes alone, replaced and returning vectors."""
    bounds = []

    def search(vectors, queries, k, metric):
        found, bound = topk_with_bound(vectors, queries, k, metric, max_broadcast_queries=5)
        bounds.append(bound)
        return found

    monkeypatch.setattr(st, "topk_search", search)
    vectors = {s: [1.0, s / 100] for s in range(20)}
    asked = spark.createDataFrame([(i, [1.0, i / 50]) for i in range(12)], "query_id long, embedding array<float>")
    log = CommitLog(spark, scratch_path(spark, "atlas"))
    standing = st.StandingQueries(log, asked, scratch_path(spark, "standing"), 3)
    live = {}
    for n, change in enumerate((
        {s: v for s, v in vectors.items() if s % 2}, {s: v for s, v in vectors.items() if s % 2 == 0},
        {s: None for s in vectors if s % 3 == 0}, {s: [-x for x in v] for s, v in vectors.items() if s % 3 == 1} | {0: vectors[0]},
    )):
        new, gone = {s: v for s, v in change.items() if v}, [s for s, v in change.items() if not v]
        log.append(puts(rows(spark, new)) if new else deletes(rows(spark, {s: live[s] for s in gone})), f"c-{n}")
        live = {s: v for s, v in (live | new).items() if s not in gone}
        assert hits(standing.refresh()) == hits(topk_search(rows(spark, live), asked, 3))
    assert None in bounds  # some search took the block path
