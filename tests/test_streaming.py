import datetime

from pyspark.sql import functions as F

from vecatlas.functions.vectors import normalize
from vecatlas.session import scratch_path, shared_dir
from vecatlas.sources import logs
from vecatlas.sources.commitlog import CommitLog, deletes, puts
from vecatlas.sources.snapshots import read_catalog_json, write_catalog_json
from vecatlas.streaming.ingest import apply_changes, start_ingest
from vecatlas.streaming.queries import start_search

FEED = "seq long, path string, op string, size long"


def state_of(log):
    return {r["path"]: r["size"] for r in log.catalog().filter("live").collect()}


def test_ingest_stream(spark):
    folder, log = scratch_path(spark, "feed"), CommitLog(spark, scratch_path(spark, "atlas"))
    checkpoint = scratch_path(spark, "ingest")

    def feed(*rows):
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(folder)
        start_ingest(log, stream, checkpoint, compact_every=2).awaitTermination()

    feed((2, "/a", "put", 5), (1, "/a", "delete", 0), (3, "/b", "put", 6), (4, "/c", "delete", 1))
    run()
    assert state_of(log) == {"/a": 5, "/b": 6}
    feed((5, "/a", "delete", 5), (6, "/d", "put", 7))
    run()
    assert state_of(log) == {"/b": 6, "/d": 7}
    # The freed slot is taken again.
    assert sorted(r["slot"] for r in log.catalog().collect()) == [0, 1]
    log.compact()
    feed((7, "/b", "put", 9))
    run()
    assert state_of(log) == {"/b": 9, "/d": 7}


def test_replayed_batch_is_idempotent(spark):
    log = CommitLog(spark, scratch_path(spark, "atlas"))
    first = spark.createDataFrame([(1, "/a", "put", 5), (2, "/b", "put", 6)], FEED)
    second = spark.createDataFrame([(3, "/a", "delete", 5), (4, "/c", "put", 8)], FEED)
    apply_changes(log, first, "stream-0")
    apply_changes(log, second, "stream-1")
    before = sorted(map(tuple, log.catalog().collect()), key=str)
    apply_changes(log, second, "stream-1")
    assert sorted(map(tuple, log.catalog().collect()), key=str) == before


def test_query_stream(spark):
    schema = "query_id long, embedding array<float>"
    vectors = spark.createDataFrame(
        [(0, "/a", [1.0, 0.0]), (1, "/b", [0.0, 1.0])], "slot long, path string, embedding array<float>"
    )
    folder, out = scratch_path(spark, "asked"), scratch_path(spark, "answers")
    for i, v in enumerate(([1.0, 0.1], [0.1, 1.0])):
        spark.createDataFrame([(i, v)], schema).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    start_search(stream, lambda: vectors, out, scratch_path(spark, "search"), 1).awaitTermination()
    got = {r["query_id"]: r["path"] for r in spark.read.parquet(out).collect()}
    assert got == {0: "/a", 1: "/b"}


def test_log_retention(spark):
    lines = ["2024-01-30 00:00:00,000 -  new", "2024-01-24 x", "2024-01-25 x", "2024 x", "bad line", "", "2024-13-01 x"]
    log = spark.createDataFrame([(line,) for line in lines], "line string")
    now = datetime.date(2024, 1, 31)
    assert [r["line"] for r in logs.retain(log, now).collect()] == [lines[0], lines[2]]
    assert [r["line"] for r in logs.retain(log, now, legacy=True).collect()] == lines[:3]
    (parsed,) = logs.parse(log).collect()
    assert parsed["message"] == "new" and parsed["ts"] == datetime.datetime(2024, 1, 30)


def test_log_file(spark, tmp_path):
    (tmp_path / "error.log").write_text("2024-01-30 00:00:00,000 -  a\nb\n")
    assert [r["line"] for r in logs.read_log(spark, str(tmp_path / "error.log")).collect()][1] == "b"


def test_normalize(spark):
    df = spark.sql("select array(3f, 0f, 4f) as v union all select array(0f, 0f)")
    rows = df.select(normalize(F.col("v")).alias("a"), normalize(F.col("v"), True).alias("b")).collect()
    assert [tuple(r) for r in rows] == [([0.6, 0.0, 0.8], [0.6, 0.2, 0.8]), (None, None)]


def test_json_lines(spark):
    path = scratch_path(spark, "json")
    state = spark.createDataFrame([(0, "/ä", 3, True), (1, None, 4, False)],
                                  "slot long, path string, size long, live boolean")
    write_catalog_json(state, path)
    assert sorted(map(tuple, read_catalog_json(spark, path).collect())) == sorted(map(tuple, state.collect()))


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_late_change_does_not_win(spark):
    log = CommitLog(spark, scratch_path(spark, "atlas"))
    batches = [[(9, "/a", "put", 9), (8, "/b", "delete", 0)], [(1, "/a", "put", 1), (2, "/b", "put", 2), (3, "/c", "put", 3)],
               [(10, "/c", "delete", 3), (4, "/a", "delete", 1)], [(5, "/c", "put", 5), (11, "/b", "put", 11)]]
    for n, rows in enumerate(batches):
        apply_changes(log, spark.createDataFrame(rows, FEED), f"stream-{n}")
        if n == 1:
            log.compact()
    assert state_of(log) == {"/a": 9, "/b": 11}
    apply_changes(log, spark.createDataFrame(batches[1], FEED), "stream-1")  # folded: nothing changes
    assert state_of(log) == {"/a": 9, "/b": 11}


def test_rows_that_cannot_be_encoded_are_kept(spark):
    log = CommitLog(spark, scratch_path(spark, "atlas"))

    def encode(work):
        good = F.col("path") != "/bad"
        return work.withColumn("embedding", F.when(good, F.array(F.col("size").cast("float"))))

    apply_changes(log, spark.createDataFrame([(1, "/a", "put", 1), (2, "/bad", "put", 2)], FEED), "stream-0", encode)
    assert [(r["path"], r["size"]) for r in log.errors().collect()] == [("/bad", 2)]
    assert state_of(log) == {"/a": 1}


def test_scratch_can_be_cleared(spark, monkeypatch):
    """In a folder of its own, since other tests' tables are staged in the session's."""
    from vecatlas import session
    from vecatlas.sources.storage import Storage

    log, own = CommitLog(spark, scratch_path(spark, "atlas")), scratch_path(spark, "own")
    monkeypatch.setattr(session, "_scratch", lambda spark: own)
    apply_changes(log, spark.createDataFrame([(1, "/a", "put", 5)], FEED), "stream-0")
    assert Storage(spark).names(own)
    session.clear_scratch(spark)
    assert not Storage(spark).exists(own)
    assert state_of(log) == {"/a": 5}


def test_failed_changes_are_tried_again(spark):
    log, broken = CommitLog(spark, scratch_path(spark, "atlas")), {"/b", "/c", "/d"}

    def encode(work):
        good = ~F.col("path").isin(*broken) if broken else F.lit(True)
        return work.withColumn("embedding", F.when(good, F.array(F.col("size").cast("float"))))

    def batch(n, *rows):
        apply_changes(log, spark.createDataFrame(rows, FEED), f"stream-{n}", encode)

    def errors():
        return {(r["path"], r["size"], r["source_seq"]) for r in log.errors().collect()}

    batch(0, (1, "/a", "put", 1), (2, "/b", "put", 2), (3, "/c", "put", 3), (4, "/d", "put", 4))
    assert state_of(log) == {"/a": 1} and errors() == {("/b", 2, 2), ("/c", 3, 3), ("/d", 4, 4)}
    batch(1, (5, "/e", "put", 5))  # /b fails a second time
    log.compact()
    log.compact()
    assert state_of(log) == {"/a": 1, "/e": 5} and errors() == {("/b", 2, 2), ("/c", 3, 3), ("/d", 4, 4)}
    # A newer change replaces the pending one, a delete ends it, an older change is late.
    batch(2, (6, "/c", "put", 33), (7, "/d", "delete", 0), (1, "/b", "put", 9))
    assert state_of(log) == {"/a": 1, "/e": 5} and errors() == {("/b", 2, 2), ("/c", 33, 6)}
    broken.clear()
    batch(3)
    assert state_of(log) == {"/a": 1, "/e": 5, "/b": 2, "/c": 33} and errors() == set()
    log.compact()
    assert state_of(log) == {"/a": 1, "/e": 5, "/b": 2, "/c": 33} and errors() == set()
    # A change in place that fails keeps the old row; the same change offered again is not late.
    broken.add("/a")
    batch(4, (8, "/a", "put", 10))
    assert state_of(log)["/a"] == 1
    broken.clear()
    batch(5, (8, "/a", "put", 10))
    assert state_of(log)["/a"] == 10 and errors() == set()


def test_slots_come_from_intervals(spark):
    """Allocation from the base's intervals and the commits since equals allocation from the whole catalog."""
    import random

    from vecatlas.operators.catalog import assign_slots

    pick, log, live, seq = random.Random(5), CommitLog(spark, scratch_path(spark, "atlas")), set(), 0
    for n in range(6):
        rows = []
        for path in pick.sample(sorted(live), len(live) // 3):
            rows.append((path, "delete"))
        rows += [(f"/p{n}-{i}", "put") for i in range(pick.randrange(1, 25))]
        batch = [(seq + i, path, op, 1) for i, (path, op) in enumerate(rows)]
        seq += len(rows)
        state = log.catalog()
        gone = {p for p, op in rows if op == "delete"}
        freed = state.withColumn("live", F.col("live") & ~F.col("path").isin("", *gone))
        new = spark.createDataFrame([(p,) for p, op in rows if op == "put"], "path string")
        want = {r["path"]: r["slot"] for r in assign_slots(new, freed).collect()}
        want |= {r["path"]: r["slot"] for r in state.filter("live").collect() if r["path"] not in gone}
        apply_changes(log, spark.createDataFrame(batch, FEED), f"stream-{n}")
        assert {r["path"]: r["slot"] for r in log.catalog().filter("live").collect()} == want
        live = set(want)
        if n in (1, 3):
            log.compact()


def test_a_batch_does_not_scan_the_catalog(spark, explain, monkeypatch):
    log = CommitLog(spark, scratch_path(spark, "atlas"))
    apply_changes(log, spark.createDataFrame([(i, f"/p{i}", "put", i) for i in range(200)], FEED), "stream-0")
    log.compact()
    asked = spark.createDataFrame([("/p7",)], "path string")
    plan = explain(log.paths(None, asked))
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "embedding" not in plan

    def forbidden(*_):
        raise AssertionError("the catalog is read")

    monkeypatch.setattr(CommitLog, "_state", forbidden)
    apply_changes(log, spark.createDataFrame([(300, "/p7", "delete", 0), (301, "/new", "put", 1)], FEED), "stream-1")
    monkeypatch.undo()
    assert len(state_of(log)) == 200 and {r["path"]: r["slot"] for r in log.catalog().filter("path = '/new'").collect()}.keys() == {"/new"}


def test_free_slots_are_found_without_sorting(spark, explain):
    """The newest row of a slot decides; within a commit a put beats a delete."""
    log = CommitLog(spark, scratch_path(spark, "atlas"))
    row = lambda *slots: spark.createDataFrame([(s, f"/{s}", 1) for s in slots], "slot long, path string, size long")
    log.append(puts(row(0, 1, 2, 3)), "a")
    log.append(deletes(row(0, 1, 2)).unionByName(puts(row(1))), "b")
    log.append(puts(row(0)).unionByName(deletes(row(3))), "c")
    free, end = log.free(None, 5, row(1))
    assert sorted(r["slot"] for r in free.collect()) == [1, 2, 3] and end == 4
    assert "SortAggregate" not in explain(free)
