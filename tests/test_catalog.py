import random

import pytest
from pyspark.sql import functions as F

from vecatlas.functions import display
from vecatlas.functions.paths import ancestors, is_image_path, normalize_path, stem, suffix
from vecatlas.operators import catalog as cat
from vecatlas.operators.paths import register_roots, under_roots, unregister_roots
from vecatlas.operators.ranking import prefix_sum, rank_within, row_index
from vecatlas.plans.sync import rebuild, sync, unregister
from vecatlas.session import scratch_path
from vecatlas.sources.commitlog import CommitLog, puts


def catalog_df(spark, rows):
    return spark.createDataFrame(rows, "slot long, path string, size long, live boolean")


def listing_df(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, size long")


def roots_df(spark, *roots):
    return spark.createDataFrame([(r,) for r in roots], "root string")


def test_positions_ranks_and_totals(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 == 0 else f"k{i % 11}", i, rng.randrange(5)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at long, value long").repartition(7)
    indexed, count = row_index(df, ["at"])
    assert count == 500 and all(r["at"] == r["row_index"] for r in indexed.collect())
    by_key = {}
    expected = {}
    for key, at, _ in sorted(rows):
        by_key[key] = by_key.get(key, 0) + 1
        expected[at] = by_key[key]
    ranked = rank_within(df, ["key"], ["at"]).collect()
    assert {r["at"]: r["rank"] for r in ranked} == expected
    totals = {r["at"]: (r["value"], r["before"]) for r in prefix_sum(df, ["at"], "value", "before").collect()}
    running = 0
    for at in range(500):
        assert totals[at][1] == running
        running += totals[at][0]
    empty, none = row_index(df.filter("at < 0"), ["at"])
    assert none == 0 and empty.count() == 0


@pytest.mark.parametrize("free, new, expected", [
    ([1, 3], "pqr", {"r": 1, "q": 3, "p": 5}),
    ([1, 3], "p", {"p": 1}),
    ([], "pq", {"p": 5, "q": 6}),
    ([1], "", {}),
])
def test_slot_allocation(spark, free, new, expected):
    rows = [(i, None if i in free else f"/{i}", 1, i not in free) for i in range(5)]
    files = spark.createDataFrame([(p, 1) for p in new], "path string, size long")
    got = cat.assign_slots(files, catalog_df(spark, rows)).collect()
    assert {r["path"]: r["slot"] for r in got} == expected


def test_slot_allocation_on_empty_catalog(spark):
    files = spark.createDataFrame([("b", 1), ("a", 1)], "path string, size long")
    got = cat.assign_slots(files, catalog_df(spark, [])).collect()
    assert {r["path"]: r["slot"] for r in got} == {"a": 0, "b": 1}


def test_diff_and_tombstones(spark):
    state = catalog_df(spark, [(0, "/a", 1, True), (1, "/b", 2, True), (2, None, 7, False), (3, "/d", 4, True)])
    listing = listing_df(spark, {"/a": 1, "/b": 3, "/e": 5})
    changes = {(r["slot"], r["path"], r["size"], r["status"]) for r in cat.diff(state, listing).collect()}
    assert changes == {(1, "/b", 3, "changed"), (None, "/e", 5, "new"), (3, "/d", 4, "missing")}
    after = cat.tombstone(state, cat.missing_files(state, listing))
    assert {tuple(r) for r in after.collect()} == {
        (0, "/a", 1, True), (1, "/b", 2, True), (2, None, 7, False), (3, None, 4, False)}
    dense = cat.densify(state.filter("slot in (0, 3)")).orderBy("slot").collect()
    assert [tuple(r) for r in dense][1:3] == [(1, None, 0, False), (2, None, 0, False)]
    assert cat.result_count(state, 2).first()[0] == 2 and cat.live_count(state).first()[0] == 3


def test_containment(spark):
    paths = ["/a/x.png", "/a/b/c.png", "/ab/c.png", "/z/q.png", "/A/y.png"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    under = lambda *roots, **kw: sorted(r["path"] for r in under_roots(df, roots_df(spark, *roots), **kw).collect())
    assert under("/a") == ["/a/b/c.png", "/a/x.png"]
    # Nested roots give each path once.
    assert under("/a", "/a/b", "/a/") == ["/a/b/c.png", "/a/x.png"]
    assert under("/") == sorted(paths)
    assert under("/a", case_insensitive=True) == ["/A/y.png", "/a/b/c.png", "/a/x.png"]


def sequential_roots(registered, asked):
    known, result = list(registered), []
    for root in asked:
        if root in known:
            result.append("duplicate")
        elif any(root.startswith(k.rstrip("/") + "/") and root != k for k in known):
            result.append("covered")
        else:
            known.append(root)
            result.append("added")
    return result


def test_root_registration(spark):
    rng = random.Random(4)
    pool = ["/", "/a", "/a/b", "/a/b/c", "/ab", "/d", "/d/e"]
    for registered in ([], ["/a"], ["/d/e"]):
        asked = [rng.choice(pool) for _ in range(12)]
        candidates = spark.createDataFrame(list(enumerate(asked)), "ordinal long, root string")
        got = register_roots(roots_df(spark, *registered) if registered else
                             spark.createDataFrame([], "root string"), candidates)
        assert [r["status"] for r in got.orderBy("ordinal").collect()] == sequential_roots(registered, asked)
    left = unregister_roots(roots_df(spark, "/a", "/b"), roots_df(spark, "/b/"))
    assert [r["root"] for r in left.collect()] == ["/a"]


def state_of(log):
    return {r["path"]: (r["slot"], r["size"]) for r in log.catalog().filter("live").collect()}


def fake_encoder(work):
    """Files of odd size cannot be encoded."""
    vector = F.when(F.col("size") % 2 == 0, F.array(F.col("size").cast("float"), F.lit(1.0).cast("float")))
    return work.withColumn("embedding", vector)


def test_sync_life_cycle(spark):
    log, roots = CommitLog(spark, scratch_path(spark, "atlas")), roots_df(spark, "/r")
    first = sync(log, listing_df(spark, {"/r/a": 2, "/r/b": 4, "/r/c": 5}), roots, "sync-0", fake_encoder)
    assert state_of(log) == {"/r/a": (0, 2), "/r/b": (1, 4)}
    assert [r["path"] for r in first.errors.collect()] == ["/r/c"]
    # Nothing to do but the file that failed.
    again = sync(log, listing_df(spark, {"/r/a": 2, "/r/b": 4, "/r/c": 5}), roots, "sync-1", fake_encoder)
    assert [r["path"] for r in again.work.collect()] == ["/r/c"]
    # /r/a goes and its slot is taken again in the same commit; /r/b changes in place.
    sync(log, listing_df(spark, {"/r/b": 6, "/r/c": 8}), roots, "sync-2", fake_encoder)
    assert state_of(log) == {"/r/b": (1, 6), "/r/c": (0, 8)}
    assert {r["slot"]: r["embedding"] for r in log.vectors().collect()} == {1: [6.0, 1.0], 0: [8.0, 1.0]}
    # An unreadable change keeps the old row and is tried again.
    kept = sync(log, listing_df(spark, {"/r/b": 7, "/r/c": 8}), roots, "sync-3", fake_encoder)
    assert state_of(log)["/r/b"] == (1, 6) and kept.errors.count() == 1
    # Replaying the commit changes nothing.
    sync(log, listing_df(spark, {"/r/b": 7, "/r/c": 8}), roots, "sync-3", fake_encoder)
    assert state_of(log) == {"/r/b": (1, 6), "/r/c": (0, 8)}
    # Files outside the scanned roots are neither lost nor counted as missing.
    sync(log, spark.createDataFrame([], "path string, size long"),
         roots_df(spark, "/other"), "sync-4", fake_encoder)
    assert len(state_of(log)) == 2
    before = state_of(log)
    for _ in range(3):
        log.compact()
        assert state_of(log) == before
        assert log.vectors().count() == 2
    assert log._storage.names(f"{log.path}/rows") == [] and len(log._storage.names(f"{log.path}/base")) == 2
    sync(log, listing_df(spark, {"/r/b": 6, "/r/c": 8, "/r/d": 2}), roots, "sync-5", fake_encoder)
    assert state_of(log)["/r/d"] == (2, 2)
    rebuild(log, listing_df(spark, {"/r/d": 2, "/r/b": 6}), roots, "sync-6", fake_encoder)
    assert state_of(log) == {"/r/b": (0, 6), "/r/d": (1, 2)}


def test_unfilled_slots_are_taken_again(spark):
    log, roots = CommitLog(spark, scratch_path(spark, "atlas")), roots_df(spark, "/r")
    files = {"/r/a": 2, "/r/b": 3, "/r/c": 4, "/r/d": 5}
    sync(log, listing_df(spark, files), roots, "sync-0", fake_encoder)
    assert state_of(log) == {"/r/a": (0, 2), "/r/c": (2, 4)}
    assert sorted(r["slot"] for r in log.catalog().collect()) == [0, 1, 2]
    sync(log, listing_df(spark, files | {"/r/b": 6, "/r/d": 8}), roots, "sync-1", fake_encoder)
    # The last file of the list takes the free slot.
    assert state_of(log) == {"/r/a": (0, 2), "/r/c": (2, 4), "/r/d": (1, 8), "/r/b": (3, 6)}


def test_replay_keeps_its_place(spark):
    log = CommitLog(spark, scratch_path(spark, "atlas"))
    row = lambda size: puts(spark.createDataFrame([(0, "/a", size)], "slot long, path string, size long"))
    log.append(row(1), "c-0")
    # A commit with a place but without data is not read and not folded.
    assert log.ordinal("c-1") == 1
    log.compact()
    assert state_of(log) == {"/a": (0, 1)}
    log.append(row(2), "c-1")
    log.append(row(3), "c-2")
    log.append(row(2), "c-1")
    assert state_of(log) == {"/a": (0, 3)}


def test_snapshot_is_not_shuffled(spark, explain):
    log, roots = CommitLog(spark, scratch_path(spark, "atlas")), roots_df(spark, "/r")
    sync(log, listing_df(spark, {"/r/a": 2, "/r/b": 4}), roots, "sync-0", fake_encoder)
    log.compact()
    assert "Exchange" not in explain(log.vectors())
    sync(log, listing_df(spark, {"/r/a": 2, "/r/b": 6}), roots, "sync-1", fake_encoder)
    plan = explain(log.vectors())
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "embedding" not in explain(log.catalog())


def test_unregister(spark):
    log = CommitLog(spark, scratch_path(spark, "atlas"))
    roots = roots_df(spark, "/r", "/s")
    files = {"/r/a": 2, "/s/b": 4, "/s/c": 6}
    sync(log, listing_df(spark, files), roots, "sync-0")
    del files["/s/c"]
    left = unregister(log, roots, roots_df(spark, "/r"), listing_df(spark, files), "remove-0")
    assert [r["root"] for r in left.collect()] == ["/s"] and set(state_of(log)) == {"/s/b"}


def test_path_functions(spark):
    cases = {
        "/a/b/c.png": (["", "/a", "/a/b"], "/a/b/c.png", True),
        "/a/../b//./c.tar.GIF": (None, "/b/c.tar.GIF", True),
        "x": ([], "x", False), "/": (None, "/", False), "../a/..": (None, "..", False),
        "/../a/": (None, "/a", False), "": ([], ".", False), "/d/.png": (None, "/d/.png", False),
        "/d/apng": (None, "/d/apng", False),
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    p = F.col("p")
    for row in df.select("p", ancestors(p), normalize_path(p), is_image_path(p)).collect():
        above, normal, image = cases[row[0]]
        assert above is None or row[1] == above
        assert (row[2], row[3]) == (normal, image)
    names = spark.createDataFrame([("a.b.png",), ("a",), (".png",), ("a.",)], "p string")
    assert [tuple(r) for r in names.select(stem(p), suffix(p)).collect()] == [
        ("a.b", ".png"), ("a", ""), (".png", ""), ("a.", "")]


def test_display(spark):
    sizes = [0, 131072, 393216, 5, 1048576, 123456789012, 5242, 5243]
    df = spark.createDataFrame([(s,) for s in sizes], "s long")
    got = [r[0] for r in df.select(display.size_text(F.col("s"))).collect()]
    assert got == [f"{s / 1024 / 1024:.2f}MB" for s in sizes]


def _paths(log):
    return sorted(r["path"] for r in log.catalog().filter("live").collect())


def _row(spark, slot, path):
    return puts(spark.createDataFrame([(slot, path, 1)], "slot long, path string, size long"))


def test_a_replayed_rebuild_keeps_the_catalog(spark):
    from vecatlas.plans.sync import rebuild

    log, roots = CommitLog(spark, scratch_path(spark, "atlas")), roots_df(spark, "/r")
    log.append(_row(spark, 0, "/r/old"), "first")
    listing = spark.createDataFrame([("/r/a", 1), ("/r/b", 2)], "path string, size long")
    for _ in range(2):
        rebuild(log, listing, roots, "again")
        assert _paths(log) == ["/r/a", "/r/b"]
    log.append(_row(spark, 5, "/r/lost"), "first")  # its place lies before the reset
    assert _paths(log) == ["/r/a", "/r/b"]


def test_a_late_commit_is_not_folded_away(spark):
    log = CommitLog(spark, scratch_path(spark, "atlas"))
    log.append(_row(spark, 0, "/first"), "first")
    log.ordinal("slow")
    log.append(_row(spark, 1, "/fast"), "fast")
    log.compact()
    assert _paths(log) == ["/fast", "/first"]
    log.append(_row(spark, 2, "/slow"), "slow")
    assert _paths(log) == ["/fast", "/first", "/slow"]
    log.compact()
    log.compact()
    assert _paths(log) == ["/fast", "/first", "/slow"]
