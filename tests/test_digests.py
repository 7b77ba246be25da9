import random

from pyspark.sql import functions as F

from vecatlas.operators import catalog as cat
from vecatlas.operators import digests as dg


def test_diff_of_differing_directories(spark, monkeypatch):
    pick = random.Random(3)
    old = {f"/r/d{i % 40}/s{i % 3}/{i}.png": i for i in range(400)} | {"bare": 1, "/top": 2}
    new = dict(old)
    for path in pick.sample(sorted(old), 6):
        new[path] += 1
    for path in pick.sample(sorted(old), 4):
        del new[path]
    new["/r/new/x.png"] = 5
    state = spark.createDataFrame([(i, p, s, True) for i, (p, s) in enumerate(old.items())] + [(9999, None, 7, False)],
                                  "slot long, path string, size long, live boolean")
    listing = spark.createDataFrame(list(new.items()), "path string, size long")
    want = sorted(map(tuple, cat.diff(state, listing).collect()), key=str)
    joined = []

    def counted(a, b):
        joined.append((a.count(), b.count()))
        return cat.diff(a, b)

    monkeypatch.setattr(dg, "diff", counted)
    assert sorted(map(tuple, dg.diff_by_digest(state, listing).collect()), key=str) == want
    assert joined[0][0] < 120 and joined[0][1] < 120
    kept = dg.directory_digests(cat.live_rows(state))
    assert sorted(map(tuple, dg.diff_by_digest(state, listing, kept).collect()), key=str) == want
    assert dg.diff_by_digest(state, cat.live_rows(state).select("path", "size")).count() == 0


def test_trees(spark):
    old = {"/a/x/1": 1, "/a/x/2": 2, "/a/y/3": 3, "/b/z/4": 4, "/b/z/w/5": 5, "6": 6}
    new = old | {"/a/y/3": 33}
    digests = lambda files: dg.directory_digests(spark.createDataFrame(list(files.items()), "path string, size long"))
    trees = {r["dir"]: r["files"] for r in dg.tree_digests(digests(old)).collect()}
    assert trees == {"": 6, "/a": 3, "/a/x": 2, "/a/y": 1, "/b": 2, "/b/z": 2, "/b/z/w": 1}
    assert {r["dir"] for r in dg.differing(dg.tree_digests(digests(old)), dg.tree_digests(digests(new))).collect()} == {"", "/a", "/a/y"}
    assert {r["dir"] for r in dg.outermost_unchanged(digests(old), digests(new)).collect()} == {"/a/x", "/b"}
    assert {r["dir"] for r in dg.outermost_unchanged(digests(old), digests(old)).collect()} == {""}
    swapped = {"/d/a": 1, "/d/b": 2}, {"/d/a": 2, "/d/b": 1}
    assert dg.differing(*map(digests, swapped)).filter(F.col("dir") == "/d").count() == 1
