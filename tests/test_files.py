import json

import pytest
from pyspark.sql import functions as F

from vecatlas.sources import sinks
from vecatlas.sources.files import list_files, list_inventory
from vecatlas.sources.snapshots import read_catalog_array, write_catalog_array

CATALOG = "slot long, path string, size long, live boolean"


def test_copies_and_flags(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"x" * 3_000_000)
    (tmp_path / "a" / "empty").write_bytes(b"")
    (tmp_path / "blocked").write_bytes(b"")
    rows = [(f"{tmp_path}/a/x.bin", "one"), (f"file://{tmp_path}/a/x.bin", "two"), (f"{tmp_path}/a/empty", "none"), (f"{tmp_path}/gone", "lost"),
            (f"{tmp_path}/a", "folder"), (f"{tmp_path}/out/one", "one (2)")]
    manifest = spark.createDataFrame(rows[:5], "src_path string, target_name string")
    for _ in range(2):  # a repeated job gives the same
        got = {r["target_name"]: (r["ok"], r["bytes"]) for r in sinks.export_copies(manifest, f"{tmp_path}/out").collect()}
        assert got == {"one": (True, 3_000_000), "two": (True, 3_000_000), "none": (True, 0), "lost": (False, 0), "folder": (False, 0)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["none", "one", "two"]
    assert (tmp_path / "out" / "two").read_bytes() == b"x" * 3_000_000
    copies = sinks.export_copies(manifest, f"file://{tmp_path}/out")
    assert [tuple(r) for r in sinks.all_ok(copies).collect()] == [(False, 5, 2)]
    assert [tuple(r) for r in sinks.all_ok(copies.filter("ok")).collect()] == [(True, 3, 0)]
    # Onto itself, and into something that is no folder.
    own = spark.createDataFrame([(f"{tmp_path}/out/one", "one")], "src_path string, target_name string")
    assert [(r["ok"], r["bytes"]) for r in sinks.export_copies(own, f"{tmp_path}/out").collect()] == [(True, 3_000_000)]
    assert [r["ok"] for r in sinks.export_copies(own, f"{tmp_path}/blocked").collect()] == [False]
    assert sinks.export_copies(manifest.limit(0), f"{tmp_path}/out").count() == 0


def test_many_folders_are_written_and_listed(spark, tmp_path):
    rows = spark.range(600).select(F.concat(F.lit("d"), (F.col("id") % 200).cast("string"), F.lit("/s/"), "id", F.lit(".png")).alias("name"),
                                   F.when(F.col("id") > 0, F.repeat(F.lit("ä"), F.col("id").cast("int"))).cast("binary").alias("content"))
    assert sinks.write_files(rows, f"{tmp_path}/many").filter("ok").count() == 600
    found = {r["path"]: r["size"] for r in list_files(spark, [f"{tmp_path}/many"]).collect()}
    assert found == {f"{tmp_path}/many/d{i % 200}/s/{i}.png": 2 * i for i in range(1, 600)}  # Spark lists no empty files


def test_inventory(spark):
    rows = [("file:///r/a.png", 1, 1), ("/r/a.png", 2, 2), ("/r/b.png", 3, 1), ("/r/b.png", None, 2), ("/r/c.txt", 4, 1), ("/other/d.png", 5, 1), ("/r/s/e.JPG", 6, 1)]
    inventory = spark.createDataFrame(rows, "path string, size long, t long").withColumn("modified", F.timestamp_seconds("t")).drop("t")
    got = list_inventory(inventory, spark.createDataFrame([("/r",)], "root string"))
    assert {(r["path"], r["size"]) for r in got.collect()} == {("/r/a.png", 2), ("/r/s/e.JPG", 6)}


def hard_paths(n):
    odd = ['a]b.png', 'q"].png', "back\\slash]", '],["x", 1]', "ä 中", "[", '\\"]', "tab\t", "NOTEXISTS "]
    return [(i, None if i % 7 == 3 else f"/p{i}/{odd[i % len(odd)]}", i * i, i % 7 != 3) for i in range(n)]


def test_catalog_array_round_trip(spark, tmp_path):
    rows = hard_paths(500)
    adaptive = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(adaptive, "false")
    try:
        write_catalog_array(spark.createDataFrame(rows, CATALOG), f"{tmp_path}/parts")
    finally:
        spark.conf.unset(adaptive)
    parts = sorted(p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-"))
    whole = "".join(p.read_text() for p in parts)
    assert len(parts) > 1 and "\n" not in whole
    assert json.loads(whole) == [[p if live else "NOTEXISTS", size] for _, p, size, live in rows]
    assert sorted(map(tuple, read_catalog_array(spark, f"{tmp_path}/parts").collect())) == rows


def test_one_line_is_read_by_many_tasks(spark, tmp_path):
    rows = hard_paths(4000)
    line = json.dumps([[p if live else "NOTEXISTS", size] for _, p, size, live in rows], ensure_ascii=False)
    (tmp_path / "index.json").write_text(line)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        assert spark.read.option("lineSep", "]").text(f"{tmp_path}/index.json").rdd.getNumPartitions() > 5
        assert sorted(map(tuple, read_catalog_array(spark, f"{tmp_path}/index.json").collect())) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


@pytest.mark.parametrize("text", ["[]", " [ ] \n", "", "\n"])
def test_empty_catalog_arrays(spark, tmp_path, text):
    (tmp_path / "index.json").write_text(text)
    assert read_catalog_array(spark, f"{tmp_path}/index.json").count() == 0


@pytest.mark.parametrize("text", ['[["a", 1]', '[["a", 1], ["b"]]', '["a", 1]', '[["a", "x"]]', '{"a": 1}', '[["a", 1] ["b", 2]]', '[["a", 1, 2]]', "[", '[["a", 1]]]', '[["a]'])
def test_broken_catalog_arrays(spark, tmp_path, text):
    (tmp_path / "index.json").write_text(text)
    with pytest.raises(ValueError):
        read_catalog_array(spark, f"{tmp_path}/index.json").collect()
