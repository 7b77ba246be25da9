import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vecatlas.llm import lines, queries

WHITE = " \t\n\x0b\x0c\r"


def expected(rows, min_docs, keep_first=False):
    """Kept text of each row, in the rows' order; rows are told apart by id in the order of reading."""
    lower = str.maketrans(queries._UPPER, queries._LOWER)
    docs, split = defaultdict(set), [(d, (t or "").split("\n")) for d, t in rows]
    for d, ls in split:
        for line in ls:
            docs[line.strip(WHITE).translate(lower)].add(d)
    seen, out = set(), {}
    for i in sorted(range(len(split)), key=lambda i: (split[i][0] is not None, split[i][0] or 0, i)):
        kept = []
        for line in split[i][1]:
            key = line.strip(WHITE).translate(lower)
            drop = key and len(docs[key]) >= min_docs
            if drop and keep_first and key not in seen:
                drop = False
            seen.add(key)
            if not drop:
                kept.append(line)
        out[i] = "\n".join(kept)
    return [out[i] for i in range(len(split))]


def kept(spark, rows, **options):
    marked, n_lines, n_dropped, keep = lines.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), **options)
    return [(r["doc_id"], lines.kept_text(r["text"], r[keep]), r[n_lines], r[n_dropped]) for r in marked.collect()]


def corpus():
    rows = [(i, f"own {i}\n  Shared LINE \nmiddle {i % 3}\nshared line\nend {i}") for i in range(40)]
    return [*rows, (None, "shared line\n\n"), (50, None), (51, ""), (51, ""), (3, "own 3\nshared line"), (52, "\n" * 5)]


@pytest.mark.parametrize("min_docs, keep_first", [(10, False), (14, False), (1, True), (2, True), (1000, False)])
def test_against_brute_force(spark, min_docs, keep_first):
    rows = corpus()
    got = kept(spark, rows, min_docs=min_docs, keep_first=keep_first)
    assert sorted((str(d), t) for d, t, _, _ in got) == sorted(
        (str(d), t) for (d, _), t in zip(rows, expected(rows, min_docs, keep_first)))


def test_a_hot_line_spans_partitions(spark):
    """With many partitions the ranges of the hot line's hash are settled from their edges."""
    rows = [(i, f"hot\nown {i}\nhot") for i in range(3000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for keep_first, left in ((False, 0), (True, 1)):
            got = kept(spark, rows, min_docs=2500, keep_first=keep_first)
            assert sum(t.count("hot") for _, t, _, _ in got) == left
            assert not sum(n for _, _, _, n in kept(spark, rows, min_docs=3001, keep_first=keep_first))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("min_docs, keep_first", [(3, False), (3, True), (6, True), (1000, False)])
def test_lines_that_few_documents_repeat(spark, monkeypatch, min_docs, keep_first):
    """A task writes undecided lines out when it holds too many; they are dropped if enough documents follow."""
    monkeypatch.setattr(lines, "HELD", 7)
    rows = [(1, "a\n" * 40 + "own"), (2, "b\n" * 30), (None, "a\nb\n" * 20), (3, "a\n" * 25 + "c\n" * 25), *((i, f"b\nown {i}\nd") for i in range(4, 9))]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "5")
    try:
        got = kept(spark, rows, min_docs=min_docs, keep_first=keep_first)
    finally:
        spark.conf.set(name, old)
    assert sorted((str(d), t) for d, t, _, _ in got) == sorted(
        (str(d), t) for (d, _), t in zip(rows, expected(rows, min_docs, keep_first)))


def test_odd_rows_and_clashing_names(odd_wide, none):
    marked, n_lines, n_dropped, keep = lines.keep_bitmaps(odd_wide, min_docs=2)
    assert (n_lines, n_dropped, keep) == ("_n_lines", "n_dropped", "_keep")
    assert marked.columns[: len(odd_wide.columns)] == odd_wide.columns
    assert marked.count() == odd_wide.count()
    assert lines.keep_bitmaps(none)[0].count() == 0


def test_min_chars_counts_code_points(spark):
    rows = [(i, "äö\nabc") for i in range(3)]
    assert {t for _, t, _, _ in kept(spark, rows, min_docs=2, min_chars=3)} == {"äö"}


def test_only_hashes_and_answers_are_shuffled(odd, explain):
    plan = explain(lines.keep_bitmaps(odd, min_docs=2)[0])
    assert "ShuffledHashJoin" in plan or "BroadcastHashJoin" in plan
    assert plan.count("Exchange") <= 2  # the drops, to their chunks


def test_query_matches_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = {tuple(r) for r in queries.op4_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()}
    assert got == set(duckdb.sql(queries.ORACLE_SQL["op4_line_dedup"]).fetchall())
    text = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") == 0).first()["text"]
    assert (0, text.count("\n") + 1, 0, hashlib.sha256(text.encode()).hexdigest()) in got
