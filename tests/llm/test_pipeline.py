"""Each stage against brute force on its own input."""

import base64

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from vecatlas.llm import queries
from vecatlas.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs.columns, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out.append((name, docs.columns, docs.collect()))
    return out


def test_columns(stages):
    assert [name for name, _, _ in stages[1:]] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    assert all(columns == stages[0][1] for _, columns, _ in stages[:-1])


def test_quality_rules(stages, spark):
    kept = {r["doc_id"] for r in stages[1][2]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in stages[0][2]:
        if len(r["text"].encode().split()) < 50:
            assert r["doc_id"] not in kept
    judged = [r["doc_id"] for r in stages[0][2] if labels.get(r["doc_id"]) == 1 and len(r["text"].encode().split()) >= 50]
    assert all(d in kept for d in judged)


def test_line_dedup(stages):
    from collections import defaultdict

    docs = defaultdict(set)
    for r in stages[1][2]:
        for line in r["text"].split("\n"):
            docs[line.strip(" \t\n\x0b\x0c\r").lower()].add(r["doc_id"])
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not (k := x.strip(" \t\n\x0b\x0c\r").lower()) or len(docs[k]) < 10)
            for r in stages[1][2]}
    assert {r["doc_id"]: r["text"] for r in stages[2][2]} == want


def test_near_dedup(stages):
    def shingles(text):
        ws = text.encode().lower().split()
        return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()

    sets = {r["doc_id"]: shingles(r["text"]) for r in stages[2][2]}
    least = {d: d for d in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            union = len(sets[a] | sets[b])
            if not union or len(sets[a] & sets[b]) >= 0.8 * union:
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in stages[3][2]) == [d for d in ids if root(d) == d]


def test_decontamination(stages, spark):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in stages[4][2]}
    for r in stages[3][2]:
        held = [i for i in items if i in r["text"]]
        if held:
            assert r["doc_id"] not in left
        elif r["doc_id"] not in left:  # a large part of an item, word for word
            low = " ".join(r["text"].lower().split())
            assert any(" ".join(w[k : k + 8]) in low for w in (i.lower().split() for i in items) for k in range(len(w) - 7))


def test_tokens(stages):
    with open(public_tokenizers.path(queries.TOKENIZER), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in stages[4][2]}
    assert {r["doc_id"]: r["ids"] for r in stages[5][2]} == {d: enc.encode_ordinary(t) for d, t in texts.items()}


def test_run_is_the_stages(spark, stages):
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in stages[-1][2])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_and_empty_inputs(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, chunk long"
    rows = [(1, None, None, "s", 1, "k", 1), (1, None, None, "s", 1, "k", 1), (None, "", "en", None, None, None, None),
            (2, "word " * 200, "en", "s", 0, "k", 2), (3, "x" * 5000, "de", "s", 0, "k", 3)]
    assert stage(spark, spark.createDataFrame(rows, schema), SF).columns[:7] == [x.split()[0] for x in schema.split(", ")]
    stage(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0


def test_run_leaves_no_chunks(spark):
    from vecatlas.llm.tables import chunk_tables

    before = chunk_tables(spark)
    corpus_pipeline.run(spark, SF).collect()
    assert chunk_tables(spark) == before
