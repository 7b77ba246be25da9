import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vecatlas.llm import lm, queries


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def fold(doc):
    return 2 if doc is None else zlib.crc32(str(doc).encode()) % 10


def brute(rows):
    """(base score, model's score, tokens, known tokens) of each row, and the number of training tokens."""
    def counts(keep):
        single, pairs, context = Counter(), Counter(), Counter()
        for d, t in rows:
            if keep(fold(d)):
                before = "start"
                for w in tokens(t):
                    single[w] += 1
                    pairs[before, w] += 1
                    context[before] += 1
                    before = w
        return single, pairs, context

    single, pairs, context = counts(lambda f: f != 0)
    less, less_pairs, less_context = counts(lambda f: f > 1)
    n, m, v = sum(single.values()), sum(less.values()), len(single)
    step = lambda p: 1 if p <= 0 else int(np.round(4 * np.log2(p)))
    cells = Counter()
    for d, t in rows:
        if fold(d) == 1:
            before = "start"
            for w in tokens(t):
                c = less_context[before]
                cells[int(math.log2(c + 1)), step(less_pairs[before, w] / max(1, c)), step(less[w] / max(1, m))] += 1
                before = w
    weights = lm.learn_weights(np.array([(*k, x) for k, x in sorted(cells.items())], np.int64).reshape(-1, 4), 1 / (v + 1))
    out = []
    for d, t in rows:
        base = score = 0.0
        before = "start"
        for w in tokens(t):
            c = context[before]
            a, u, z = lm._weights_at(np.array([int(math.log2(c + 1))]), weights)[0]
            score += math.log10(a * pairs[before, w] / max(1, c) + u * single[w] / max(1, n) + z / (v + 1))
            base += math.log10((single[w] + 0.1) / (n + 0.1 * (v + 1)))
            before = w
        out.append((d, fold(d) == 0, len(tokens(t)), sum(single[w] > 0 for w in tokens(t)), n, base, score))
    return out


def check(spark, rows, got):
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 6), round(r[6], 6))
    want = sorted(brute(rows), key=key)
    got = sorted((tuple(r) for r in got), key=key)
    assert [w[:5] for w in want] == [g[:5] for g in got]
    assert [x for w in want for x in w[5:]] == pytest.approx([x for g in got for x in g[5:]], rel=1e-9, abs=1e-9)


def test_against_brute_force(spark, words):
    rows = [(i, words(i % 37, 20 + i % 11) + " the the of THE") for i in range(200)]
    rows += [(300, None), (301, ""), (302, " \n"), (None, words(3, 9)), (303, "x " * 500), (303, "x " * 500)]
    docs = spark.createDataFrame([(t, d, 1) for d, t in rows], "text string, doc_id long, fold int").repartition(3)
    check(spark, rows, lm.score(docs).collect())


def test_small_tables(spark, odd, none):
    assert lm.score(none).count() == 0
    check(spark, [(r["doc_id"], r["text"]) for r in odd.collect()], lm.score(odd).collect())
    held = next(i for i in range(100) if fold(i) == 0)
    row = lm.score(spark.createDataFrame([(held, "nothing learned")], "doc_id long, text string")).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == 0 and math.isfinite(row["score"])


def test_probabilities_add_up(spark):
    """Over all known words, the end and one unknown word, in a seen and an unseen context."""
    rows = [(i, "a b a c" if i % 2 else "b a d") for i in range(40)]
    weights = {-1: np.array([0.3, 0.6, 0.1]), 3: np.array([0.7, 0.2, 0.1])}
    single, pairs, context = Counter(), defaultdict(Counter), Counter()
    for d, t in rows:
        before = "start"
        for w in tokens(t):
            single[w] += 1
            pairs[before][w] += 1
            context[before] += 1
            before = w
    n, v = sum(single.values()), len(single)
    for before in ("start", b"a", b"unseen"):
        a, u, z = lm._weights_at(lm._bucket_of(np.array([context[before]])), weights)[0]
        total = sum(a * pairs[before][w] / max(1, context[before]) + u * single[w] / n + z / (v + 1) for w in [*single, "unknown"])
        assert total == pytest.approx(1)


def test_weights_follow_the_evidence():
    sure = np.array([(4, -1, -20, 900), (4, 1, -20, 100), (0, 1, -8, 500)])
    got = lm.learn_weights(sure, 1e-9)
    assert got[4][0] > 0.8 and got[0][1] > 0.9


def test_planes_round_trip():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm._unplane(lm._plane(values), len(values)) == values).all()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op5_deleted_interpolation(spark, sf).collect()
    check(spark, rows, got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
