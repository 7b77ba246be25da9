import numpy as np
import pytest

from vecatlas.llm import classifier, queries


def labelled(words, n=240):
    good = [(i, words(i, 80), 1) for i in range(n)]
    bad = [(1000 + i, words(5000 + i, 60).replace(" ", "!! ").upper(), 0) for i in range(n // 3)]
    return good + bad


def test_learns_and_scores(spark, words):
    rows = labelled(words)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = classifier.train(docs, labels, "quality")
    new = [(1, words(9001, 70)), (2, words(9002, 70).upper().replace(" ", "!! ")), (3, None), (3, ""), (None, words(9003, 50))]
    got = {(r["doc_id"], r["score"]) for r in classifier.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    by = dict(got)
    assert by[1] > 0.8 and by[2] < 0.3 and by[None] > 0.8 and len([x for x in got if x[0] == 3]) == 1
    assert all(0 <= s <= 1 for _, s in got)


def test_held_out_labels_are_not_learned(spark, words):
    import zlib

    rows = labelled(words, 90)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = [(i, y) for i, _, y in rows]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    models = [classifier.train(docs, spark.createDataFrame(x, "doc_id long, quality int"), "quality") for x in (labels, turned)]
    assert models[0] == models[1]


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (2, 3)], [(1, 0), (1, 1), (2, 0)]])
def test_few_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (2, "d e f")], "doc_id long, text string")
    model = classifier.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), "quality")
    scores = [r["score"] for r in classifier.score(docs, model).collect()]
    assert len(scores) == 3 and all(0 <= s <= 1 for s in scores)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 14)], "doc_id long, quality int")
    model = classifier.train(odd, labels, "quality")
    assert classifier.score(odd, model).count() == odd.count() and classifier.score(none, model).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    """Against subgradient descent on the primal, on few dimensions."""
    pick = np.random.default_rng(2)
    rows = [np.sort(pick.choice(40, 6, replace=False)).astype(np.int32) for _ in range(120)]
    labels = np.array([int((r < 15).sum() + pick.normal(0, 0.7) > 2) for r in rows])
    ratio = np.zeros(classifier.DIMENSIONS + 1, np.float32)
    ratio[:40] = pick.normal(0, 1, 40)
    xs = np.zeros((120, 40))
    for i, r in enumerate(rows):
        xs[i, r] = classifier.scaled(r, ratio)
    bound = 0.5 / (np.bincount(labels) / 120)[labels]
    y = 2 * labels - 1
    value = lambda w: 0.5 * w @ w + (bound * np.maximum(0, 1 - y * (xs @ w))).sum()
    w = classifier.fit_margin(rows, labels, ratio, epochs=400)[:40]
    best, v = np.zeros(40), np.zeros(40)
    for t in range(1, 30_000):
        v = v - (v - ((bound * y)[:, None] * xs * ((y * (xs @ v)) < 1)[:, None]).sum(0)) / t
        best = v if value(v) < value(best) else best
    assert value(w) <= value(best) * 1.001


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_quality_classifier(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    own = got.join(labels, how="inner")
    own = own[own.held_out]
    good, bad = own[own.quality == 1].score, own[own.quality == 0].score
    assert (good.values[:, None] > bad.values[None, :]).mean() > 0.9
    assert (own.predicted == own.quality).mean() > 0.9
