import numpy as np
import pytest
from pyspark.sql import functions as F

from vecatlas.operators import cells
from vecatlas.operators.topk import topk_search
from vecatlas.plans.index import KeptIndex
from vecatlas.session import scratch_path
from vecatlas.sources.commitlog import CommitLog, deletes, puts

VECTORS = "slot long, path string, size long, embedding array<float>"


def rows(spark, vectors):
    return spark.createDataFrame([(s, f"/{s}", 1, v) for s, v in vectors.items()], VECTORS)


def found(hits):
    return sorted((r["query_id"], r["rank"], r["slot"]) for r in hits.collect())


@pytest.mark.parametrize("fold", [0.0, 10.0])
def test_the_index_follows_the_log(spark, fold, monkeypatch):
    pick = np.random.default_rng(4)
    vector = lambda: pick.normal(size=4).round(3).tolist()
    live = {s: vector() for s in range(80)}
    asked = spark.createDataFrame([(q, vector()) for q in range(9)], "query_id long, embedding array<float>")
    log = CommitLog(spark, scratch_path(spark, "atlas"))
    kept = KeptIndex(log, scratch_path(spark, "kept"), 6, "l2", fold)
    with pytest.raises(ValueError):
        kept.index()
    log.append(puts(rows(spark, live)), "c-0")
    kept.refresh()
    for n in range(2):
        new, gone = {s: vector() for s in (n, 100 + n, 50)}, [20 + n, 30 + n]
        # Slot 50 is deleted and taken again in one commit.
        log.append(deletes(rows(spark, {s: live[s] for s in (*gone, 50)})).unionByName(puts(rows(spark, new))), f"c-{n + 1}")
        live = {s: v for s, v in (live | new).items() if s not in gone}
        kept.refresh()
        want = topk_search(rows(spark, live), asked, 5, "l2")
        assert found(kept.search(asked, 5)) == found(want) == found(kept.search(asked, 5, nprobe=6))
    assert kept.refresh().vectors.count() == len(live)

    def forbidden(*_, **__):
        raise AssertionError("vectors are written")

    monkeypatch.setattr(cells, "build_cell_index", forbidden)
    monkeypatch.setattr("vecatlas.plans.index.build_cell_index", forbidden)
    assert len(found(kept.search(asked, 5))) == 45


def test_a_log_that_has_moved_on_is_indexed_anew(spark):
    log = CommitLog(spark, scratch_path(spark, "atlas"))
    kept = KeptIndex(log, scratch_path(spark, "kept"), 2)
    for n in range(4):
        log.append(puts(rows(spark, {n: [1.0, float(n)], 10 + n: [float(n), 1.0]})), f"c-{n}")
        if n % 2:
            log.compact()
        assert kept.refresh().vectors.count() == 2 * n + 2
    assert kept.refresh().vectors.filter(F.col("slot") == 13).count() == 1
