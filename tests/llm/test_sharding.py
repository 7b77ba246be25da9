import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vecatlas.llm import queries, sharding


def place(spark, keys, shards=4, **options):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, h1 long").withColumn("h2", F.col("h1"))
    got = sharding.shard_by_groups(*sharding.numbered(rows), ["h1", "h2"], shards, **options)[0].collect()
    assert sorted(r["id"] for r in got) == list(range(len(keys)))
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(by[s]) == list(range(len(by[s]))) for s in by)
    groups = defaultdict(Counter)
    for r in got:
        if r["h1"] is not None:
            groups[r["h1"]][r["shard"]] += 1
    return groups


def test_groups_stay_together(spark):
    keys = [i // 3 for i in range(300)] + [1000 + i for i in range(300)]
    assert all(len(c) == 1 for c in place(spark, keys).values())


def test_a_hot_group_fills_few_shards(spark):
    """A group of a third of the rows is larger than a shard; it takes as many shards as it must, or one more."""
    keys = [7] * 400 + [10 + i // 2 for i in range(200)] + [1000 + i for i in range(600)]
    groups = place(spark, keys, shards=8)
    assert len(groups[7]) <= 4
    assert sum(len(c) > 1 for k, c in groups.items() if k != 7) <= 16  # the last pass cuts two groups a shard at most


def test_only_groups_one_shard_and_nothing(spark):
    assert place(spark, [1] * 7, shards=3)
    assert place(spark, [i % 2 for i in range(9)], shards=1)
    assert not place(spark, [None] * 5, shards=2)
    rows = spark.createDataFrame([], "id long, h1 long, h2 long")
    placed = sharding.shard_by_groups(*sharding.numbered(rows), ["h1", "h2"], 3)[0]
    assert placed.count() == 0 and tuple(sharding.cut_edges(placed, ["h1", "h2"]).first()) == (0, 0)


def test_odd_rows_and_clashing_names(odd):
    """Null texts are not linked, empty and equal ones are; repeated rows and missing ids are placed one by one."""
    wide = odd.select("doc_id", F.col("text").alias("grp"), F.lit(1).alias("node"), F.lit("x").alias("Shard"), F.lit(2).alias("slot"),
                      F.lit(3).alias("n"), F.lit(4).alias("key0"))
    placed, shard, slot = sharding.shard_by_groups(*sharding.numbered(wide), ["grp"], 3)
    assert (shard, slot) == ("_shard", "_slot") and placed.columns == [*wide.columns, "_node", shard, slot]
    got = placed.collect()
    assert sorted(map(str, (r[: len(wide.columns)] for r in got))) == sorted(map(str, (tuple(r) for r in wide.collect())))
    sizes = Counter(r[shard] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r[shard], r[slot]) for r in got) == [(s, i) for s in sorted(sizes) for i in range(sizes[s])]
    shards, texts = ({i: r[name] for i, r in enumerate(got)} for name in (shard, "grp"))
    assert tuple(sharding.cut_edges(placed, ["grp"], shard).first()) == pairs_cut(shards, texts)


def pairs_cut(shard_of, group_of):
    """Edges and cut edges, pair by pair."""
    linked = [(a, b) for a, b in itertools.combinations(sorted(group_of), 2) if group_of[a] is not None and group_of[a] == group_of[b]]
    return len(linked), sum(shard_of[a] != shard_of[b] for a, b in linked)


def serial(group_of, shards):
    """Plain balanced label propagation, a node at a time: to the shard of most neighbours that has room."""
    nodes, loads = sorted(group_of), Counter()
    room = -(-len(nodes) // shards)
    shard_of = {v: i % shards for i, v in enumerate(nodes)}
    loads.update(shard_of.values())
    for _ in range(16):
        for v in nodes:
            near = Counter(shard_of[u] for u in nodes if u != v and group_of[v] is not None and group_of[u] == group_of[v])
            best = max(range(shards), key=lambda s: (near[s], s == shard_of[v]))
            if best == shard_of[v] or near[best] <= near[shard_of[v]]:
                continue
            if loads[best] >= room:  # a node without links makes room
                idle = next((u for u in nodes if shard_of[u] == best and group_of[u] is None), None)
                if idle is None:
                    continue
                shard_of[idle] = shard_of[v]
            else:
                loads[best] += 1
                loads[shard_of[v]] -= 1
            shard_of[v] = best
    return shard_of


def test_cut_edges_against_serial_propagation(spark):
    pick = random.Random(3)
    group_of = {i: None if i >= 160 else pick.choice([1, 1, 2, *range(3, 40)]) for i in range(240)}
    rows = spark.createDataFrame(list(group_of.items()), "id long, site long")
    placed, shard, _ = sharding.shard_by_groups(*sharding.numbered(rows), ["site"], 4)
    shard_of = {r["id"]: r[shard] for r in placed.collect()}
    edges, cut = pairs_cut(shard_of, group_of)
    assert tuple(sharding.cut_edges(placed, ["site"], shard).first()) == (edges, cut)
    assert cut <= pairs_cut(serial(group_of, 4), group_of)[1]


def test_linked_by_several_groups(spark):
    """General links: two cliques joined by one node end on a shard each."""
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node long")
    links = [(i, 0) for i in range(10)] + [(i, 1) for i in range(10)] + [(i, 2) for i in range(9, 20)]
    got = sharding.propagate(nodes, spark.createDataFrame(links, "node long, grp long"), 2).collect()
    shard = {r["node"]: r["shard"] for r in got}
    assert len({shard[i] for i in range(9)}) == 1 and len({shard[i] for i in range(10, 20)}) == 1


def test_query(spark):
    got = queries.op1_label_propagation(spark, "/root/testdata/sf0.001").toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(rows) and set(got["law"]) == {"rows"}
    sizes = got.groupby("shard").size()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    assert (got.set_index("doc_id")["size"].sort_index() == rows.text.map(lambda t: len(t.encode()) + 1).sort_index()).all()
    got["text"] = rows.text.loc[got.doc_id].values
    assert (got.groupby("text").shard.nunique() == 1).all()


@pytest.mark.parametrize("loads, idle", [([50, 0], [10, 0]), ([10, 10], [10, 10])])
def test_grants_respect_the_quota(loads, idle):
    demand = [{"shard": 1, "to": 0, "size": 2, "n": 30}]
    granted, leave, spare = sharding._grants(demand, loads, idle, 30.0)
    taken = granted[1, 0, 2] * 30
    assert 0 <= taken <= max(0, 30 - loads[0] + idle[0])
    assert all(0 <= x <= 1 for x in [*leave, *spare])
