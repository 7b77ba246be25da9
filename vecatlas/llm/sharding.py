"""Sharding by balanced label propagation.

Documents that share a group (equal texts, a site, a cluster) are neighbours. Every document starts on a shard by
hash; in each round linked documents ask to move to the shard where most of their neighbours are, and shards
grant moves up to a quota, largest gains first, sending documents without links elsewhere to make room. A group
larger than a shard fills one shard after the other. The quota is the mean load, and ``SLACK`` of it; a last pass
moves just so many documents (without links first) that counts differ by one at most, and numbers each shard.

Groups are counted per shard with partial sums, never gathered: a group of a third of all documents is as many
count rows as there are shards, and its members meet those rows in an equi join that adaptive execution may
split. The driver sees sums by pair of shards and size of gain.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.tables import free_name
from vecatlas.operators.ranking import row_index
from vecatlas.session import materialize, small_table

SLACK = 0.0
ROUNDS = 16


def _chance(round_: int, of: Column | None = None) -> Column:
    """A number in [0, 1) for each node (or other value), another one in each round."""
    return F.pmod(F.xxhash64(F.col("node") if of is None else of, F.lit(round_)), F.lit(1 << 30)) / float(1 << 30)


def _wishes(labels: DataFrame, links: DataFrame, open_shards: list[int]) -> DataFrame:
    """(node, shard, to, gain): where a node's neighbours are mostly, among its own and the open shards.

    Equal counts are decided by a hash of group and shard, the same for all members, so that a group split
    evenly does not swap places for ever.
    """
    placed = links.join(labels, "node")
    counts = placed.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("grp").agg(F.collect_list(F.struct("shard", "n")).alias("counts"))  # a row per shard at most
    votes = placed.join(counts, "grp").select("node", "shard", "grp", F.explode("counts").alias("c"))
    votes = votes.groupBy("node", "shard", F.col("c.shard").alias("to")).agg(
        F.sum("c.n").alias("n"), F.min(F.xxhash64("grp", "c.shard")).alias("tie"))
    may = F.col("to").isin(open_shards) | (F.col("to") == F.col("shard"))
    best = votes.where(may).groupBy("node", "shard").agg(
        F.max(F.struct("n", "tie", "to")).alias("best"), F.max(F.when(F.col("to") == F.col("shard"), F.col("n"))).alias("own"))
    return best.where(F.col("best.to") != F.col("shard")).select(
        "node", "shard", F.col("best.to").alias("to"), (F.col("best.n") - F.col("own")).alias("gain"))


def _grants(demand: list, loads: list[int], idle: list[int], quota: float) -> tuple[dict, list[float], list[float]]:
    """Shares of each (shard, to, size of gain) that may move, and of each shard's idle nodes that must leave.

    The third value is each shard's share of those that leave.
    """
    shards = len(loads)
    after = [float(x) for x in loads]
    granted = {}
    by_target = defaultdict(list)
    for r in demand:
        by_target[r["to"]].append(r)
    for to, rows in by_target.items():
        room = max(0.0, quota - loads[to] + idle[to])
        for r in sorted(rows, key=lambda r: (-r["size"], r["shard"])):
            take = min(room, r["n"])
            granted[r["shard"], to, r["size"]] = take / r["n"]
            room -= take
            after[to] += take
            after[r["shard"]] -= take
    leave = [min(idle[s], max(0.0, after[s] - quota)) for s in range(shards)]
    spare = [max(0.0, quota - after[s]) for s in range(shards)]
    total = sum(spare) or 1.0
    return granted, [x / i if i else 0.0 for x, i in zip(leave, idle)], [x / total for x in spare]


def propagate(nodes: DataFrame, links: DataFrame, shards: int, slack: float = SLACK, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard, grp, size) with loads up to about (1 + slack) of the mean.

    ``grp`` is a node's first group and ``size`` that group's members, null for nodes without links.

    ``nodes`` has unique longs; ``links`` (node, grp) has groups of two members or more.
    """
    spark = nodes.sparkSession
    sizes = materialize(links.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "sizes")  # so that joins with it may be split
    first = links.join(sizes, "grp").groupBy("node").agg(F.min(F.struct("grp", "size")).alias("g")).select("node", "g.grp", "g.size")
    labels = nodes.select("node").join(first, "node", "left").withColumn(
        "shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    labels = materialize(labels, "labels")
    for round_ in range(rounds):
        held = {r["shard"]: r for r in labels.groupBy("shard").agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("grp").isNull(), 1)).alias("idle")).collect()}
        loads, idle = ([held[s][k] if s in held else 0 for s in range(shards)] for k in ("n", "idle"))
        quota = (1 + slack) * sum(loads) / shards
        least = max(1.0, quota / 1000)
        open_shards = [s for s in range(shards) if quota - loads[s] + idle[s] >= least]
        wishes = materialize(_wishes(labels.select("node", "shard"), links, open_shards), "wishes")
        size = F.floor(F.log2(F.col("gain") + 1)).cast("int")
        demand = wishes.groupBy("shard", "to", size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
        if not demand:
            break
        granted, leave, spare = _grants(demand, loads, idle, quota)
        keys = list(granted)
        table = small_table(spark, {"shard": [k[0] for k in keys], "to": [k[1] for k in keys], "size": [k[2] for k in keys],
                                    "share": [granted[k] for k in keys]}, "shard int, to int, size int, share double")
        moves = wishes.withColumn("size", size).join(F.broadcast(table), ["shard", "to", "size"])  # as many rows as ``demand``
        moves = moves.select("node", "to", "share")
        unit = F.when(F.col("size") * 20 <= quota, F.col("grp")).otherwise(F.col("node"))  # small groups move as a whole
        granted_to = F.when(_chance(round_, unit) < F.col("share"), F.col("to"))
        edges = [sum(spare[: s + 1]) for s in range(shards - 1)]
        other = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= _chance(-1 - round_))) if edges else F.lit(0)
        goes = F.col("grp").isNull() & (_chance(round_) < F.element_at(F.array(*map(F.lit, leave)), F.col("shard") + 1))
        labels = labels.join(moves, "node", "left").select(
            "node", "grp", "size", F.coalesce(granted_to, F.when(goes, other).otherwise(F.col("shard"))).cast("int").alias("shard"))
        labels = materialize(labels, "labels")
    return labels


def even_out(labels: DataFrame, shards: int) -> DataFrame:
    """(node, shard, slot): counts at most one apart, slots from 0 without gaps.

    Nodes without links move first, then small groups, each as a whole where it fits.
    """
    ordered = labels.withColumn("tied", F.col("grp").isNotNull())
    indexed, n = row_index(ordered, ["shard", "tied", "size", "grp", "node"], "place")
    held = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    loads = [held.get(s, 0) for s in range(shards)]
    targets = [n // shards + (s < n % shards) for s in range(shards)]
    surplus = [max(0, a - b) for a, b in zip(loads, targets)]
    lack = [max(0, b - a) for a, b in zip(loads, targets)]
    before = lambda xs: [sum(xs[:i]) for i in range(len(xs))]
    of = lambda xs, at: F.element_at(F.array(*(F.lit(x).cast("long") for x in xs)), at + 1)
    rank = F.col("place") - of(before(loads), F.col("shard"))
    out = indexed.withColumn("rank", rank).withColumn("moves", F.col("rank") < of(surplus, F.col("shard")))
    out = out.withColumn("turn", of(before(surplus), F.col("shard")) + F.col("rank"))
    ends = [sum(lack[: i + 1]) for i in range(shards)]
    to = F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in ends)), lambda e: e <= F.col("turn")))
    out = out.withColumn("to", F.when(F.col("moves"), to).otherwise(F.col("shard")).cast("int"))
    slot = F.when(F.col("moves"), of(loads, F.col("to")) + F.col("turn") - of(before(lack), F.col("to"))).otherwise(
        F.col("rank") - of(surplus, F.col("shard")))
    return out.select("node", F.col("to").alias("shard"), slot.alias("slot"))


def shard_by_groups(rows: DataFrame, node: str, keys: list[str], shards: int, rounds: int = ROUNDS) -> tuple[DataFrame, str, str]:
    """``rows`` with a shard and a slot; rows with equal keys are linked. Also returns the two columns' names.

    ``node`` names a column of unique longs, as ``numbered`` adds it. Rows with a null among their keys have no
    links and go where there is room; empty strings are keys like any other. Repeated rows are placed one by
    one. An empty table stays empty.
    """
    shard, slot = (free_name(x, rows.columns) for x in ("shard", "slot"))
    links = _links(rows, node, keys)
    groups = materialize(links.groupBy(*_keys(keys)).agg(F.min("node").alias("grp"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
                         "groups")
    links = materialize(links.join(groups, _keys(keys)).select("node", "grp"), "links")
    placed = even_out(propagate(rows.select(F.col(node).alias("node")), links, shards, rounds=rounds), shards)
    return rows.join(placed.toDF(node, shard, slot), node).select(*rows.columns, shard, slot), shard, slot


def _keys(keys: list[str]) -> list[str]:
    return [f"key{i}" for i in range(len(keys))]


def _links(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    return rows.select(F.col(node).alias("node"), *(F.col(k).alias(n) for k, n in zip(keys, _keys(keys)))).dropna()


def cut_edges(placed: DataFrame, keys: list[str], shard: str = "shard") -> DataFrame:
    """One row (edges, cut): pairs of rows with equal keys, and how many of them lie on different shards.

    Counted from sizes per group and shard; no pair becomes a row. Decimals, as a group's pairs grow with its square.
    """
    pairs = lambda n: n * (n - 1) / 2
    held = _links(placed, shard, keys).groupBy("node", *_keys(keys)).agg(F.count(F.lit(1)).cast("decimal(18,0)").alias("n"))
    groups = held.groupBy(*_keys(keys)).agg(F.sum("n").cast("decimal(18,0)").alias("n"), F.sum(pairs(F.col("n"))).alias("inside"))
    edges, inside = (F.coalesce(F.sum(x), F.lit(0)).cast("decimal(38,0)") for x in (pairs(F.col("n")), F.col("inside")))
    return groups.agg(edges.alias("edges"), (edges - inside).cast("decimal(38,0)").alias("cut"))


def numbered(rows: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written once, with a column of unique longs (repeated rows and missing ids stay apart), and its name."""
    node = free_name("node", rows.columns)
    return materialize(rows.withColumn(node, F.monotonically_increasing_id()), "nodes"), node
