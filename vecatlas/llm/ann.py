"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by ``HASHES`` random projections, cut into cells of one width: the cells' numbers are its bucket. A
query visits, in each table, its own bucket and those with a projection one cell up or down, in the order of the
estimated probability that a neighbour lies there, until these probabilities add up to the table's share of ``TARGET``.
Whatever shares a visited bucket is compared exactly (double precision, on the original vectors), and the
tables' hits are merged.

The estimates are fitted on a bounded sample: ``SAMPLE`` vectors (by hash of id and vector) find their exact neighbours among all
rows, and what lies between a projection of a vector and its neighbours' gives the cells' width, how far
neighbours are drawn to the mean, and how widely they are spread (a mixture of ``SCALES`` normal distributions, as some vectors
have closer neighbours than others). All rows are indexed. Vectors without structure have their neighbours nearly everywhere,
so that a search for nearly all of them visits most buckets: on the given tables recall@10 is 0.97 for 90 % of
the rows, on clustered ones 0.95 for 4 %.

Buckets of a table are dealt to groups of about ``BLOCK`` rows; a group with more (a hot bucket, such as copies of one vector) is
dealt out anew by row, and a query goes to all parts. A task holds one part's vectors and streams the queries that visit it,
so pairs become no rows and the number of queries has no bound; a query comes to a part once, with all buckets
it visits there. A query with fewer hits than asked for is compared with all rows, so there is no cap anywhere.

Vectors that are null, empty, zero, or hold null, NaN or infinite entries take no part, nor those of another length than the
common one, nor rows without an id. Rows with one id and different vectors all stand for that id, and their nearest counts; as a
query, an id asks with its least vector, and none of its own rows is an answer. Equal distances are ordered by id. A
table without other rows gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.llm.tables import partitions, small_batches
from vecatlas.llm.vectors import common_length, complete, matrix
from vecatlas.operators.topk import topk_search
from vecatlas.session import materialize

TABLES, HASHES, WIDTH, TARGET = 2, 6, 2.5, 0.98
SAMPLE, SCALES, BLOCK, SEED = 256, 8, 8192, 11
_QUERIES = 128


@dataclass(frozen=True)
class HashModel:
    """Projections (rows of ``planes``), their cells, and how neighbours are spread around a query's projections."""

    planes: np.ndarray
    shift: np.ndarray
    width: float
    mean: np.ndarray
    pull: float
    scales: np.ndarray
    groups: int
    target: float

    @property
    def dim(self) -> int:
        return self.planes.shape[1]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """Where the projections lie, in cells."""
        return vectors @ self.planes.T / self.width + self.shift

    def buckets(self, cells: np.ndarray) -> np.ndarray:
        """Bucket numbers of whole cells, one per table (rows x tables)."""
        return np.stack([_bucket(cells[:, t * HASHES : (t + 1) * HASHES], t) for t in range(TABLES)], axis=1)

    def visits(self, vector: np.ndarray) -> list[np.ndarray]:
        """The buckets that a query visits in each table, likeliest first."""
        at = self.cells(vector[None])[0]
        own = np.floor(at)
        middle = self.cells((self.mean + self.pull * (vector - self.mean))[None])[0]
        edges = own[None] + np.arange(-1, 3)[:, None] - middle[None]
        share = 1 - (1 - self.target) ** (1 / TABLES)
        out = []
        for t in range(TABLES):
            cut = slice(t * HASHES, (t + 1) * HASHES)
            likely = np.zeros(len(_STEPS))
            for scale in self.scales:
                inside = np.diff(_normal(edges[:, cut] * (self.width / scale)), axis=0)
                joint = np.ones(1)
                for i in range(HASHES):
                    joint = (joint[:, None] * inside[:, i][None]).ravel()
                likely += joint / len(self.scales)
            order = np.argsort(-likely, kind="stable")
            enough = np.searchsorted(np.cumsum(likely[order]), share) + 1
            out.append(_bucket(own[cut] + _STEPS[order[:enough]], t))
        return out


#: All ways of staying or going one cell up or down, the first projection slowest.
_STEPS = np.array(list(product((-1, 0, 1), repeat=HASHES)), np.float64)
_GRID = np.linspace(-9, 9, 18_001)
_CDF = np.array([NormalDist().cdf(x) for x in _GRID])


def _normal(x: np.ndarray) -> np.ndarray:
    return np.interp(x, _GRID, _CDF)


def _bucket(cells: np.ndarray, table: int) -> np.ndarray:
    """A hash of the cells' numbers."""
    mixed = np.full(len(cells), 0x9E3779B97F4A7C15 + table, np.uint64)
    for column in np.floor(cells).T.astype(np.int64):
        mixed = (mixed ^ column.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    known = rows.where(complete(F.col(vector)) & F.exists(vector, lambda x: x != 0) & F.col(vec_id).isNotNull())
    kind = rows.schema[vector].dataType.simpleString()  # single precision travels as such, and is compared in double
    v = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
    known = known.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    return known.where(F.size("v") == common_length(known, "v"))


def fit(points: DataFrame, k: int = 10, sample: int = SAMPLE, block: int = BLOCK, target: float = TARGET) -> HashModel | None:
    """The model for a table of ``usable`` rows; None for an empty one. The driver sees ``sample`` * (k + 1) vectors."""
    n = points.count()
    asked = points.orderBy(F.xxhash64("vec_id", "v")).limit(sample).toArrow()
    if not n:
        return None
    spark, dim = points.sparkSession, len(asked.column("v")[0])
    pick = np.random.default_rng(SEED)
    planes, shift = pick.normal(size=(TABLES * HASHES, dim)), pick.uniform(size=TABLES * HASHES)
    own = matrix(asked.column("v").combine_chunks(), dim)
    mean = own.mean(axis=0)
    queries = spark.createDataFrame(pa.table({"query_id": pa.array(np.arange(len(own))), "embedding": asked.column("v")}))
    hits = topk_search(points.select(F.col("vec_id").alias("slot"), F.col("v").alias("embedding")), queries, k + 1, "l2")
    near = F.broadcast(hits.select("query_id", "slot").distinct())  # at most sample * (k + 1) rows
    near = near.join(points.withColumnRenamed("vec_id", "slot"), "slot").groupBy("query_id", "slot").agg(F.min("v").alias("v"))
    near = near.select("query_id", "slot", "v").toArrow()
    of, found = near.column("query_id").to_numpy(), matrix(near.column("v").combine_chunks(), dim)
    others = (found != own[of]).any(axis=1)  # a vector and its copies share all buckets and tell nothing
    of, found = of[others], (found[others] - mean) @ planes.T
    asking = ((own - mean) @ planes.T)[of]
    pull = float((asking * found).sum() / max((asking * asking).sum(), 1e-300)) if len(of) else 1.0
    left = ((found - pull * asking) ** 2).mean(axis=1)
    spread = np.sqrt(np.bincount(of, left) / np.maximum(np.bincount(of), 1))[np.unique(of)] if len(of) else np.zeros(1)
    least = 1e-6 * float(np.abs(own).max())
    scales = np.maximum(np.quantile(spread, (np.arange(SCALES) + 0.5) / SCALES), least)
    width = WIDTH * max(float(np.quantile(spread, 0.9)), least)
    return HashModel(planes, shift, width, mean, pull, scales, max(1, -(-n // block)), target)


def index(points: DataFrame, model: HashModel) -> DataFrame:
    """(tab, grp, turn, bucket, vec_id, v): every row once per table; ``turn`` deals the rows of a group out evenly."""
    def run(batches):
        for batch in batches:
            vectors = matrix(batch.column(1), model.dim)
            found = model.buckets(model.cells(vectors))
            for t in range(TABLES):
                n = len(vectors)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, t, np.int32)), pa.array(found[:, t] % model.groups), batch.column(2), pa.array(found[:, t]), batch.column(0), batch.column(1)],
                    names=["tab", "grp", "turn", "bucket", "vec_id", "v"])

    small_batches(points.sparkSession)
    dealt = points.select("vec_id", "v", F.monotonically_increasing_id().alias("turn"))
    return dealt.mapInArrow(run, f"tab int, grp long, turn long, bucket long, vec_id long, v {_kind(points)}")


def _kind(rows: DataFrame) -> str:
    return rows.schema["v"].dataType.simpleString()


def _probes(queries: DataFrame, model: HashModel) -> DataFrame:
    """(tab, grp, vec_id, v, buckets): once for each table and group where the query visits buckets."""
    def run(batches):
        for batch in batches:
            out = {name: [] for name in ("tab", "grp", "at", "buckets")}
            for at, vector in enumerate(matrix(batch.column(1), model.dim)):
                for t, found in enumerate(model.visits(vector)):
                    for group in np.unique(found % model.groups).tolist():
                        for name, value in zip(out, (t, group, at, found[found % model.groups == group])):
                            out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["tab"], pa.int32()), pa.array(out["grp"], pa.int64()), *(c.take(pa.array(out["at"], pa.int64())) for c in batch.columns),
                 pa.array(out["buckets"], pa.list_(pa.int64()))], names=["tab", "grp", "vec_id", "v", "buckets"])

    return queries.mapInArrow(run, f"tab int, grp long, vec_id long, v {_kind(queries)}, buckets array<long>")


def _nearest(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, may: np.ndarray, k: int):
    """(query, row, distance) of each query's k nearest rows among those it may meet, and all ties with the last one."""
    reach = (queries * queries).sum(axis=1)[:, None] + (rows * rows).sum(axis=1)
    rough = np.where(may & (ids[:, None] != row_ids[None]), reach - 2 * (queries @ rows.T), np.inf)
    if rough.shape[1] > k:
        worst = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
    else:
        worst = np.full((len(queries), 1), np.inf)
    # The rough distance is off by much less than this.
    q, r = np.nonzero((rough <= worst + 1e-9 * reach) & (rough < np.inf))
    exact = np.empty(len(q))
    for lo in range(0, len(q), 1 << 16):
        cut = slice(lo, lo + (1 << 16))
        exact[cut] = np.sqrt(((queries[q[cut]] - rows[r[cut]]) ** 2).sum(axis=1))
    order = np.lexsort((row_ids[r], exact, q))
    q, r, exact = q[order], r[order], exact[order]
    again = np.zeros(len(q), bool)  # one id counts once, with its nearest row
    by_id = np.lexsort((exact, row_ids[r], q))
    again[by_id[1:]] = (np.diff(q[by_id]) == 0) & (np.diff(row_ids[r][by_id]) == 0)
    q, r, exact = q[~again], r[~again], exact[~again]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], r[rank < k], exact[rank < k]


def _met(routed: DataFrame, k: int, dim: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest rows that each query meets in each part."""
    def run(batches):
        at, rows, held, waiting = None, None, [], []

        def answers():
            nonlocal rows, waiting
            if rows is None:
                if not held:
                    waiting = []
                    return None
                rows = [np.concatenate(x) for x in zip(*held)]
            vectors, ids, buckets = rows
            asked, waiting = waiting, []
            names, codes = np.unique(buckets, return_inverse=True)
            may = np.ones((len(asked), len(names)), bool)
            for i, (_, _, visited) in enumerate(asked):
                if visited is not None:
                    may[i] = np.isin(names, visited)
            may = may[:, codes]
            some = np.flatnonzero(may.any(axis=0))
            if not len(some):
                return None
            asked_ids = np.array([a[0] for a in asked], np.int64)
            q, r, exact = _nearest(np.stack([a[1] for a in asked]), asked_ids, vectors[some], ids[some], may[:, some], k)
            return pa.RecordBatch.from_arrays([pa.array(asked_ids[q]), pa.array(ids[some][r]), pa.array(exact)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            place = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            new = np.flatnonzero((np.diff(place, axis=0, prepend=place[:1] - 1) != 0).any(axis=1) | (np.diff(asks.astype(np.int8), prepend=2) != 0))
            for lo, hi in zip(new, [*new[1:], len(place)]):
                if at is None or (place[lo] != at).any():
                    if waiting and (made := answers()) is not None:
                        yield made
                    at, rows, held, waiting = place[lo], None, [], []
                part = batch.slice(lo, hi - lo)
                vectors, ids = matrix(part.column(5), dim), part.column(4).to_numpy()
                if asks[lo]:
                    for i, visited in enumerate(part.column(6)):
                        waiting.append((ids[i], vectors[i], visited.values.to_numpy() if visited.is_valid else None))
                        if len(waiting) == _QUERIES and (made := answers()) is not None:
                            yield made
                else:
                    held.append((vectors, ids, part.column(6).flatten().to_numpy()))
        if waiting and (made := answers()) is not None:
            yield made

    order = ["tab", "grp", "part", "query"]
    dealt = routed.repartition(partitions(routed.sparkSession), "tab", "grp", "part").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def search(points: DataFrame, asked: Column, k: int = 10, model: HashModel | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``points`` that ``asked`` picks."""
    spark = points.sparkSession
    model = model or fit(points, k, block=block)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = materialize(points.where(asked).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    rows = index(points, model)
    parts = materialize(rows.groupBy("tab", "grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * block)).cast("long").alias("parts")), "parts")
    held = rows.join(parts, ["tab", "grp"]).select(
        "tab", "grp", F.pmod("turn", "parts").alias("part"), F.lit(False).alias("query"), F.col("vec_id").alias("id"), "v", F.array("bucket").alias("buckets"))

    def met(routes: DataFrame, rows: DataFrame) -> DataFrame:
        sent = routes.join(parts, ["tab", "grp"]).select(
            "tab", "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("query"),
            F.col("vec_id").alias("id"), "v", "buckets")
        return _met(rows.unionByName(sent), k, model.dim)

    found = materialize(met(_probes(queries, model), held), "found")
    hits = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"))
    few = queries.join(hits.where(F.col("n") >= k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    few = materialize(few, "few")
    if not few.isEmpty():  # these are compared with all rows, by way of the first table
        everywhere = few.select(F.lit(0).alias("tab"), F.explode(F.sequence(*(F.lit(x).cast("long") for x in (0, model.groups - 1)))).alias("grp"), "vec_id", "v",
                                F.lit(None).cast("array<long>").alias("buckets"))
        found = found.unionByName(met(everywhere, held.where("tab = 0")))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of each row whose id ``every`` divides, among all other rows."""
    return search(usable(rows, vec_id, vector), F.pmod("vec_id", F.lit(every)) == 0, k)
