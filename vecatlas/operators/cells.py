"""Cell-partitioned nearest-neighbour search.

Vectors are grouped into the cells of a k-means quantizer and written with one Parquet partition per
cell. A query probes its nearest cells only (approximate), or every cell whose distance bound cannot
be excluded (exact). Both sides meet in blocks ``(cell, v_block, q_block)`` of bounded size: a cell
that holds a third of all vectors, or attracts a third of all queries, is cut into many blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.functions import vectors as V
from vecatlas.operators.sums import summed
from vecatlas.operators.topk import (
    RunningTopK,
    bounded_queries,
    hits_schema,
    rank_hits,
    to_matrix,
    unit_rows,
)
from vecatlas.session import materialize, scratch_path, small_table
from vecatlas.sources.storage import Storage

VECTORS_PER_BLOCK = 65_536
QUERIES_PER_BLOCK = 8_192
#: Beyond so many cells they are found in two steps: the nearest of about as many coarse centres as their square root, then
#: the nearest centre of that branch.
BRANCH = 1024
#: All centres are held by driver and tasks, within this bound.
MAX_CENTER_BYTES = 256 << 20
_CENTER_ROUNDS, _POINTS_PER_CELL, _BLOCK_CELLS = 4, 8, 4_000_000
MAX_DIRECT_QUERIES = 2_000
_SLACK = 1e-6
# Distances are rounded to a grid: of 1e-10 (cosine), or of the squared lengths' sum over 2^29 at most (L2).
_COSINE_STEP, _L2_STEP = 1e-10, 2.0**-28


_CHANGES = "slot long, embedding array<float>, reach double, cell int, seq long"


@dataclass
class CellIndex:
    """A written index: ``vectors/cell=*``, ``stats`` (one row per cell), ``centers`` and ``changes/seq=*``.

    Changes are small beside the index: the slots they name are dropped from the base on reading (Spark
    broadcasts them while they are few), and their latest vectors are read beside it.
    """

    path: str
    metric: str
    centers: np.ndarray
    spark: SparkSession
    tree: CenterTree | None = None

    def _changes(self) -> DataFrame | None:
        folder = f"{self.path}/changes"
        return self.spark.read.schema(_CHANGES).parquet(folder) if Storage(self.spark).exists(folder) else None

    @property
    def vectors(self) -> DataFrame:
        base, changes = self.spark.read.parquet(f"{self.path}/vectors"), self._changes()
        if changes is None:
            return base
        kept = base.join(changes.select("slot").distinct(), "slot", "left_anti")
        return kept.select("slot", "embedding", "reach", "cell").unionByName(_latest(changes))

    @property
    def stats(self) -> DataFrame:
        """Rows (at most) and radius of each cell."""
        base, changes = self.spark.read.parquet(f"{self.path}/stats"), self._changes()
        if changes is None:
            return base
        more = changes.filter("cell >= 0").groupBy("cell").agg(
            F.count(F.lit(1)).alias("rows"), F.max("reach").alias("radius"))
        return base.select("cell", "rows", "radius").unionByName(more).groupBy("cell").agg(
            F.sum("rows").alias("rows"), F.max("radius").alias("radius"))

    def apply(self, changes: DataFrame, seq: int) -> None:
        """Upsert ``changes(slot, embedding)``; a null embedding deletes. Applying a ``seq`` again rewrites it."""
        shared, metric = self.spark.sparkContext.broadcast((self.centers, self.tree)), self.metric
        known = changes.select(F.col("slot").cast("long").alias("slot"), "embedding")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from (_with_cells(metric, *shared.value, batch) for batch in batches)

        put = known.filter("embedding is not null").mapInArrow(assign, "slot long, embedding array<float>, reach double, cell int")
        gone = known.filter("embedding is null").select(
            "slot", "embedding", F.lit(0.0).alias("reach"), F.lit(-1).alias("cell"))
        put.unionByName(gone).write.mode("overwrite").parquet(f"{self.path}/changes/seq={seq}")

    def changed_share(self) -> float:
        """Changes beside the base, by its rows."""
        changes = self._changes()
        rows = self.spark.read.parquet(f"{self.path}/stats").agg(F.sum("rows")).first()[0] or 0
        return changes.count() / max(1, rows) if changes is not None else 0.0

    def fold(self) -> None:
        """Write the changes into the cells they touch; the other cells stay as they are.

        The changes go last: while they are there, they hide what the cells say about their slots.
        """
        changes = self._changes()
        if changes is None:
            return
        base, stats = self.spark.read.parquet(f"{self.path}/vectors"), f"{self.path}/stats"
        slots = changes.select("slot").distinct()
        old = base.join(slots, "slot", "left_semi").select("cell")
        touched = sorted(r["cell"] for r in old.unionByName(changes.filter("cell >= 0").select("cell")).distinct().collect())  # at most all cells
        kept = base.filter(F.col("cell").isin(touched)).join(slots, "slot", "left_anti").select("slot", "embedding", "reach", "cell")
        new = materialize(kept.unionByName(_latest(changes)), "cells")
        new.hint("rebalance", "cell").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{self.path}/vectors")
        counted = new.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("reach").alias("radius"))
        emptied = set(touched) - {r["cell"] for r in counted.select("cell").collect()}
        others = self.spark.read.parquet(stats).filter(~F.col("cell").isin(touched))
        materialize(others.select("cell", "rows", "radius").unionByName(counted.select("cell", "rows", "radius")), "stats").write.mode("overwrite").parquet(stats)
        for cell in emptied:
            Storage(self.spark).delete(f"{self.path}/vectors/cell={cell}")
        Storage(self.spark).delete(f"{self.path}/changes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        rows = spark.read.parquet(f"{path}/centers").orderBy("cell").collect()
        tree = None
        if Storage(spark).exists(f"{path}/coarse"):
            coarse = spark.read.parquet(f"{path}/coarse").orderBy("branch").collect()
            tree = CenterTree(np.array([r["center"] for r in coarse]), np.array([0, *(r["until"] for r in coarse)]))
        return cls(path, rows[0]["metric"], np.array([r["center"] for r in rows]), spark, tree)


def _latest(changes: DataFrame) -> DataFrame:
    """``slot, embedding, reach, cell`` of the slots' last changes, without deletes; in one change a put beats a delete."""
    newest = F.struct("seq", (F.col("cell") >= 0).alias("put"))
    last = changes.groupBy("slot").agg(F.max_by(F.struct("embedding", "reach", "cell"), newest).alias("c"))
    return last.select("slot", "c.*").filter("cell >= 0")


@dataclass(frozen=True)
class CenterTree:
    """Coarse centres; the cells of branch b are those from ``starts[b]`` to ``starts[b + 1]``."""

    coarse: np.ndarray
    starts: np.ndarray

    def nearest(self, points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        branch = center_distances(points, self.coarse).argmin(axis=1)
        cell, reach = np.zeros(len(points), np.int64), np.zeros(len(points))
        for b in np.unique(branch):
            at = np.flatnonzero(branch == b)
            far = center_distances(points[at], centers[self.starts[b] : self.starts[b + 1]])
            best = far.argmin(axis=1)
            cell[at], reach[at] = self.starts[b] + best, far[np.arange(len(at)), best]
        return cell, reach


def _nearest_center(metric: str, centers: np.ndarray, tree: CenterTree | None, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    matrix = to_matrix(batch.column("embedding"), centers.shape[1])
    if metric == "cosine":
        matrix = unit_rows(matrix)
    if tree is not None:
        return tree.nearest(matrix, centers)
    reach = center_distances(matrix, centers)
    cell = reach.argmin(axis=1)
    return cell, reach[np.arange(len(cell)), cell]


def _with_cells(metric: str, centers: np.ndarray, tree: CenterTree | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    cell, reach = _nearest_center(metric, centers, tree, batch)
    return pa.RecordBatch.from_arrays(
        [batch.column("slot"), batch.column("embedding"), pa.array(reach), pa.array(cell.astype(np.int32))],
        names=["slot", "embedding", "reach", "cell"],
    )


def center_distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    squares = (
        np.einsum("ij,ij->i", points, points)[:, None]
        + np.einsum("ij,ij->i", centers, centers)[None, :]
        - 2.0 * points @ centers.T
    )
    return np.sqrt(np.maximum(squares, 0.0))


def _trained_centers(known: DataFrame, cells: int, metric: str, seed: int) -> np.ndarray:
    direction = F.col("embedding")
    if metric == "cosine":
        direction = V.normalize(direction)
    training = known.select(direction.alias("v")).filter("v is not null")
    training = materialize(training.select(array_to_vector("v").alias("features")), "training")
    if training.isEmpty():
        raise ValueError("no vector to train the cells on")
    model = KMeans(k=cells, seed=seed, maxIter=8, initSteps=1).fit(training)
    return np.array(model.clusterCenters(), dtype=np.float64)


def _grown_tree(known: DataFrame, cells: int, metric: str, seed: int) -> tuple[np.ndarray, CenterTree]:
    """Centres in two steps: coarse ones by k-means, each with as many cells as its share of the rows.

    The cells of all branches are fitted at once: their first centres are rows of a bounded sample (by hash of slot), and in
    each round a task sends sums and counts per centre of all its rows.
    """
    coarse = _trained_centers(known, math.isqrt(cells - 1) + 1, metric, seed)
    dim = coarse.shape[1]

    def points(batch: pa.RecordBatch) -> np.ndarray:
        matrix = to_matrix(batch.column("embedding"), dim)
        return unit_rows(matrix) if metric == "cosine" else matrix

    def populations(batches):
        for batch in batches:
            yield 0, np.bincount(center_distances(points(batch), coarse).argmin(axis=1), minlength=len(coarse))

    vectors = known.select("embedding")
    shares = summed(vectors, (len(coarse),), np.int64, populations)[0]
    wanted = np.maximum(1, np.round(cells * shares / shares.sum())).astype(int)
    first = known.orderBy(F.xxhash64("slot"), "slot").limit(_POINTS_PER_CELL * cells).select("embedding").toArrow()
    sample = unit_rows(to_matrix(first.column("embedding"), dim)) if metric == "cosine" else to_matrix(first.column("embedding"), dim)
    branch = center_distances(sample, coarse).argmin(axis=1)
    groups = []
    for b, count in enumerate(wanted):
        own = np.unique(sample[branch == b], axis=0)
        groups.append(own[np.random.default_rng(seed + b).permutation(len(own))[:count]] if len(own) else coarse[b : b + 1])
    tree = CenterTree(coarse, np.cumsum([0, *map(len, groups)]))
    centers = np.concatenate(groups)
    for _ in range(_CENTER_ROUNDS):
        def moments(batches, centers=centers):
            total = np.zeros((len(centers), dim + 1))
            for batch in batches:
                matrix = points(batch)
                cell, _ = tree.nearest(matrix, centers)
                np.add.at(total, (cell, slice(0, dim)), matrix)
                total[:, -1] += np.bincount(cell, minlength=len(centers))
            yield 0, total

        total = summed(vectors, (len(centers), dim + 1), np.float64, moments)[0]
        held = total[:, -1:]
        centers = np.where(held > 0, total[:, :-1] / np.maximum(held, 1), centers)
    return centers, tree


def max_cells(dim: int) -> int:
    return max(1, MAX_CENTER_BYTES // (8 * max(1, dim)))


def build_cell_index(
    vectors: DataFrame, path: str, cells: int = 32, metric: str = "cosine", seed: int = 42, centers: np.ndarray | None = None
) -> CellIndex:
    """Train the quantizer (or take the given centres), assign every vector to its cell and write the index to ``path``."""
    V.check_metric(metric)
    spark = vectors.sparkSession
    known = vectors.filter("embedding is not null").select(F.col("slot").cast("long"), "embedding")
    first, tree = known.select(F.size("embedding")).first(), None
    if cells <= 0 or first is not None and cells > max_cells(first[0]):
        raise ValueError(f"cells must be positive, and their centres take at most {MAX_CENTER_BYTES} bytes")
    if centers is None and cells > BRANCH and first is not None:
        centers, tree = _grown_tree(known, cells, metric, seed)
    elif centers is None:
        centers = _trained_centers(known, cells, metric, seed)
    shared = spark.sparkContext.broadcast((centers, tree))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (_with_cells(metric, *shared.value, batch) for batch in batches)

    assigned = known.mapInArrow(assign, "slot long, embedding array<float>, reach double, cell int")
    # Rebalancing gathers each cell into few files and splits a cell that is too large for one task.
    assigned.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.max("reach").alias("radius")
    ).write.parquet(f"{path}/stats")
    kept = {
        "cell": list(range(len(centers))), "center": centers.tolist(), "metric": [metric] * len(centers)
    }
    small_table(spark, kept, "cell long, center array<double>, metric string").coalesce(1).write.parquet(
        f"{path}/centers"
    )
    if tree is not None:
        coarse = {"branch": list(range(len(tree.coarse))), "center": tree.coarse.tolist(), "until": tree.starts[1:].tolist()}
        small_table(spark, coarse, "branch long, center array<double>, until long").coalesce(1).write.parquet(f"{path}/coarse")
    return CellIndex(path, metric, centers, spark, tree)


def probed_search(index: CellIndex, queries: DataFrame, k: int = 10, nprobe: int = 8) -> DataFrame:
    """Approximate top-k over each query's ``nprobe`` nearest cells; all cells give the exact answer."""
    block = bounded_queries(queries, index.metric, MAX_DIRECT_QUERIES)
    if block is None:
        probes = _probes(index, queries, nprobe)
        return rank_hits(_block_join(index, probes, k, hits_schema(queries)), k, index.metric)
    metric = index.metric
    nprobe = min(nprobe, len(index.centers))
    reach = center_distances(block.matrix, index.centers)
    chosen = np.zeros(reach.shape, dtype=bool)
    nearest = np.argsort(reach, axis=1, kind="stable")[:, :nprobe]
    np.put_along_axis(chosen, nearest, True, axis=1)
    needed = [int(c) for c in np.nonzero(chosen.any(axis=0))[0]]
    scan = index.vectors
    if len(needed) < len(index.centers):
        scan = scan.filter(F.col("cell").isin(needed))
    shared = index.spark.sparkContext.broadcast((block.ids, block.matrix, chosen))

    def local_topk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, targets, chosen = shared.value
        best = RunningTopK(len(ids), k)
        for batch in batches:
            matrix = to_matrix(batch.column("embedding"), targets.shape[1] if len(ids) else None)
            if metric == "cosine":
                matrix = unit_rows(matrix)
            slots, cells = batch.column("slot").to_numpy(), batch.column("cell").to_numpy()
            for cell in np.unique(cells):
                here = cells == cell
                best.scan(metric, targets, np.nonzero(chosen[:, cell])[0], matrix[here], slots[here])
        yield best.to_batch(ids)

    partial = scan.select("slot", "embedding", "cell").mapInArrow(local_topk, hits_schema(queries))
    return rank_hits(partial, k, metric)


def _probes(
    index: CellIndex, queries: DataFrame, nprobe: int | None, bounds: DataFrame | None = None
) -> DataFrame:
    """One row per query and probed cell.

    ``nprobe`` keeps the nearest cells. ``bounds(query_id, bound)`` keeps the cells outside the
    ``nprobe`` nearest that may hold a vector within the bound: by the triangle inequality a cell
    holds nothing nearer than the distance to its center minus its radius.
    """
    metric, nearest_count = index.metric, min(nprobe or 0, len(index.centers))
    radii = np.full(len(index.centers), -np.inf)
    for row in index.stats.select("cell", "radius").collect():
        radii[row["cell"]] = row["radius"]
    shared = index.spark.sparkContext.broadcast((index.centers, radii))
    kind = queries.schema["query_id"].dataType.simpleString()
    known = queries.filter("embedding is not null").select("query_id", "embedding")
    bounded = bounds is not None
    if bounded:
        known = known.join(bounds, "query_id", "left")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, radii = shared.value
        rows = max(1, _BLOCK_CELLS // len(centers))
        for batch in (whole.slice(lo, rows) for whole in batches for lo in range(0, whole.num_rows, rows)):
            points = to_matrix(batch.column("embedding"), centers.shape[1])
            if metric == "cosine":
                points = unit_rows(points)
            reach = center_distances(points, centers)
            chosen = np.zeros(reach.shape, dtype=bool)
            nearest = np.argsort(reach, axis=1, kind="stable")[:, :nearest_count]
            np.put_along_axis(chosen, nearest, True, axis=1)
            if bounded:
                limit = batch.column("bound").fill_null(np.inf).to_numpy(zero_copy_only=False)
                slack = _SLACK * (1.0 + reach)
                chosen = ~chosen & (reach - radii[None, :] <= limit[:, None] + slack)
            chosen &= np.isfinite(radii)[None, :]
            row, cell = np.nonzero(chosen)
            for start in range(0, len(row), 16_384):
                part = pa.array(row[start : start + 16_384])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(part), batch.column("embedding").take(part),
                     pa.array(cell[start : start + 16_384].astype(np.int32))],
                    names=["query_id", "embedding", "cell"],
                )

    return known.mapInArrow(choose, f"query_id {kind}, embedding array<float>, cell int")


def _block_join(index: CellIndex, probes: DataFrame, k: int, schema: str) -> DataFrame:
    """Per-block top-k of vectors and probing queries that share a cell."""
    metric = index.metric
    probes = materialize(probes, "probes")
    # One row per cell, far smaller than the cells' centres, which every task holds.
    sizes = F.broadcast(
        index.stats.select("cell", F.ceil(F.col("rows") / VECTORS_PER_BLOCK).cast("int").alias("nv"))
        .join(
            probes.groupBy("cell").agg(
                F.ceil(F.count(F.lit(1)) / QUERIES_PER_BLOCK).cast("int").alias("nq")
            ),
            "cell",
        )
    )
    left = (
        index.vectors.select("cell", "slot", "embedding")
        .join(sizes, "cell")
        .withColumn("vb", F.pmod(F.xxhash64("slot"), F.col("nv")).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
        .select("cell", "vb", "qb", "slot", "embedding")
    )
    right = (
        probes.join(sizes, "cell")
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int"))
        .withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))
        .select("cell", "vb", "qb", "query_id", "embedding")
    )

    def block_topk(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids = queries.column("query_id").combine_chunks()
        best = RunningTopK(len(ids), k)
        if len(ids) and vectors.num_rows:
            targets = to_matrix(queries.column("embedding"))
            matrix = to_matrix(vectors.column("embedding"), targets.shape[1])
            if metric == "cosine":
                targets, matrix = unit_rows(targets), unit_rows(matrix)
            slots = vectors.column("slot").to_numpy()
            best.scan(metric, targets, np.arange(len(ids)), matrix, slots)
        return pa.Table.from_batches([best.to_batch(ids)])

    keys = ["cell", "vb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block_topk, schema)


def bounded_search(index: CellIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact top-k for query tables of any size.

    The nearest cell gives each query an upper bound on its k-th distance; afterwards only cells
    that may still hold something nearer are joined.
    """
    schema, metric = hits_schema(queries), index.metric
    queries = materialize(queries.select("query_id", "embedding"), "queries")
    seeds = materialize(
        rank_hits(_block_join(index, _probes(index, queries, 1), k, schema), k, metric), "seeds"
    )
    # A cosine distance d is the chord sqrt(2 d) between unit vectors; an L2 distance is squared.
    # Hits are ranked by rounded distances, so a neighbour up to a step of the grid farther may still rank first.
    distance = F.greatest(F.col("distance"), F.lit(0.0))
    last = seeds.filter(F.col("rank") == k)
    if metric == "cosine":
        chord = F.sqrt((distance + F.lit(_COSINE_STEP)) * F.lit(2.0))
    else:
        last = last.join(queries.select("query_id", F.expr("aggregate(embedding, 0d, (s, x) -> s + double(x) * double(x))").alias("q2")), "query_id")
        chord = F.sqrt(distance + F.lit(_L2_STEP) * (F.lit(3.0) * F.col("q2") + F.lit(2.0) * distance))
    bounds = last.select("query_id", chord.alias("bound"))
    rest = _block_join(index, _probes(index, queries, 1, bounds), k, schema)
    partial = seeds.select("query_id", "slot", "distance").unionByName(rest)
    return rank_hits(partial, k, metric)
