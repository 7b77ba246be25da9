"""Exact top-k nearest neighbours.

A batch of queries is scored against each Arrow batch of vectors with one matrix product, and only
a running top-k per query leaves a task, so no query-vector pair ever becomes a row. Queries that
exceed the checked broadcast bound meet the vectors in blocks of bounded size on both sides instead.

Once a query's list is full, a product in single precision with a margin for its error rules out most
pairs; the others are scored in double precision.

Neighbours are ordered by distance, then slot. Distances are compared on a grid far below float32
resolution, so that copies of one vector tie exactly whatever the order of floating-point sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecatlas.functions import vectors as V
from vecatlas.session import empty_table, materialize

# Bound on the query block that every Python worker holds.
MAX_BROADCAST_QUERIES = 20_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Bound on one block of the score matrix.
_SCORE_CELLS = 4_000_000
# Bound on the lists that are sorted at once.
_MERGED_CELLS = 1 << 20
# Vectors that fill the lists before single precision is used, and the share of pairs up to which it pays.
_FIRST, _SIEVED_SHARE = 1024, 1 / 32
# Bound on a block of vectors or queries in a block search, in rows and bytes.
BLOCK_ROWS, BLOCK_BYTES = 65_536, 32 * 1024 * 1024
_NO_SLOT = np.iinfo(np.int64).max


def to_matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """ARRAY<FLOAT> column -> float64 matrix; every vector must have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    width = dim if dim is not None else (int(lengths[0]) if len(lengths) else 0)
    if len(lengths) and not (lengths == width).all():
        raise ValueError(f"embedding dimension differs from {width}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(lengths), width)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(norms > 0, norms, 1.0)[:, None]


def distances(metric: str, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Distance matrix; for the cosine metric both sides are unit rows already."""
    if metric == "cosine":
        return _on_grid(metric, queries @ vectors.T, None)
    reach = np.einsum("ij,ij->i", queries, queries)[:, None] + np.einsum("ij,ij->i", vectors, vectors)
    return _on_grid(metric, queries @ vectors.T, reach)


def pair_distances(metric: str, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Distances of the rows of two equally long matrices."""
    reach = np.einsum("ij,ij->i", queries, queries) + np.einsum("ij,ij->i", vectors, vectors)
    return _on_grid(metric, np.einsum("ij,ij->i", queries, vectors), reach)


def _on_grid(metric: str, product: np.ndarray, reach: np.ndarray | None) -> np.ndarray:
    """Distances from inner products and (L2) the sums of squared lengths."""
    if metric == "cosine":
        return np.round(1.0 - product, 10) + 0.0
    grid = np.exp2(np.ceil(np.log2(np.maximum(reach, np.finfo(float).tiny))) - 30)
    return np.maximum(np.round((reach - 2.0 * product) / grid) * grid, 0.0)


class Sieve:
    """Rules out pairs by a product in single precision, with a margin for all that rounding can do.

    ``near`` are approximations of the vectors, e.g. from codes; the length of what they miss then widens the margin.
    """

    def __init__(self, metric: str, queries: np.ndarray, vectors: np.ndarray, near: np.ndarray | None = None) -> None:
        self.metric, self.squares = metric, np.einsum("ij,ij->i", queries, queries)
        lengths, squares = np.sqrt(self.squares), np.einsum("ij,ij->i", vectors, vectors)
        left, right = [queries], [vectors if near is None else near]
        if near is not None:
            left.append(lengths[:, None])
            right.append(np.sqrt(((vectors - near) ** 2).sum(axis=1))[:, None])
        if metric != "cosine":
            left.append(np.ones((len(queries), 1)))
            right.append(-0.5 * squares[:, None])
        far = np.sqrt(sum(np.einsum("ij,ij->i", part, part).max(initial=0.0) for part in right))
        reach = np.sqrt(sum(np.einsum("ij,ij->i", part, part) for part in left))
        width = sum(part.shape[1] for part in right)
        self.usable = bool(far < 1e15 and reach.max(initial=0.0) < 1e15)  # neither for nan
        self.margin = (width + 10) * 2.0**-23 * reach * far + width * 1e-36
        # Distances are compared on a grid.
        self.margin += 1e-9 if metric == "cosine" else 2.0**-28 * (self.squares + squares.max(initial=0.0))
        if self.usable:
            self._left, self._right = (np.concatenate(parts, axis=1, dtype=np.float32, casting="same_kind") for parts in (left, right))

    def left(self, rows: np.ndarray, lo: int, hi: int, worst: np.ndarray, share: float = _SIEVED_SHARE) -> np.ndarray | None:
        """Places in the table of ``rows`` and the vectors from ``lo`` to ``hi`` that may be as near as ``worst``; None for many."""
        least = 1.0 - worst if self.metric == "cosine" else 0.5 * (self.squares[rows] - worst)
        least = np.nextafter((least - self.margin[rows]).astype(np.float32), np.float32(-np.inf))
        left = self._left[rows] @ self._right[lo:hi].T >= least[:, None]
        if np.count_nonzero(left) > left.size * share:
            return None
        if left.size % 8:
            return np.flatnonzero(left)
        eights = np.flatnonzero(left.ravel().view(np.uint64) != 0)  # few of them hold any pair
        at, within = np.nonzero(left.reshape(-1, 8)[eights])
        return eights[at] * 8 + within


class RunningTopK:
    """The k nearest slots seen so far for each query of a block.

    With ``windows`` a slot may come with several vectors, and its nearest one counts.
    """

    def __init__(self, n_queries: int, k: int, windows: bool = False) -> None:
        self.k, self.windows = k, windows
        self.distance = np.full((n_queries, k), np.inf)
        self.slot = np.full((n_queries, k), _NO_SLOT, dtype=np.int64)

    def update(self, rows: np.ndarray, found: np.ndarray, slots: np.ndarray) -> None:
        if self.windows and len(slots):
            order = np.argsort(slots, kind="stable")
            starts = np.flatnonzero(np.diff(slots[order], prepend=slots[order[0]] - 1))
            found, slots = np.minimum.reduceat(found[:, order], starts, axis=1), slots[order[starts]]
        worst, worst_slot = self.distance[rows, -1:], self.slot[rows, -1:]
        better = (found < worst) | ((found == worst) & (slots[None, :] < worst_slot))
        if found.shape[1] > self.k and better.sum() > 2 * self.k * len(rows):
            kth = np.partition(found, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            better &= found <= kth
        q, v = np.nonzero(better)
        if len(q):
            self._merge(rows, q, found[q, v], slots[v])

    def _merge(self, rows: np.ndarray, q: np.ndarray, found: np.ndarray, slots: np.ndarray) -> None:
        """Add single distances: those of the queries ``rows[q]``, where ``q`` ascends."""
        counts = np.bincount(q, minlength=len(rows))
        starts = np.concatenate([[0], np.cumsum(counts)])
        step = max(1, _MERGED_CELLS // (self.k + int(counts.max(initial=0))))
        for lo in range(0, len(rows), step):
            part, own = rows[lo : lo + step], counts[lo : lo + step]
            a, b = starts[lo], starts[lo + len(part)]
            dist = np.full((len(part), self.k + int(own.max())), np.inf)
            slot = np.full(dist.shape, _NO_SLOT, dtype=np.int64)
            dist[:, : self.k], slot[:, : self.k] = self.distance[part], self.slot[part]
            place = q[a:b] - lo, self.k + np.arange(a, b) - starts[q[a:b]]
            dist[place], slot[place] = found[a:b], slots[a:b]
            if self.windows:  # a slot that was known already counts once
                near = np.lexsort((dist, slot), axis=1)
                dist, slot = np.take_along_axis(dist, near, axis=1), np.take_along_axis(slot, near, axis=1)
                again = np.zeros(dist.shape, dtype=bool)
                again[:, 1:] = (slot[:, 1:] == slot[:, :-1]) & (slot[:, 1:] != _NO_SLOT)
                dist[again], slot[again] = np.inf, _NO_SLOT
            order = np.argsort(dist, axis=1)
            near = np.take_along_axis(dist, order, axis=1)
            tied = np.flatnonzero((near[:, 1 : self.k + 1] == near[:, : self.k][:, : near.shape[1] - 1]).any(axis=1))
            order[tied] = np.lexsort((slot[tied], dist[tied]), axis=1)
            self.distance[part] = near[:, : self.k]
            self.slot[part] = np.take_along_axis(slot, order[:, : self.k], axis=1)

    def scan(self, metric: str, queries: np.ndarray, rows: np.ndarray, vectors: np.ndarray,
             slots: np.ndarray, coarse: Sieve | None = None) -> None:
        """Score ``queries[rows]`` against the vectors in pieces of bounded size.

        ``coarse`` rules out pairs by approximations of the vectors before the vectors themselves do.
        """
        sieve = Sieve(metric, queries, vectors)
        full = len(rows) and self.slot[rows, -1].max() != _NO_SLOT
        v_step = max(1, min(len(slots), 8192))
        bounds = [0, *range(0 if full else _FIRST, len(slots), v_step), len(slots)]
        for lo, hi in zip(bounds, bounds[1:]):
            if lo == hi:
                continue
            q_step = max(1, _SCORE_CELLS // (hi - lo))
            for q in range(0, len(rows), q_step):
                chosen = rows[q : q + q_step]
                if not self._sieved(metric, queries, chosen, vectors, slots, lo, hi, [coarse, sieve]):
                    self.update(chosen, distances(metric, queries[chosen], vectors[lo:hi]), slots[lo:hi])

    def _sieved(self, metric: str, queries: np.ndarray, rows: np.ndarray, vectors: np.ndarray, slots: np.ndarray,
                lo: int, hi: int, sieves: list[Sieve | None]) -> bool:
        """Score what the sieves leave of the vectors from ``lo`` to ``hi``; False if they leave too much."""
        worst = self.distance[rows, -1]
        if not np.isfinite(worst).all():
            return False
        for sieve in sieves:
            left = sieve.left(rows, lo, hi, worst) if sieve is not None and sieve.usable else None
            if left is not None:
                q, v = np.divmod(left, hi - lo)
                break
        else:
            return False
        step = max(1, _SCORE_CELLS // max(1, vectors.shape[1]))
        found = [pair_distances(metric, queries[rows[q[i : i + step]]], vectors[lo + v[i : i + step]]) for i in range(0, len(q), step)]
        if found:
            found, new = np.concatenate(found), slots[lo + v]
            better = (found < worst[q]) | ((found == worst[q]) & (new < self.slot[rows[q], -1]))
            touched, q = np.unique(q[better], return_inverse=True)
            if len(touched):
                self._merge(rows[touched], q, found[better], new[better])
        return True

    def to_batch(self, ids: pa.Array) -> pa.RecordBatch:
        hit = self.slot != _NO_SLOT
        rows = np.nonzero(hit)[0]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows)), pa.array(self.slot[hit]), pa.array(self.distance[hit])],
            names=["query_id", "slot", "distance"],
        )


@dataclass
class QueryBlock:
    """Queries small enough to be sent to every worker."""

    ids: pa.Array
    matrix: np.ndarray

    @classmethod
    def from_arrow(cls, table: pa.Table, metric: str) -> QueryBlock:
        matrix = to_matrix(table.column("embedding"))
        return cls(
            table.column("query_id").combine_chunks(),
            unit_rows(matrix) if metric == "cosine" else matrix,
        )


def bounded_queries(queries: DataFrame, metric: str, max_queries: int) -> QueryBlock | None:
    """The query block, or None when the table exceeds the bound (at most bound + 1 rows are read)."""
    known = queries.filter("embedding is not null").select("query_id", "embedding")
    table = known.limit(max_queries + 1).toArrow()
    if table.num_rows > max_queries or table.nbytes > MAX_BROADCAST_BYTES:
        return None
    return QueryBlock.from_arrow(table, metric)


def hits_schema(queries: DataFrame) -> str:
    kind = queries.schema["query_id"].dataType.simpleString()
    return f"query_id {kind}, slot long, distance double"


def rank_hits(partial: DataFrame, k: int, metric: str) -> DataFrame:
    """Final top-k of per-task lists. The literal ``<= k`` lets Spark cut each group before the shuffle."""
    order = Window.partitionBy("query_id").orderBy("distance", "slot")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "slot", "distance",
                V.score(metric, F.col("distance")).alias("score"))
    )


def topk_search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """The k nearest ``vectors(slot, embedding)`` of each row of ``queries(query_id, embedding)``."""
    return topk_with_bound(vectors, queries, k, metric, max_broadcast_queries)[0]


def topk_with_bound(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str,
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
) -> tuple[DataFrame, int | None]:
    """``topk_search`` with the largest possible number of hits, if the queries were counted."""
    V.check_metric(metric)
    if k <= 0:
        return rank_hits(empty_table(queries.sparkSession, hits_schema(queries)), 0, metric), 0
    block = bounded_queries(queries, metric, max_broadcast_queries)
    if block is None:
        return block_search(vectors, queries, k, metric), None
    shared = queries.sparkSession.sparkContext.broadcast((block.ids, block.matrix))

    def local_topk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, targets = shared.value
        best = RunningTopK(len(ids), k)
        rows = np.arange(len(ids))
        for batch in batches:
            matrix = to_matrix(batch.column("embedding"), targets.shape[1] if len(rows) else None)
            if metric == "cosine":
                matrix = unit_rows(matrix)
            best.scan(metric, targets, rows, matrix, batch.column("slot").to_numpy())
        yield best.to_batch(ids)

    known = vectors.filter("embedding is not null").select(F.col("slot").cast("long"), "embedding")
    hits = rank_hits(known.mapInArrow(local_topk, hits_schema(queries)), k, metric)
    return hits, k * len(block.ids)


def block_search(vectors: DataFrame, queries: DataFrame, k: int, metric: str, coarse: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """Exact top-k for query tables of any size: every block of queries meets every block of vectors in one group.

    Rows are dealt to blocks by their place, so equal or null keys do not crowd one. A side travels once per block of the
    other. With ``coarse``, ``vectors`` has a column ``codes`` too, and pairs are ruled out first by the vectors that it
    makes of them.
    """
    spark = vectors.sparkSession
    extra = ["codes"] if coarse else []
    known = vectors.filter("embedding is not null").select(F.col("slot").cast("long").alias("slot"), "embedding", *extra)
    asked = queries.filter("embedding is not null").select("query_id", "embedding")
    known, asked = (materialize(df.withColumn("_row", F.monotonically_increasing_id()), tag) for df, tag in ((known, "vectors"), (asked, "queries")))
    size = F.coalesce(F.max(F.size("embedding")), F.lit(1))
    (n, width), (m, asked_width) = (df.agg(F.count(F.lit(1)), size).first() for df in (known, asked))
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * max(1, width, asked_width))))
    # Enough groups for all cores, of at least some thousand rows.
    wanted = math.isqrt(4 * spark.sparkContext.defaultParallelism) + 1
    nv, nq = (max(-(-count // rows), min(wanted, -(-count // 4096)), 1) for count in (n, m))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        part = F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")
        return df.select("*", part.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)).drop("_row")

    def block_topk(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("query_id").combine_chunks()
        best = RunningTopK(len(ids), k)
        if len(ids) and left.num_rows:
            targets = to_matrix(right.column("embedding"))
            matrix = to_matrix(left.column("embedding"), targets.shape[1])
            if metric == "cosine":
                targets, matrix = unit_rows(targets), unit_rows(matrix)
            sieve = Sieve(metric, targets, matrix, coarse(left.column("codes"))) if coarse else None
            best.scan(metric, targets, np.arange(len(ids)), matrix, left.column("slot").to_numpy(), sieve)
        return pa.Table.from_batches([best.to_batch(ids)])

    keys = ["_vb", "_qb"]
    left, right = dealt(known, "_vb", nv, "_qb", nq), dealt(asked, "_qb", nq, "_vb", nv)
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block_topk, hits_schema(queries))
    return rank_hits(hits, k, metric)


def topk_windows(
    vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine",
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES, depth: int = 0,
) -> DataFrame:
    """The k nearest slots of each query where a slot has a vector per window and its nearest window counts.

    More queries than one block may hold are searched block by block.
    """
    V.check_metric(metric)
    block = bounded_queries(queries, metric, max_broadcast_queries)
    if block is None:
        rows, floats = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0))).first()
        blocks = max(2, -(-2 * rows // max_broadcast_queries), -(-2 * 8 * floats // MAX_BROADCAST_BYTES))
        # Each depth deals the queries anew.
        part = F.pmod(F.xxhash64(F.lit(depth), "query_id"), F.lit(blocks))
        found = [topk_windows(vectors, queries.filter(part == i), k, metric, max_broadcast_queries, depth + 1) for i in range(blocks)]
        return reduce(DataFrame.unionByName, found)
    shared = queries.sparkSession.sparkContext.broadcast((block.ids, block.matrix))

    def local_topk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, targets = shared.value
        best = RunningTopK(len(ids), k, windows=True)
        for batch in batches:
            matrix = to_matrix(batch.column("embedding"), targets.shape[1] if len(ids) else None)
            if metric == "cosine":
                matrix = unit_rows(matrix)
            best.scan(metric, targets, np.arange(len(ids)), matrix, batch.column("slot").to_numpy())
        yield best.to_batch(ids)

    known = vectors.filter("embedding is not null").select(F.col("slot").cast("long"), "embedding")
    hits = known.mapInArrow(local_topk, hits_schema(queries))
    return rank_hits(hits.groupBy("query_id", "slot").agg(F.min("distance").alias("distance")), k, metric)


def single_query_topk(
    vectors: DataFrame, embedding: list[float], k: int = 10, metric: str = "cosine"
) -> DataFrame:
    """One query vector: a JVM-only projection with a per-partition top-k heap and no shuffle of rows."""
    target = F.array(*[F.lit(float(x)) for x in embedding])
    known = vectors.filter("embedding is not null")
    return (
        known.select("slot", V.distance(metric, F.col("embedding"), target).alias("distance"))
        .orderBy("distance", "slot")
        .limit(k)
        .withColumn("score", V.score(metric, F.col("distance")))
    )
