"""Product quantisation: a byte for each part of a vector, table look-ups for distances, exact reranking.

A codebook has up to 256 centres for each of ``parts`` equal slices of the dimensions. All codebooks are trained at once by
Lloyd's rounds over all rows: a task assigns its rows and sends sums and counts per centre, so a round is one scan and
moves no vector. Searches read the codes (one byte per part in place of four per dimension): each task adds up the
look-ups of a block of queries and keeps the nearest candidates of each, the candidates of all tasks are cut
to ``refine`` per query, and their distances are worked out on the vectors themselves. A vector that is a candidate of many
queries is read once. Once a query's list is full, a product in single precision with the vectors that the codes stand for
rules out most look-ups, with a margin for its error.

Query tables beyond one block are dealt to blocks of bounded size, a task each: all codes stream past the block's
queries, then all vectors past their candidates, which become no rows. The codes and vectors travel once per block.

With ``refine`` no smaller than the number of rows the result is exact; then every pair is a candidate,
and candidates become no rows: blocks of queries meet blocks of vectors with their codes, a candidate is ruled out by its
code where it can be, and the others are reranked where they are.

Vectors whose embedding is null take no part. With the cosine metric unit vectors are quantised (a zero vector stays zero).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecatlas.functions import vectors as V
from vecatlas.operators.hits import MAX_BROADCAST_HITS
from vecatlas.operators.sums import summed
from vecatlas.operators.topk import (
    _NO_SLOT, BLOCK_BYTES, BLOCK_ROWS, RunningTopK, Sieve, block_search, bounded_queries, hits_schema, pair_distances, rank_hits, to_matrix,
    unit_rows)
from vecatlas.session import empty_table, materialize

PARTS, CODES, ROUNDS, SAMPLE = 16, 256, 8, 8192
REFINE = 100
MAX_QUERIES = 2_000
_ROWS, _PAIRS = 4096, 1 << 16
# Candidates of a query that are rows of their own, and those that a task holds for all queries of a block.
MAX_REFINE, _MAX_HELD = 1024, 1 << 21
# Codes and queries that are estimated at once, the share of pairs up to which single look-ups pay, pairs that are sorted at once.
_CODES, _TILE, _LOOKED_SHARE, _MERGED = 131_072, 256, 1 / 4, 1 << 20


def _code_bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _points(batch: pa.RecordBatch, name: str, metric: str, dim: int) -> np.ndarray:
    matrix = to_matrix(batch.column(name), dim)
    return unit_rows(matrix) if metric == "cosine" else matrix


def _assigned(slices: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row's slice; equally near ones by their order."""
    return ((centres * centres).sum(axis=1)[None] - 2.0 * slices @ centres.T).argmin(axis=1)


@dataclass(frozen=True)
class Codebooks:
    """``centres[p]`` are the centres of the dimensions ``edges[p]`` to ``edges[p + 1]``."""

    metric: str
    edges: list[int]
    centres: list[np.ndarray]

    @property
    def dim(self) -> int:
        return self.edges[-1]

    def codes(self, points: np.ndarray) -> np.ndarray:
        return np.stack([_assigned(points[:, a:b], c) for a, b, c in zip(self.edges, self.edges[1:], self.centres)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances of each query's slices to the centres (queries x parts x 256)."""
        made = np.zeros((len(queries), len(self.centres), 256))
        for p, (a, b, c) in enumerate(zip(self.edges, self.edges[1:], self.centres)):
            far, gap = np.zeros((2, len(queries), len(c)))
            for x, y in zip(queries[:, a:b].T, np.ascontiguousarray(c.T)):
                np.subtract(x[:, None], y, out=gap)
                np.multiply(gap, gap, out=gap)
                far += gap
            made[:, p, : len(c)] = far
        return made

    def points(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return np.concatenate([c[code] for c, code in zip(self.centres, codes.T)], axis=1)

    def decoded(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """The vectors that a column of codes stands for."""
        return self.points(_code_bytes(column))

    def encode(self, vectors: DataFrame) -> DataFrame:
        """``slot, codes`` (one byte per part) of ``vectors(slot, embedding)``."""
        def run(batches):
            for batch in batches:
                codes = self.codes(_points(batch, "embedding", self.metric, self.dim))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("slot"), pa.array([row.tobytes() for row in codes], pa.binary())], names=["slot", "codes"])

        known = vectors.filter("embedding is not null").select(F.col("slot").cast("long").alias("slot"), "embedding")
        return known.mapInArrow(run, "slot long, codes binary")

    def write(self, spark: SparkSession, path: str) -> None:
        rows = [(p, self.metric, self.edges, c.ravel().tolist()) for p, c in enumerate(self.centres)]
        spark.createDataFrame(rows, "part int, metric string, edges array<int>, centres array<double>").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Codebooks:
        rows = spark.read.parquet(path).orderBy("part").collect()  # a row per part
        edges = list(rows[0]["edges"])
        return cls(rows[0]["metric"], edges, [np.array(r["centres"]).reshape(-1, b - a) for r, a, b in zip(rows, edges, edges[1:])])


def train_codebooks(vectors: DataFrame, metric: str = "cosine", parts: int = PARTS, codes: int = CODES, rounds: int = ROUNDS,
                    sample: int = SAMPLE) -> Codebooks:
    """Codebooks of all vectors. The first centres are vectors of a bounded sample (by hash of slot); all rows train them."""
    V.check_metric(metric)
    if not 0 < codes <= 256:
        raise ValueError("a code is one byte: codes must be in 1..256")
    known = vectors.filter("embedding is not null").select(F.col("slot").cast("long").alias("slot"), "embedding")
    first = known.orderBy(F.xxhash64("slot"), "slot").limit(sample).toArrow()
    if not first.num_rows:
        raise ValueError("no vector to train the codebooks on")
    points = to_matrix(first.column("embedding"))
    points = unit_rows(points) if metric == "cosine" else points
    dim = points.shape[1]
    edges = [dim * p // min(parts, dim) for p in range(min(parts, dim) + 1)]
    centres = []
    for a, b in zip(edges, edges[1:]):
        _, at = np.unique(points[:, a:b], axis=0, return_index=True)
        centres.append(points[np.sort(at)[:codes], a:b].copy())
    widest = max(b - a for a, b in zip(edges, edges[1:]))
    for _ in range(rounds):
        books = Codebooks(metric, edges, centres)

        def moments(batches, books=books):
            total = np.zeros((len(books.centres), codes, widest + 1))
            for batch in batches:
                matrix = _points(batch, "embedding", metric, dim)
                for lo in range(0, len(matrix), _ROWS):
                    part = matrix[lo : lo + _ROWS]
                    for p, code in enumerate(books.codes(part).T):
                        a, b = edges[p], edges[p + 1]
                        np.add.at(total[p], (code, slice(0, b - a)), part[:, a:b])
                        total[p, :, -1] += np.bincount(code, minlength=codes)
            yield 0, total

        total = summed(known.select("embedding"), (len(centres), codes, widest + 1), np.float64, moments)[0]
        moved = 0.0
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            counts = total[p, : len(centres[p]), -1:]
            new = np.where(counts > 0, total[p, : len(centres[p]), : b - a] / np.maximum(counts, 1), centres[p])
            moved = max(moved, float(np.abs(new - centres[p]).max()))
            centres[p] = new
        if moved < 1e-6:
            break
    return Codebooks(metric, edges, centres)


class _Candidates:
    """The ``keep`` nearest codes seen so far for each query of a block, by estimated distance, then slot."""

    def __init__(self, books: Codebooks, targets: np.ndarray, keep: int) -> None:
        self.books, self.targets, self.best, self.seen = books, targets, RunningTopK(len(targets), keep), 0
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._rows = 0

    def add(self, codes: np.ndarray, slots: np.ndarray) -> None:
        for lo in range(0, len(slots), _CODES):
            self._held.append((codes[lo : lo + _CODES], slots[lo : lo + _CODES]))
            self._rows += len(self._held[-1][1])
            if self._rows >= _CODES:
                self._scan()

    def found(self) -> RunningTopK:
        self._scan()
        return self.best

    def _scan(self) -> None:
        if not self._rows:
            return
        codes, slots = (np.concatenate(parts) for parts in zip(*self._held))
        self._held, self._rows = [], 0
        sieve = Sieve("l2", self.targets, self.books.points(codes))
        for lo in range(0, len(self.targets), _TILE):
            rows = np.arange(lo, min(lo + _TILE, len(self.targets)))
            tables = self.books.tables(self.targets[rows]).reshape(len(rows), -1)
            start = 0
            while start < len(slots):  # as many as were seen before, so that the lists' ends are up to date
                stop = min(len(slots), start + max(2 * self.best.k, self.seen + start))
                self._scan_part(rows, tables, sieve, codes, slots, start, stop)
                start = stop
        self.seen += len(slots)

    def _scan_part(self, rows: np.ndarray, tables: np.ndarray, sieve: Sieve, codes: np.ndarray, slots: np.ndarray, start: int, stop: int) -> None:
        new, flat = [], tables.ravel()
        for lo in range(start, stop, 2 * _ROWS):
            hi = min(lo + 2 * _ROWS, stop)
            worst, last = self.best.distance[rows, -1], self.best.slot[rows, -1]
            left = sieve.left(rows, lo, hi, worst, _LOOKED_SHARE) if sieve.usable and np.isfinite(worst).all() else None
            if left is None:
                self.best.update(rows, sum(tables[:, code + 256 * p] for p, code in enumerate(codes[lo:hi].T.astype(int))), slots[lo:hi])
                continue
            for i in range(0, len(left), _PAIRS):
                q, v = np.divmod(left[i : i + _PAIRS], hi - lo)
                v, row, far = v + lo, q * tables.shape[1], 0.0
                for p, code in enumerate(codes.take(v, axis=0).T):
                    far = far + flat.take(code + (row + 256 * p))
                better = (far < worst[q]) | ((far == worst[q]) & (slots[v] < last[q]))
                new.append((q[better], far[better], slots[v[better]]))
        _merged(self.best, rows, new)

    def to_batch(self, ids: pa.Array) -> pa.RecordBatch:
        return self.found().to_batch(ids)


def _merged(best: RunningTopK, rows: np.ndarray, new: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
    """Add (places in ``rows``, distances, slots) to the lists."""
    if new:
        q, far, slots = (np.concatenate(parts) for parts in zip(*new))
        order = np.argsort(q, kind="stable")
        touched, q = np.unique(q[order], return_inverse=True)
        best._merge(rows[touched], q, far[order], slots[order])


class _Reranked:
    """The k nearest of each query's candidates, by the vectors that are shown one after the other."""

    def __init__(self, metric: str, targets: np.ndarray, candidates: RunningTopK, k: int) -> None:
        self.metric, self.targets, self.best = metric, targets, RunningTopK(len(targets), k)
        held = candidates.slot != _NO_SLOT
        order = np.argsort(candidates.slot[held], kind="stable")
        self._slots, self._asking = candidates.slot[held][order], np.nonzero(held)[0][order]
        self._new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._pairs = 0

    def add(self, points: np.ndarray, slots: np.ndarray) -> None:
        first = np.searchsorted(self._slots, slots)
        counts = np.searchsorted(self._slots, slots, "right") - first
        ends = np.cumsum(counts)
        for lo in range(0, ends[-1] if len(ends) else 0, _PAIRS):  # a vector may be a candidate of all queries
            pair = np.arange(lo, min(lo + _PAIRS, ends[-1]))
            v = np.searchsorted(ends, pair, "right")
            q = self._asking[first[v] + pair - (ends[v] - counts[v])]
            far = pair_distances(self.metric, self.targets[q], points[v])
            better = far <= self.best.distance[q, -1]
            self._new.append((q[better], far[better], slots[v[better]]))
            self._pairs += len(pair)
            if self._pairs >= _MERGED:
                self.found()

    def found(self) -> RunningTopK:
        _merged(self.best, np.arange(len(self.targets)), self._new)
        self._new, self._pairs = [], 0
        return self.best


def _streamed_search(books: Codebooks, codes: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, keep: int) -> DataFrame:
    """Hits of query tables of any size: a task per block of queries, past which the codes and then the vectors stream."""
    spark, metric, schema = queries.sparkSession, books.metric, hits_schema(queries)
    asked = queries.filter("embedding is not null and query_id is not null").select("query_id", "embedding")
    asked = materialize(asked.withColumn("_row", F.monotonically_increasing_id()), "queries")
    count = asked.count()
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * books.dim), _MAX_HELD // keep))
    # Enough tasks for all cores, of at least some thousand queries.
    blocks = max(-(-count // rows), min(2 * spark.sparkContext.defaultParallelism, -(-count // 4096)), 1)
    # Arrow writes an empty list much faster than a null one.
    missing = {"query_id": F.lit(None).cast(queries.schema["query_id"].dataType), "slot": F.lit(0).cast("long"), "codes": F.lit(b""),
               "embedding": F.array().cast("array<float>")}

    def part(df: DataFrame, kind: int, block: Column) -> DataFrame:
        columns = {**missing, **{c: F.col(c) for c in df.columns if c in missing}}
        columns |= {"slot": columns["slot"].cast("long"), "embedding": columns["embedding"].cast("array<float>")}
        return df.select(block.alias("_block"), F.lit(kind).alias("_kind"), *(value.alias(c) for c, value in columns.items()))

    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = part(asked, 0, F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")).unionByName(
        part(codes.select("slot", "codes").filter("slot is not null"), 1, every)).unionByName(
        part(vectors.select("slot", "embedding").filter("embedding is not null and slot is not null"), 2, every))

    def points(batch: pa.RecordBatch) -> np.ndarray:
        return _points(batch, "embedding", metric, books.dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, targets, candidates, hits = None, [], [], None, None
        for batch in batches:
            for own, kind, rows in _runs(batch):
                if own != block:
                    if hits:
                        yield hits.found().to_batch(pa.concat_arrays(ids))
                    block, ids, targets, candidates, hits = own, [], [], None, None
                if kind == 0:
                    ids.append(rows.column("query_id"))
                    targets.append(points(rows))
                    continue
                if not ids:
                    continue
                if candidates is None:
                    targets = np.concatenate(targets)
                    candidates = _Candidates(books, targets, keep)
                slots = rows.column("slot").to_numpy()
                if kind == 1:
                    candidates.add(_code_bytes(rows.column("codes")), slots)
                    continue
                if hits is None:
                    hits = _Reranked(metric, targets, candidates.found(), k)
                hits.add(points(rows), slots)
        if hits:
            yield hits.found().to_batch(pa.concat_arrays(ids))

    met = met.repartitionById(blocks, F.col("_block")).sortWithinPartitions("_block", "_kind")
    return met.mapInArrow(run, schema)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """The slices of a sorted batch with one block and kind."""
    if not batch.num_rows:
        return
    block, kind = (batch.column(c).to_numpy() for c in ("_block", "_kind"))
    starts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1), batch.num_rows]
    for lo, hi in zip(starts, starts[1:]):
        yield int(block[lo]), int(kind[lo]), batch.slice(lo, hi - lo)


def pq_search(books: Codebooks, codes: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, refine: int = REFINE,
              max_queries: int = MAX_QUERIES) -> DataFrame:
    """The k nearest of the ``refine`` candidates of each query: ``query_id, rank, slot, distance, score``.

    ``codes`` are those of ``vectors``. More queries than ``max_queries`` are dealt to blocks, past which codes and vectors stream.
    """
    metric = books.metric
    if k <= 0:
        return rank_hits(empty_table(queries.sparkSession, hits_schema(queries)), 0, metric)
    if refine > MAX_REFINE:
        codes = materialize(codes.select("slot", "codes"), "codes")
        if refine >= codes.count():
            known = vectors.filter("embedding is not null").select(F.col("slot").cast("long").alias("slot"), "embedding")
            return block_search(known.join(codes, "slot"), queries, k, metric, books.decoded)
        max_queries = max(1, min(max_queries, _MAX_HELD // refine))
    schema, keep = hits_schema(queries), max(k, refine)
    block = bounded_queries(queries, metric, max_queries)
    if block is None:
        return rank_hits(_streamed_search(books, codes, vectors, queries, k, keep), k, metric)
    if not len(block.ids):
        return rank_hits(empty_table(queries.sparkSession, schema), k, metric)
    shared = queries.sparkSession.sparkContext.broadcast((block.ids, block.matrix))

    def estimate(batches):
        ids, targets = shared.value
        best = _Candidates(books, targets, keep)
        for batch in batches:
            if batch.num_rows:
                best.add(_code_bytes(batch.column("codes")), batch.column("slot").to_numpy())
        yield best.to_batch(ids)

    order = Window.partitionBy("query_id").orderBy("distance", "slot")
    found = codes.select("slot", "codes").mapInArrow(estimate, schema).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= keep)
    # A row per candidate slot, with as many queries as the block has at most.
    asking = materialize(found.groupBy("slot").agg(F.collect_list("query_id").alias("asking")), "candidates")

    def rerank(batches):
        ids, targets = shared.value
        rows = {q: i for i, q in enumerate(ids.to_pylist())}
        for batch in batches:
            points, slots, asked = _points(batch, "embedding", metric, books.dim), batch.column("slot").to_numpy(), batch.column("asking")
            v = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy())
            q = np.fromiter((rows[x] for x in asked.flatten().to_pylist()), np.int64, len(v))
            far = np.concatenate([pair_distances(metric, targets[q[lo : lo + _PAIRS]], points[v[lo : lo + _PAIRS]]) for lo in range(0, len(v), _PAIRS)] or [[]])
            best = np.lexsort((slots[v], far, q))
            q, v, far = q[best], v[best], far[best]
            near = np.arange(len(q)) - np.searchsorted(q, q) < k
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[near])), pa.array(slots[v[near]]), pa.array(far[near])], names=["query_id", "slot", "distance"])

    known = vectors.filter("embedding is not null").select(F.col("slot").cast("long").alias("slot"), "embedding")
    # Spark would judge the lists by their size as written, which is far below the one in memory.
    side = F.broadcast(asking) if len(block.ids) * keep <= MAX_BROADCAST_HITS else asking.hint("merge")
    return rank_hits(known.join(side, "slot").mapInArrow(rerank, schema), k, metric)
