"""SimHash near-dedup by a generalised pigeonhole.

A fingerprint has a bit for each of 64 positions, set if over half of a text's shingle hashes have it. Two
fingerprints that differ in at most tau bits differ, for partitions of the bits with thresholds whose
(threshold + 1) sum to tau + 1, in at most its threshold in one partition. Correlated bits are put into the same
partition, so that the others stay selective; how many partitions there are and which threshold each gets is
found by dynamic programming over the expected number of candidates (from the exact sizes of all buckets) and of
probes. Probes with up to a threshold of flipped bits meet the bucket table in an equi join, and candidates are
verified by their distance.

Fingerprints are made distinct first, so copies cost one row. Distinct fingerprints that crowd a bucket beyond
``CROWD`` leave it and probe for every fingerprint within tau of theirs instead: 2,081 exact lookups for tau = 2,
linear in their number where pairs within the bucket would be quadratic. Nothing is dropped by either way.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.graph import components
from vecatlas.llm.tables import answer_chunks, chunk_rows, column_bytes, small_batches, write_chunks
from vecatlas.session import materialize

BITS = 64
SEED = 42
CROWD = 2048


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of ``size`` lower-cased words; fewer words are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    count = max(1, len(words) - size + 1)
    spans = zip(starts[:count].tolist(), (ends[min(size, len(words)) - 1 :][:count] - 1).tolist())
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(joined[a:b], SEED) for a, b in spans), np.uint64, count)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint; 0 for no hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; a null text has no words."""
    def run(batches):
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t, shingle)) for t in column_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _bit_correlations(fps: DataFrame) -> np.ndarray:
    """Absolute correlations of all pairs of bits, over all fingerprints; 64 x 64 sums reach the driver."""
    def run(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            words = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            for lo in range(0, len(words), 8192):
                part = words[lo : lo + 8192]
                signs = ((part[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1
                total += signs.T @ signs
        yield pa.RecordBatch.from_pydict({"i": list(range(BITS)), "row": total.tolist()})

    rows = fps.select("fp").mapInArrow(run, "i long, row array<double>")
    sums = rows.groupBy("i").agg(*(F.sum(F.col("row")[j]).alias(str(j)) for j in range(BITS))).collect()
    out = np.zeros((BITS, BITS))
    for r in sums:
        out[r["i"]] = r[1:]
    return np.abs(out)


def bit_partitions(correlations: np.ndarray, m: int) -> list[list[int]]:
    """``m`` sets of bits of nearly equal size; each grows by the bit most correlated with it."""
    left, out = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        group = [max(left, key=lambda b: sum(correlations[b][c] for c in left if c != b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (sum(correlations[b][c] for c in group), -b)))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def _mask(bits: list[int]) -> int:
    """The bits as a signed 64-bit mask."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _flips(bits: list[int], most: int) -> list[int]:
    return [_mask(list(c)) for t in range(most + 1) for c in combinations(bits, t)]


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds (-1: not probed) whose (threshold + 1) sum to ``budget``, of least cost; costs[i][threshold + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for step, extra in enumerate(row):
                total = used + step
                if total <= budget and (total not in new or cost + extra < new[total][0]):
                    new[total] = (cost + extra, [*chosen, step - 1])
        best = new
    return best[budget]


def plan(fps: DataFrame, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe."""
    correlations = _bit_correlations(fps)
    options = [bit_partitions(correlations, m) for m in range(1, tau + 3)]
    keys = [(m, i, _mask(bits)) for m, groups in enumerate(options) for i, bits in enumerate(groups)]
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(mask).alias("v"))
                                 for m, i, mask in keys))).alias("k")
    sizes = fps.select(values).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    stats = {(r["m"], r["i"]): r for r in sizes.groupBy("k.m", "k.i").agg(
        F.sum(F.col("n") * F.least("n", F.lit(CROWD))).cast("double").alias("pairs"), F.sum("n").alias("n")).collect()}
    best = (float("inf"), [])
    for m, groups in enumerate(options):
        costs = []
        for i, bits in enumerate(groups):
            n, pairs, width = (float(stats[m, i]["n"]), stats[m, i]["pairs"], len(bits)) if (m, i) in stats else (0.0, 0.0, len(bits))
            row = [0.0]
            for t in range(tau + 1):
                probes = sum(comb(width, j) for j in range(t + 1))
                # Flipped values are taken to meet an even spread; the value itself meets its own bucket.
                row.append(n * probes + pairs + (probes - 1) * n * n / 2.0**width)
            costs.append(row)
        cost, thresholds = allocate(costs, tau + 1)
        if cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(groups, thresholds) if t >= 0])
    return best[1]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, tau: int = 2, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (``fp``, one row each) that differ in 1 to tau bits."""
    parts = plan(fps, tau)
    rows = lambda flips: F.explode(F.array(*(
        F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(_mask(bits)).bitwiseXOR(F.lit(flip)).alias("v"))
        for i, (bits, t) in enumerate(parts) for flip in (_flips(bits, t) if flips else [0])))).alias("k")
    index = fps.select(rows(False), F.col("fp").alias("b"))
    probes = fps.select(rows(True), F.col("fp").alias("a"))
    crowded = materialize(index.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("k"), "crowded")
    some = bool(crowded.limit(1).count())
    quiet = index.join(crowded, "k", "left_anti") if some else index
    pairs = probes.join(quiet, "k").where("a < b").where(_distance(F.col("a"), F.col("b")) <= tau)
    pairs = pairs.select("a", "b").distinct()
    if some:
        alone = index.join(crowded, "k", "left_semi").select(F.col("b").alias("x")).distinct()
        every = F.array(*(F.lit(f) for f in _flips(list(range(BITS)), tau)[1:]))
        asked = alone.select("x", F.explode(every).alias("f")).select("x", F.col("x").bitwiseXOR(F.col("f")).alias("fp"))
        found = asked.join(fps.select("fp"), "fp").select(F.least("x", "fp").alias("a"), F.greatest("x", "fp").alias("b"))
        pairs = pairs.unionByName(found).distinct()
    return pairs


def near_groups(docs: DataFrame, shingle: int = 3, tau: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    ``component_id`` is the smallest doc_id among the rows whose fingerprints are linked to the row's, itself
    included, over any number of links. Rows without an id get their group's smallest id, or null.
    """
    rows = materialize(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps.select("fp"), tau)).withColumnRenamed("v", "fp")
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


CLASSES = 8
#: Classes of each level for rows with a class that over ``CROWD`` others have too, and how many of them must be rarer.
MORE_CLASSES, QUIET = 64, 8
BINS = 256
#: Rows of a bucket are compared in blocks of about so many with each other.
BLOCK = 512
#: Partners that a row names per pair of blocks, round by round; the last round has no limit.
ROUNDS = (4, 64, 1 << 62)
_SALT = np.uint64(0xA0761D6478BD642F)


def class_fingerprints(hashes: np.ndarray, classes: int = CLASSES) -> list[int]:
    """Fingerprints of small parts of a text's shingle set, which near copies have in common.

    Shingles are dealt by their hash into 2^level classes, one to four shingles each; the first ``classes`` of two
    levels are taken, so texts whose sizes differ by less than half have a level in common. A pair of Jaccard
    similarity 0.8 agrees in any one class with about even odds, in one of the eight with over 0.99.
    """
    mixed = (hashes ^ (hashes >> np.uint64(29))) * _SALT
    out, level = [], max(0, int(np.log2(max(1, len(hashes)) / 2)))
    for depth in (level, level + 1):
        number = mixed >> np.uint64(64 - depth) if depth else np.zeros(len(mixed), np.uint64)
        for c in range(min(classes, 1 << depth)):
            members = hashes[number == c]
            if len(members):
                marked = int(fingerprint(members)) ^ xxhash.xxh64_intdigest(f"{depth}/{c}".encode())
                out.append((marked & (1 << 64) - 1) - (1 << 64) * ((marked >> 63) & 1))
    return out


def _profiles(chunks: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """Per row: its number, id, fingerprint, a hash of its shingle set, class fingerprints and a profile of its set."""
    def run(batches):
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table, rows = chunk_rows(data), []
                for row, (doc, whole) in enumerate(zip(table[doc_id].to_pylist(), column_bytes(table[text].combine_chunks()))):
                    hashes = shingle_hashes(whole, shingle)
                    own = np.unique(hashes)
                    digest = xxhash.xxh3_128_digest(own.tobytes())
                    rows.append((row, doc, fingerprint(hashes), digest, class_fingerprints(own), set_profile(own)))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), chunk, np.int64)), *columns],
                                                 names=["chunk", "row", "doc", "fp", "set", "classes", "profile"])

    return chunks.select("chunk", "rows").mapInArrow(
        run, "chunk long, row int, doc long, fp long, set binary, classes array<long>, profile binary")


def set_profile(own: np.ndarray) -> bytes:
    """The size of a set of hashes and how many of them are in each of ``BINS`` ranges, up to 255."""
    counts = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=BINS)
    return np.uint32(len(own)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()


def unpacked(profiles: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, ranges' counts, and how many hashes are beyond those counts."""
    data = np.frombuffer(b"".join(profiles), np.uint8).reshape(-1, 4 + BINS)
    sizes, bins = np.ascontiguousarray(data[:, :4]).view(np.uint32)[:, 0].astype(np.int64), data[:, 4:]
    return sizes, bins, sizes - bins.sum(1, dtype=np.int64)


def most_similarity(x: tuple, y: tuple) -> np.ndarray:
    """Upper bounds of the sets' Jaccard similarities: no range has more in common than the smaller count."""
    both = np.minimum(x[1], y[1]).sum(-1, dtype=np.int64) + np.minimum(x[2], y[2])
    return both / np.maximum(1, x[0] + y[0] - both)


def similarity(x: bytes, y: bytes) -> float:
    """Jaccard similarity of two sets of hashes."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def without_near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, tau: int = 2, doc_id: str = "doc_id",
                        text: str = "text") -> DataFrame:
    """``docs`` with one row (of smallest id, then the first read) of each group of near copies.

    Rows are near copies if the sets of their shingles of ``shingle`` words have a Jaccard similarity of ``least``
    or more; groups are connected over such pairs. Candidates: equal sets; whole-text fingerprints within ``tau``
    bits; and one equal class fingerprint. Each row meets the first row of its bucket, and then every row of it that
    is not yet in its own group. A class of over ``CROWD`` different sets (a passage that very many texts hold) says
    little: its rows get many more classes instead and meet in the rarer ones, so that work grows with the rows; only a
    row with too few rare classes still meets all rows of its crowded ones. Candidates whose profiles rule out ``least``
    cannot have it; all others are verified by the whole sets. Null texts and texts without a word are copies of each other.
    """
    chunks = write_chunks(docs, text)
    profiles = materialize(_profiles(chunks, doc_id, text, shingle), "profiles")
    rows = materialize(profiles.select(_node().alias("node"), "chunk", "row", "doc", "set", "fp", "classes"), "rows")
    # One row stands for all rows of an equal set.
    heads = materialize(rows.groupBy("set").agg(F.min("node").alias("head"), F.first("fp").alias("fp")), "heads")
    classes = rows.join(heads.select("set", F.col("head").alias("node")), ["set", "node"], "left_semi").select(
        "node", F.explode("classes").alias("class"))
    classes, crowded, lonely = _with_more_classes(materialize(classes, "classes"), chunks, text, shingle)
    firsts = classes.groupBy("class").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    by_class = classes.join(firsts, "class").where("node <> a").select("a", F.col("node").alias("b"))
    fps = materialize(heads.groupBy("fp").agg(F.min("head").alias("a")), "fps")
    same_fp = heads.join(fps, "fp").where("head <> a").select("a", F.col("head").alias("b"), "fp")
    linked = materialize(links(fps.select("fp"), tau), "links")
    near = linked.join(fps.select(F.col("fp").alias("a"), F.col("a").alias("x")), "a").join(
        fps.select(F.col("fp").alias("b"), F.col("a").alias("y")), "b")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    candidates = materialize(by_class.unionByName(same_fp.drop("fp")).unionByName(near).distinct(), "candidates")
    sides = profiles.select(_node().alias("node"), F.col("profile").alias("value"))
    bounded = lambda x, y: most_similarity(unpacked(x), unpacked(y)) >= least
    likely = materialize(_judged(candidates, sides, bounded), "likely")
    verified = materialize(_verified(likely, chunks, least, text, shingle), "verified")
    roots = components(verified)
    # A bucket's first row has met all others of it.
    quiet = classes.join(crowded, "class", "left_anti")
    rest = quiet.join(firsts, "class").where("node <> a").select(F.xxhash64(F.lit("class"), "class").alias("key"), "node")
    held = _held_crowds(classes, crowded, lonely)
    rest = materialize(rest.unionByName(same_fp.select(F.xxhash64(F.lit("fp"), "fp").alias("key"), F.col("b").alias("node"))), "rest")
    for most in ROUNDS:
        rooted = heads.join(roots.withColumnRenamed("v", "head"), "head", "left").select(
            F.col("head").alias("node"), "fp", F.coalesce("root", "head").alias("root"))
        found = materialize(_unsettled(rest, held, linked, materialize(rooted, "rooted"), sides, least, most), "unsettled")
        if not found.limit(1).count():
            break
        more = _verified(found.select("a", "b").distinct(), chunks, least, text, shingle)
        verified = materialize(verified.unionByName(more), "verified")
        roots = components(verified)
        if not found.where("more").limit(1).count():
            break
    # A group's row is the one of smallest (doc, node) among the rows of all its sets.
    grouped = heads.join(roots.withColumnRenamed("v", "head"), "head", "left").select(
        "set", F.coalesce("root", "head").alias("root"))
    placed = materialize(rows.select("node", "chunk", "row", "doc", "set").join(grouped, "set"), "groups")
    order = F.struct(F.coalesce("doc", F.lit(-(1 << 63))).alias("doc"), "node")
    best = placed.groupBy("root").agg(F.min(order)["node"].alias("node"))
    gone = placed.select("node", "chunk", "row").join(best.select("node"), "node", "left_anti")
    answers = gone.groupBy("chunk").agg(F.collect_list("row").alias("gone"))

    def run(batches):
        for batch in batches:
            for data, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = chunk_rows(data)
                keep = np.ones(len(table), bool)
                keep[np.array(out or [], np.int64)] = False
                yield from table.filter(pa.array(keep)).to_batches(max_chunksize=2000)

    return answer_chunks(chunks, answers).select("rows", "gone").mapInArrow(run, docs.schema)


def _node():
    """One number for a row's chunk and place."""
    return F.shiftleft(F.shiftright("chunk", 32), 40) + F.shiftleft(F.col("chunk").bitwiseAND(0xFFFFFFFF), 20) + F.col("row")


def _judged(pairs: DataFrame, sides: DataFrame, test) -> DataFrame:
    """The pairs (a, b) whose values (``sides``: node, value) pass the test, which sees lists of both sides."""
    side = lambda name: sides.select(F.col("node").alias(name), F.col("value").alias(f"{name}_value"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_value", "b_value")

    def run(batches):
        for batch in batches:
            good = test(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _with_more_classes(classes: DataFrame, chunks: DataFrame, text: str, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """All classes (node, class), the crowded ones (class), and the rows with too few others (node); None for no rows.

    Rows that have a crowded class get ``MORE_CLASSES`` of each level, made again from their texts.
    """
    crowd = lambda c: materialize(c.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("class"), "crowded")
    crowded = crowd(classes)
    if crowded.isEmpty():
        return classes, crowded, None
    busy = materialize(classes.join(crowded, "class", "left_semi").select("node").distinct(), "busy")

    def run(batches):
        for nodes, texts in _texts(batches, text):
            made = [class_fingerprints(np.unique(shingle_hashes(t, shingle)), MORE_CLASSES) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(made, pa.list_(pa.int64()))], names=["node", "classes"])

    more = _asked(busy, chunks).mapInArrow(run, "node long, classes array<long>").select("node", F.explode("classes").alias("class"))
    classes = materialize(classes.unionByName(more).distinct(), "classes")
    crowded = crowd(classes)
    rare = classes.join(busy, "node", "left_semi").join(crowded, "class", "left_anti").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    # Both levels count, and a pair has one of them in common at least.
    lonely = busy.join(rare.where(F.col("n") >= 2 * QUIET), "node", "left_anti")
    return classes, crowded, materialize(lonely, "lonely")


def _held_crowds(classes: DataFrame, crowded: DataFrame, lonely: DataFrame | None) -> DataFrame | None:
    """(key, node, lonely): the rows of the crowded classes that hold a lonely row."""
    if lonely is None or lonely.isEmpty():
        return None
    rows = classes.join(crowded, "class", "left_semi").join(lonely.withColumn("own", F.lit(True)), "node", "left")
    rows = rows.select("class", "node", F.coalesce("own", F.lit(False)).alias("lonely"))
    some = rows.where("lonely").select("class").distinct()
    return materialize(rows.join(some, "class", "left_semi").select(F.xxhash64(F.lit("class"), "class").alias("key"), "node", "lonely"), "held")


def _crowd_cells(held: DataFrame, rooted: DataFrame) -> DataFrame:
    """Members of cells (key, x, y) where a block of lonely rows (block 0) meets a block of all rows of its class (block 1)."""
    members = held.join(rooted.select("node", "root"), "node")
    sizes = members.groupBy("key").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("all"), F.ceil(F.count(F.when(F.col("lonely"), 1)) / BLOCK).cast("int").alias("own"))
    members = members.join(sizes, "key")
    dealt = lambda name: F.pmod(F.xxhash64("node"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.expr(f"sequence(0, {name} - 1)"))
    asking = members.where("lonely").withColumn("x", dealt("own")).withColumn("y", every("all")).withColumn("block", F.lit(0))
    others = members.withColumn("y", dealt("all")).withColumn("x", every("own")).withColumn("block", F.lit(1))
    return asking.unionByName(others).select("key", "node", "root", "block", "x", (-1 - F.col("y")).alias("y"))


def _unsettled(rest: DataFrame, held: DataFrame | None, linked: DataFrame, rooted: DataFrame, sides: DataFrame, least: float, most: int) -> DataFrame:
    """(a, b, more): pairs of a bucket that are in different groups and that their profiles do not rule out.

    Buckets: ``rest`` (key, node), the rows of both fingerprints of a link, and ``held`` (crowded classes, where only lonely
    rows meet the others). Those of one group are left out; the others are compared block by block, and no pair
    becomes a row before its profiles are compared. A row names its ``most`` likeliest partners per pair of blocks;
    ``more`` says that it has others.
    """
    sizes = rooted.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    side = lambda name: sizes.select(F.col("fp").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "lo", "hi")))
    both = linked.join(side("a"), "a").join(side("b"), "b").where("a_n + b_n > 2").where(
        F.least("a_lo", "b_lo") != F.greatest("a_hi", "b_hi"))
    both = both.select(F.xxhash64(F.lit("link"), "a", "b").alias("key"), F.explode(F.array("a", "b")).alias("fp"))
    members = rest.join(rooted.select("node", "root"), "node").select("key", "node", "root").unionByName(
        both.join(rooted, "fp").select("key", "node", "root"))
    members = materialize(members, "members")
    mixed = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(
        "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "key", "node", "root", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    if held is not None:
        placed = placed.unionByName(_crowd_cells(held, rooted))
    cells = placed.join(sides, "node").groupBy("key", "x", "y").agg(
        F.collect_list(F.struct("node", "root", "block", "value")).alias("cell"))

    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for at, across in enumerate((batch.column(0).to_numpy() != batch.column(1).to_numpy()).tolist()):
                node, root, block, value = batch.column(2)[at].values.flatten()
                node, root, block = node.to_numpy(), root.to_numpy(), block.to_numpy()
                sizes, bins, over = unpacked(value.to_pylist())
                order = np.argsort(sizes, kind="stable")
                node, root, block, sizes, bins, over = (v[order] for v in (node, root, block, sizes, bins, over))
                # The smaller set has at least this share of the larger; one less leaves room for rounding.
                starts = np.searchsorted(sizes, least * sizes - 1)
                for i, start in enumerate(starts.tolist()):
                    apart = root[start:i] != root[i]
                    if across:
                        apart &= block[start:i] != block[i]
                    near = start + np.flatnonzero(apart)
                    if not len(near):
                        continue
                    bound = most_similarity((sizes[near], bins[near], over[near]), (sizes[i], bins[i], over[i]))
                    good = np.flatnonzero(bound >= least)
                    more = len(good) > most
                    if more:
                        good = good[np.argsort(-bound[good], kind="stable")[:most]]
                    partners = node[near[good]]
                    out[0].append(np.minimum(partners, node[i]))
                    out[1].append(np.maximum(partners, node[i]))
                    out[2].append(np.full(len(good), more))
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                              pa.array(columns[2].astype(bool), pa.bool_())], names=["a", "b", "more"])

    return cells.select("x", "y", "cell").mapInArrow(run, "a long, b long, more boolean")


def _verified(likely: DataFrame, chunks: DataFrame, least: float, text: str, shingle: int) -> DataFrame:
    """The candidate pairs of enough similarity, by the sets made again from their texts."""
    nodes = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()

    def run(batches):
        for asked, texts in _texts(batches, text):
            sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(sets, pa.binary())], names=["node", "value"])

    sets = materialize(_asked(nodes, chunks).mapInArrow(run, "node long, value binary"), "sets")
    return _judged(likely, sets, lambda x, y: [similarity(p, q) >= least for p, q in zip(x, y)])


def _asked(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rows, asked): the chunks with the numbers of the wanted rows (node) in each."""
    chunk = F.shiftleft(F.shiftright("node", 40), 32) + F.shiftright("node", 20).bitwiseAND((1 << 20) - 1)
    asked = nodes.select(chunk.alias("chunk"), F.col("node").bitwiseAND((1 << 20) - 1).alias("row"), "node")
    asked = asked.groupBy("chunk").agg(F.collect_list(F.struct("row", "node")).alias("asked"))
    return answer_chunks(chunks, asked).select("rows", "asked")


def _texts(batches, text: str):
    """Numbers and texts of the wanted rows, chunk by chunk."""
    for batch in batches:
        for data, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if wanted:
                texts = column_bytes(chunk_rows(data)[text].combine_chunks())
                yield [w["node"] for w in wanted], [texts[w["row"]] for w in wanted]
