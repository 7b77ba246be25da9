"""Merkle dataset manifest by bitmap ranks: every row is a leaf, every group a tree, and the groups' roots a tree.

In a group, leaves ascend by key. Two consecutive nodes become one, the last one by itself where their number is odd,
until one is left: the group's root. The group roots, ordered by group (null first, then by bytes), likewise give the root of
the table. A node is the hexadecimal SHA-256 of its children's digests as text.

Nothing sorts the leaves. Tasks collect the keys of each group in compressed bitmaps of 2^13 keys, which are merged by
(group, block of keys). The running total of the blocks' rows is where a block begins; a directory of counts of set bits
within the bitmap gives the rest of a leaf's coordinate. Leaves then go into slots of arrays of 1,024, keyed by the upper
part of the coordinate, and an array is reduced by ten levels at once. As many rounds follow as the largest group needs;
siblings come back down the same arrays, a path per array, and meet the leaves in the array of the first round.

A null group is a group of its own, before all others. Leaves with a null key come first in their group. Rows with equal
keys are ordered by their digests; rows that are equal altogether have leaves next to each other. Blocks with such rows
(their bitmap has fewer bits than rows) take the coordinates within from a distributed rank; all others from the bitmap.
A table without rows has no root and gives no rows. A group held by most rows is spread over its blocks and arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.tables import blob, small_batches, unblob
from vecatlas.operators.ranking import prefix_sum, row_index
from vecatlas.session import materialize

BLOCK_BITS, LEVELS = 13, 10
_BLOCK, _SLOTS = 1 << BLOCK_BITS, 1 << LEVELS
_HELD = 1024
_GROUP = ["known", "grp"]
_KEYS = [*_GROUP, "block"]
_ARRAYS = "gid long, chunk long, total long, slots binary, keys binary, leaves binary, claims binary, n int, n_claims int, known boolean, grp string"


def field(column: Column) -> Column:
    """A value as hashed: `-` for null, else its length in UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*columns: Column) -> Column:
    """The digest of a row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def reduced(nodes: list[bytes], total: int) -> list[list[bytes]]:
    """The levels above an array's nodes, itself first; ``total`` is how many nodes the whole tree has on that level."""
    levels = [nodes]
    for _ in range(LEVELS):
        if total <= 1:
            break
        last = levels[-1]
        levels.append([parent(last[i : i + 2]) for i in range(0, len(last), 2)])
        total = (total + 1) // 2
    return levels


def siblings(levels: list[list[bytes]], slot: int) -> tuple[bytes, bytes]:
    """Siblings of the node at ``slot`` up to the array's last level, and where they stand on each one: 0 none, 1 left, 2 right."""
    found, sides = [], bytearray()
    for nodes in levels[:-1]:
        other = slot ^ 1
        there = other < len(nodes)
        if there:
            found.append(nodes[other])
        sides.append((1 if other < slot else 2) if there else 0)
        slot >>= 1
    return b"".join(found), bytes(sides)


def folded(node: bytes, proof: bytes, sides: bytes) -> bytes:
    """The root that a node and its siblings lead to."""
    at = 0
    for side in sides:
        if side:
            other, at = proof[at : at + 32], at + 32
            node = parent([other, node] if side == 1 else [node, other])
        else:
            node = parent([node])
    return node


def _pieces(data: bytes) -> list[bytes]:
    return [data[i : i + 32] for i in range(0, len(data), 32)]


def _bitmaps(rows: DataFrame) -> DataFrame:
    """(known, grp, block, n_rows, n_keys, bits): merged bitmaps of the keys in each block of a group."""
    def collect(batches):
        held = {}

        def out():
            keys = list(held)
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(zip(*keys), (pa.bool_(), pa.string(), pa.int64()))),
                 pa.array([v[1] for v in held.values()], pa.int64()), pa.array([blob(np.packbits(v[0], bitorder="little")) for v in held.values()], pa.binary())],
                names=[*_KEYS, "n_rows", "bits"])

        for batch in batches:
            known, grp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).dictionary_encode()
            codes, names = grp.indices.to_numpy(), grp.dictionary.to_pylist()
            block, low = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            order = np.lexsort((block, codes, known))
            new = (np.diff(block[order], prepend=0) != 0) | (np.diff(codes[order], prepend=0) != 0) | (np.diff(known[order].astype(np.int8), prepend=0) != 0)
            new[:1] = True
            starts = np.flatnonzero(new)
            for lo, hi in zip(starts, [*starts[1:], len(order)]):
                i = order[lo]
                key = bool(known[i]), names[codes[i]], int(block[i])
                if key not in held:
                    if len(held) >= _HELD:
                        yield out()
                        held.clear()
                    held[key] = [np.zeros(_BLOCK, np.uint8), 0]
                held[key][0][low[order[lo:hi]]] = 1
                held[key][1] += int(hi - lo)
        if held:
            yield out()

    def merge(key, table):
        bits = np.zeros(_BLOCK // 8, np.uint8)
        for data in table.column("bits").to_pylist():
            bits |= unblob(data, _BLOCK // 8, np.uint8)
        return pa.table({**{k: pa.array([v.as_py()], t) for k, v, t in zip(_KEYS, key, (pa.bool_(), pa.string(), pa.int64()))},
                         "n_rows": pa.array([int(np.sum(table.column("n_rows").to_numpy()))], pa.int64()),
                         "n_keys": pa.array([int(np.bitwise_count(bits).sum())], pa.int64()), "bits": pa.array([blob(bits)], pa.binary())})

    partial = rows.select(*_KEYS, "low").mapInArrow(collect, "known boolean, grp string, block long, n_rows long, bits binary")
    return partial.groupBy(*_KEYS).applyInArrow(merge, "known boolean, grp string, block long, n_rows long, n_keys long, bits binary")


def ranks(bits: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many set bits stand before each place: a directory of the words' counts, and the rest of the word."""
    words = bits.view(np.uint64)
    counts = np.bitwise_count(words).astype(np.int64)
    directory = np.cumsum(counts) - counts
    word = low >> 6
    before = (np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1)
    return directory[word] + np.bitwise_count(words[word] & before)


def _placed(known: bool, grp: str, gid: int, total: int, place: np.ndarray, keys: pa.Array, leaves: pa.Array, claims: pa.Array) -> pa.Table:
    """Leaves at their coordinates as parts of slot arrays, a row per array."""
    chunk = place >> LEVELS
    order = np.argsort(chunk, kind="stable")
    starts = np.flatnonzero(np.diff(chunk[order], prepend=-1))
    digests, claimed = leaves.to_pylist(), claims.to_pylist()
    given = keys.is_valid().to_numpy(zero_copy_only=False)
    numbers = keys.fill_null(0).to_numpy(zero_copy_only=False)
    out = {name: [] for name in ("chunk", "slots", "keys", "leaves", "claims", "n", "n_claims")}
    for lo, hi in zip(starts, [*starts[1:], len(order)]):
        at = order[lo:hi]
        slots = (place[at] & (_SLOTS - 1)).astype(np.int64)
        other = [(int(s), claimed[i]) for s, i in zip(slots, at) if claimed[i] is not None]
        row = (int(chunk[at[0]]), blob(np.concatenate([slots, given[at]])), blob(numbers[at].astype(np.int64)), b"".join(digests[i] for i in at),
               b"".join(s.to_bytes(2, "little") + c for s, c in other), len(at), len(other))
        for name, value in zip(out, row):
            out[name].append(value)
    n = len(out["chunk"])
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
    columns = {name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)}
    return pa.table({"gid": pa.array([gid] * n, pa.int64()), "chunk": columns.pop("chunk"), "total": pa.array([total] * n, pa.int64()), **columns,
                     "known": pa.array([known] * n, pa.bool_()), "grp": pa.array([grp] * n, pa.string())})


def _by_bitmap(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Slot arrays of the leaves in blocks without repeated keys."""
    def place(key, left, right):
        if not right.num_rows or not left.num_rows:
            return _EMPTY
        low = left.column("low").to_numpy()
        (start,), (gid,), (total,) = (right.column(c).to_pylist() for c in ("start", "gid", "total"))
        at = start + ranks(unblob(right.column("bits")[0].as_py(), _BLOCK // 8, np.uint8), low)
        return _placed(key[0].as_py(), key[1].as_py(), gid, total, at, *(left.column(c).combine_chunks() for c in ("key", "leaf", "claim")))

    return rows.groupBy(*_KEYS).cogroup(blocks.groupBy(*_KEYS)).applyInArrow(place, _ARRAYS)


def _by_rank(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Slot arrays of the leaves in blocks with repeated or null keys."""
    own = rows.join(blocks.select(*_KEYS, "gid", "total", "start"), _KEYS)
    indexed, _ = row_index(own, ["gid", "block", "key", "leaf"], "place")
    first = indexed.groupBy("gid", "block").agg(F.min("place").alias("first"))
    placed = indexed.join(first, ["gid", "block"]).withColumn("place", F.col("place") - F.col("first") + F.col("start"))

    def place(batches):
        for batch in batches:
            gids = batch.column("gid").to_numpy()
            for gid in np.unique(gids):
                part = batch.filter(pa.array(gids == gid))
                yield from _placed(*(part.column(c)[0].as_py() for c in ("known", "grp", "gid", "total")), part.column("place").to_numpy(),
                                   *(part.column(c) for c in ("key", "leaf", "claim"))).to_batches()

    return placed.select(*_GROUP, "gid", "total", "place", "key", "leaf", "claim").mapInArrow(place, _ARRAYS)


_SCHEMA = pa.schema([("gid", pa.int64()), ("chunk", pa.int64()), ("total", pa.int64()), ("slots", pa.binary()), ("keys", pa.binary()), ("leaves", pa.binary()),
                     ("claims", pa.binary()), ("n", pa.int32()), ("n_claims", pa.int32()), ("known", pa.bool_()), ("grp", pa.string())])
_EMPTY = _SCHEMA.empty_table()


def _assembled(parts: DataFrame) -> DataFrame:
    """Whole slot arrays, their leaves in order, and the node that each is reduced to."""
    def whole(key, table):
        rows = table.to_pylist()
        n = sum(r["n"] for r in rows)
        numbers, given, leaves = np.zeros(n, np.int64), np.zeros(n, np.int64), [b""] * n
        for r in rows:
            slots = unblob(r["slots"], 2 * r["n"], np.int64)
            at = slots[: r["n"]]
            given[at], numbers[at] = slots[r["n"] :], unblob(r["keys"], r["n"], np.int64)
            for slot, leaf in zip(at.tolist(), _pieces(r["leaves"])):
                leaves[slot] = leaf
        r = rows[0]
        made = {"slots": blob(np.concatenate([np.arange(n), given])), "keys": blob(numbers), "leaves": b"".join(leaves), "claims": b"".join(x["claims"] for x in rows),
                "n": n, "n_claims": sum(x["n_claims"] for x in rows)}
        filled = pa.Table.from_pylist([{**r, **made}], schema=_SCHEMA)
        return filled.append_column("node", pa.array([reduced(leaves, r["total"])[-1][0]], pa.binary()))

    return parts.groupBy("gid", "chunk").applyInArrow(whole, f"{_ARRAYS}, node binary")


def _round(nodes: DataFrame) -> DataFrame:
    """Arrays of nodes (gid, idx, total, node) by (gid, chunk), and the node of each."""
    def whole(key, table):
        rows = table.select(["idx", "total", "node"]).to_pydict()
        inside = [b""] * len(rows["idx"])
        for idx, node in zip(rows["idx"], rows["node"]):
            inside[idx & (_SLOTS - 1)] = node
        total = rows["total"][0]
        return pa.table({"gid": pa.array([key[0].as_py()], pa.int64()), "chunk": pa.array([key[1].as_py()], pa.int64()),
                         "total": pa.array([total], pa.int64()), "nodes": pa.array([b"".join(inside)], pa.binary()),
                         "node": pa.array([reduced(inside, total)[-1][0]], pa.binary())})

    keyed = nodes.withColumn("chunk", F.shiftright("idx", LEVELS))
    return materialize(keyed.groupBy("gid", "chunk").applyInArrow(whole, "gid long, chunk long, total long, nodes binary, node binary"), "nodes")


def _above(arrays: DataFrame) -> DataFrame:
    """The arrays' nodes as the next round's input."""
    fewer = F.ceil(F.col("total") / F.lit(_SLOTS)).cast("long")
    return arrays.select("gid", F.col("chunk").alias("idx"), fewer.alias("total"), "node")


def _down(arrays: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths (siblings, sides) of the nodes in the arrays, from the paths of the arrays' own nodes."""
    def expand(batches):
        for batch in batches:
            out = {name: [] for name in ("gid", "chunk", "path", "sides")}
            for r in batch.to_pylist():
                levels = reduced(_pieces(r["nodes"]), r["total"])
                for slot in range(len(levels[0])):
                    path, sides = siblings(levels, slot)
                    for name, value in zip(out, (r["gid"], (r["chunk"] << LEVELS) + slot, path + r["path"], sides + r["sides"])):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out.values(), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=list(out))

    both = arrays.join(paths, ["gid", "chunk"]).select("gid", "chunk", "total", "nodes", "path", "sides")
    return both.mapInArrow(expand, "gid long, chunk long, path binary, sides binary")


def _tree(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """The arrays of all rounds over nodes (gid, idx, total, node), first round first, and what remains of each tree."""
    rounds = []
    while largest > 1:
        rounds.append(_round(nodes))
        nodes, largest = _above(rounds[-1]), -(-largest // _SLOTS)
    return rounds, nodes


def merkle_manifest(rows: DataFrame, key: str, group: str, leaf: Column, claim: Column | None = None) -> DataFrame:
    """(key, grp, position, leaf, subroot, root, proof, sides, folded): one row per row of ``rows``; digests are binary.

    ``key`` is a whole number, ``group`` a string, ``leaf`` a digest of 32 bytes. ``proof`` has the siblings of all levels up
    to the root, 32 bytes each, and ``sides`` a byte per level: 0 without a sibling, 1 where it stands on the left, 2 on
    the right. ``folded`` is the root that ``claim`` (the leaf, where it is null) and the proof lead to.
    """
    spark = rows.sparkSession
    small_batches(spark)
    number = F.col(key).cast("long")
    staged = materialize(rows.select(
        F.col(group).isNotNull().alias("known"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp"),
        F.coalesce(F.shiftright(number, BLOCK_BITS), F.lit(-(1 << 63))).alias("block"),
        F.coalesce(number.bitwiseAND(F.lit(_BLOCK - 1)), F.lit(0)).cast("int").alias("low"),
        number.alias("key"), leaf.alias("leaf"), (claim if claim is not None else F.lit(None).cast("binary")).alias("claim")), "leaves")
    bitmaps = prefix_sum(_bitmaps(staged), _KEYS, "n_rows", "start")
    bitmaps = materialize(bitmaps, "bitmaps")
    totals = bitmaps.groupBy(*_GROUP).agg(F.min("start").alias("base"), F.sum("n_rows").alias("total"))
    groups, n_groups = row_index(totals, _GROUP, "gid")
    groups = materialize(groups, "groups")
    blocks = bitmaps.join(groups, _GROUP).withColumn("start", F.col("start") - F.col("base"))
    blocks = materialize(blocks.select(*_KEYS, "gid", "total", "start", "bits", ((F.col("n_rows") != F.col("n_keys")) | (F.col("block") == -(1 << 63))).alias("tied")), "blocks")

    tied = blocks.where("tied")
    if tied.isEmpty():
        parts = _by_bitmap(staged, blocks)
    else:
        plain = staged.join(tied.select(*_KEYS), _KEYS, "left_anti")
        parts = _by_bitmap(plain, blocks.where("not tied")).unionByName(_by_rank(staged, tied))
    arrays = materialize(_assembled(parts), "arrays")

    largest = groups.agg(F.max("total")).first()[0] or 0
    rounds, subroots = _tree(_above(arrays), -(-largest // _SLOTS))
    subroots = subroots.select("gid", F.col("node").alias("subroot"))
    top, roots = _tree(subroots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("idx"), F.lit(n_groups).cast("long").alias("total"), F.col("subroot").alias("node")), n_groups)
    root = (roots.first() or {"node": b""})["node"]

    empty = F.lit(b"")
    paths = roots.select("gid", F.col("idx").alias("chunk"), empty.alias("path"), empty.alias("sides"))
    for level in reversed(top):
        paths = _down(level, paths)
    paths = paths.select(F.col("chunk").alias("gid"), F.lit(0).cast("long").alias("chunk"), "path", "sides")
    for level in reversed(rounds):
        paths = _down(level, paths)
    paths = paths.join(subroots, "gid")

    def prove(batches):
        for batch in batches:
            for r in batch.to_pylist():
                leaves, n = _pieces(r["leaves"]), r["n"]
                levels = reduced(leaves, r["total"])
                slots, keys = unblob(r["slots"], 2 * n, np.int64), unblob(r["keys"], n, np.int64)
                claims = {int.from_bytes(r["claims"][i : i + 2], "little"): r["claims"][i + 2 : i + 34] for i in range(0, len(r["claims"]), 34)}
                proofs = [siblings(levels, slot) for slot in range(n)]
                proofs = [(p + r["path"], s + r["sides"]) for p, s in proofs]
                ends = [folded(claims.get(i, node), *proofs[i]) for i, node in enumerate(leaves)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=slots[n:] == 0), pa.array([r["grp"] if r["known"] else None] * n, pa.string()),
                     pa.array((r["chunk"] << LEVELS) + np.arange(n), pa.int64()), pa.array(leaves, pa.binary()), pa.array([r["subroot"]] * n, pa.binary()),
                     pa.array([root] * n, pa.binary()), pa.array([p for p, _ in proofs], pa.binary()), pa.array([s for _, s in proofs], pa.binary()),
                     pa.array(ends, pa.binary())], names=["key", "grp", "position", "leaf", "subroot", "root", "proof", "sides", "folded"])

    # Paths are about a kilobyte for each array of 1,024 leaves.
    both = arrays.join(paths.hint("shuffle_hash"), ["gid", "chunk"])
    return both.select("gid", "chunk", "total", "slots", "keys", "leaves", "claims", "n", "known", "grp", "path", "sides", "subroot").mapInArrow(
        prove, "key long, grp string, position long, leaf binary, subroot binary, root binary, proof binary, sides binary, folded binary")


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, with a change of n_chars where 7 divides the CRC-32 of the id; digests in hexadecimal."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = digest(*map(F.col, fields))
    changed = digest(*(F.try_add(F.col(f), F.lit(1)) if f == "n_chars" else F.col(f) for f in fields))
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    made = merkle_manifest(docs, "doc_id", "lang", leaf, F.when(hit, changed))
    text = lambda c: F.lower(F.hex(c))
    return made.select(
        F.col("key").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
