"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is cut by the vocabulary's pattern; each distinct piece of a batch is encoded once. Pieces are bucketed by
length into padded matrices of ranks, one row per piece. In each round every unfinished row merges its leftmost
pair of least rank: ranks of all adjacent pairs come from one open-addressing hash table over (left, right), the
least column per row is taken, and the row is compacted over the gap. Decoding puts the tokens' bytes together.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecatlas.llm.tables import free_name, slices, small_batches

NO_RANK = np.int64(1 << 40)


#: Pieces with more bytes are merged one by one, all equal pairs of a round at once.
LONG = 1024


def read_ranks(path: str, pattern: str) -> dict:
    """The vocabulary file (a base64 piece and its rank per line) as plain lists and arrays."""
    with open(path) as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    bytes_of = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        bytes_of[rank] = piece
    # Any two tokens whose bytes make a token may merge, not only the pair it was learned from.
    splits = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
              if t[:i] in ranks and t[i:] in ranks]
    pairs = np.array(splits, np.int64).reshape(-1, 3).T
    return {"pattern": pattern, "bytes_of": bytes_of, "pairs": [np.ascontiguousarray(x) for x in pairs]}


class PairTable:
    """(left id, right id) -> merged id, which is also its rank; an open-addressing table in two arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        size = 1 << max(4, int(2 * len(left)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int64)
        keys = (left.astype(np.int64) << 32) | right
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slots[todo]
            first = np.unique(at, return_index=True)[1]  # one newcomer per slot
            won = first[self.keys[at[first]] == -1]
            self.keys[at[won]], self.values[at[won]] = keys[todo[won]], merged[todo[won]]
            left_over = np.ones(len(todo), bool)
            left_over[won] = False
            todo = todo[left_over]
            slots[todo] = (slots[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NO_RANK)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & self.mask
            found = self.keys[slots[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class ByteBpe:
    """Encoder and decoder of one vocabulary, made from what ``read_ranks`` returns."""

    def __init__(self, vocabulary: dict):
        self.pattern = regex.compile(vocabulary["pattern"])
        self.bytes_of: list[bytes] = vocabulary["bytes_of"]
        self.ranks = {piece: rank for rank, piece in enumerate(self.bytes_of) if piece}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = PairTable(*vocabulary["pairs"])

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and each piece's number of ids."""
        found: list = [None] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:  # a piece that is a token stays one
                found[i] = np.array([rank], np.int64)
            elif len(piece) > LONG:
                found[i] = self._encode_long(piece)
            else:
                rest.append(i)
        rest.sort(key=lambda i: len(pieces[i]))
        sizes = np.array([len(pieces[i]) for i in rest], np.int64)
        lo = 0
        while lo < len(rest):
            width = int(sizes[lo])
            top = width if width <= 16 else width + width // 4  # buckets of nearly equal lengths
            hi = min(int(np.searchsorted(sizes, top, "right")), lo + (1 << 21) // top)
            ids, n = self._encode_bucket([pieces[i] for i in rest[lo:hi]])
            for i, k, row in zip(rest[lo:hi], n, ids):
                found[i] = row[:k]
            lo = hi
        counts = np.array([len(x) for x in found], np.int64)
        return np.concatenate([np.zeros(0, np.int64), *found]), counts

    def _encode_long(self, piece: bytes) -> np.ndarray:
        """One long row: a round merges every pair of least rank, from the left.

        That equals one merge at a time as long as no merge makes a pair of lower rank; if one would, only the
        leftmost pair is merged in that round.
        """
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.get(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NO_RANK:
            at = np.flatnonzero(ranks == least)
            run = np.cumsum(np.diff(at, prepend=-2) != 1)  # of a run of overlapping pairs every second is free
            inside = np.arange(len(at)) - np.flatnonzero(np.diff(run, prepend=0))[run - 1]
            for chosen in (at[inside % 2 == 0], at[:1]):
                merged = ids.copy()
                merged[chosen] = least
                merged = np.delete(merged, chosen + 1)
                new = self.pairs.get(merged[:-1], merged[1:])
                if not len(new) or new.min() >= least or len(chosen) == 1:
                    break
            ids, ranks = merged, new
        return ids

    def _encode_bucket(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(p) for p in pieces], np.int64)
        width = int(n.max())
        filled = np.arange(width) < n[:, None]
        ids = np.full((len(pieces), width), -1, np.int64)
        ids[filled] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        if width < 2:
            return ids, n
        rank = np.full((len(pieces), width), NO_RANK, np.int64)  # of the pair that begins here
        inner = filled[:, 1:]
        rank[:, :-1][inner] = self.pairs.get(ids[:, :-1][inner], ids[:, 1:][inner])
        live, columns = np.arange(len(pieces)), np.arange(width)
        work, ranks, left = ids, rank, n
        done_ids = np.full_like(ids, -1)
        while True:
            at = ranks.argmin(axis=1)  # the leftmost of equals
            least = ranks[np.arange(len(at)), at]
            more = least != NO_RANK
            if not more.all():
                over = ~more
                done_ids[live[over], : work.shape[1]] = work[over]
                n[live[over]] = left[over]
                live, work, ranks, left, at, least = (x[more] for x in (live, work, ranks, left, at, least))
                if not len(live):
                    return done_ids, n
            rows = np.arange(len(live))
            # Compaction: all behind the pair moves one to the left.
            take = columns[: work.shape[1]] + (columns[: work.shape[1]] > at[:, None])
            take = np.minimum(take, work.shape[1] - 1)
            work, ranks = np.take_along_axis(work, take, 1), np.take_along_axis(ranks, take, 1)
            work[rows, at] = least
            left = left - 1
            past = left < work.shape[1]
            work[rows[past], left[past]], ranks[rows[past], left[past]] = -1, NO_RANK
            ranks[rows, left - 1] = NO_RANK
            back = np.flatnonzero(at > 0)
            ranks[back, at[back] - 1] = self.pairs.get(work[back, at[back] - 1], work[back, at[back]])
            ahead = np.flatnonzero(at < left - 1)
            ranks[ahead, at[ahead]] = self.pairs.get(work[ahead, at[ahead]], work[ahead, at[ahead] + 1])
            most = int(left.max())
            work, ranks = work[:, :most], ranks[:, :most]

    def encode_texts(self, texts: list[str], known: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        """Ids of each text; ``known`` keeps the pieces that are encoded already."""
        cuts = [self.pattern.findall(text) for text in texts]
        new = [p for p in dict.fromkeys(chain.from_iterable(cuts)) if p not in known]
        if new:
            ids, counts = self.encode_pieces([p.encode() for p in new])
            known.update(zip(new, np.split(ids.astype(np.int32), np.cumsum(counts)[:-1])))
        for cut in cuts:
            yield np.concatenate([known[p] for p in cut]) if cut else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def encode_column(batch: pa.RecordBatch, column: str, bpe: ByteBpe, known: dict, limit: int = 1 << 20,
                  most: int = 80_000) -> Iterator[np.ndarray]:
    """Ids of each row's text (null: none), some megabytes of text at a time."""
    held, size = [], 0
    for text in batch.column(column).to_pylist():
        held.append(text or "")
        size += len(held[-1])
        if size >= limit:
            yield from bpe.encode_texts(held, known)
            held, size = [], 0
            if len(known) > most:
                known.clear()
    yield from bpe.encode_texts(held, known)


def with_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text") -> tuple[DataFrame, str]:
    """All rows with an ``ids`` column (array of int) and its name; a null text has no ids."""
    name = free_name("ids", docs.columns)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path, pattern))  # as large as the vocabulary file

    def run(batches):
        bpe, known = ByteBpe(shared.value), {}
        for batch in batches:
            for piece, _ in slices(batch, batch.schema.get_field_index(text), 8 << 20):
                found = list(encode_column(piece, text, bpe, known))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                values = pa.array(np.concatenate([np.zeros(0, np.int32), *found]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([*piece.columns, ids], names=[*piece.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, schema), name


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded bytes."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path, pattern))

    def run(batches):
        bpe, known = ByteBpe(shared.value), {}
        decimal = [str(i) for i in range(len(bpe.bytes_of))]
        for batch in batches:
            for piece, _ in slices(batch, 1, 8 << 20):
                counts, texts, decoded = [], [], []
                for ids in encode_column(piece, text, bpe, known):
                    counts.append(len(ids))
                    texts.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
