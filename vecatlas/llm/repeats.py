"""Suffix-array dedup: remove every byte of a passage that stands earlier in the corpus, exactly.

Any two equal strings of ``LENGTH`` bytes hold the same anchor at the same place: of the windows' K-byte substrings
the one of least hash (the last of equals). Only anchors are sent around, about one in forty bytes.

1. Rows are packed into chunks. Each chunk sends the hashes of its anchors, each once, to hash buckets, and hears
   which of them occur elsewhere too.
2. Around a repeated anchor stand the ``LENGTH``-byte strings that it represents (consecutive starts). They are
   sent as one passage of at most 2 * LENGTH - K bytes to the anchor's bucket; a passage that its own chunk has
   sent before, byte for byte, is answered at once.
3. A bucket sorts its passages as suffixes from their anchors: a mergesort whose comparisons find the common
   extension of two suffixes by binary search over prefix polynomial hashes, so comparing takes a logarithmic
   number of steps. Neighbours' common extensions cut the order into groups that agree on the first 100 - j bytes
   from the anchor; with the j bytes before it, by hash, these are the groups of equal strings. All but the
   earliest string of each are removed, after comparing their bytes.
4. The answers (spans) return to the chunks. Texts are never shuffled.

An anchor that more than ``CROWD`` chunks hold sends its strings one by one, by their own 128-bit hashes, so that a
passage with ever different surroundings does not gather in one bucket. Between chunks these strings, and only these,
are equal by hash alone: their bytes are not sent.

Memory: a task holds one chunk, or one bucket; there are eight buckets per shuffle partition, so buckets stay small
if ``spark.sql.shuffle.partitions`` grows with the input, as it should for Spark's own shuffles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecatlas.llm.tables import NO_ID, answer_chunks, blob, chunk_rows, column_bytes, free_name, partitions, unblob, write_chunks
from vecatlas.session import materialize

LENGTH = 100
K = 20
BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 18
CHUNK = 4 << 20
CROWD = 4096
_PLACE = 24  # low bits that hold a place inside a block
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Prefixes:
    """Prefix polynomial hashes (modulo 2^64) of a byte array; any substring's hash is one subtraction.

    Bytes go in through a random table, and the results are mixed before use as a key.
    """

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _powers(1 << int(len(data)).bit_length())
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.inverse[start]


_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if n not in _POWERS:
        _POWERS[n] = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[n].append(np.multiply.accumulate(steps))
    return _POWERS[n]


_BYTES = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class Texts:
    """The texts of a chunk as one byte array, in the order that decides which of two strings is earlier."""

    def __init__(self, table: pa.Table, doc_id: str, text: str):
        ids = np.array([NO_ID if x is None else int(x) for x in table[doc_id].to_pylist()], np.int64)
        self.rows = np.lexsort((np.arange(len(ids)), ids))  # place in order -> row of the chunk
        texts = column_bytes(table[text].combine_chunks())
        self.ids = ids[self.rows]
        texts = [texts[r] for r in self.rows]
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, "right") - 1


def anchors(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, last start) of the anchors of all strings of LENGTH bytes, by place in the data.

    The strings that begin from the first to the last start have the anchor at ``place`` in common.
    """
    width, found = LENGTH - K + 1, []
    for base in range(0, len(texts.data), BLOCK):
        part = texts.data[base : base + BLOCK + LENGTH - 1]
        starts = len(part) - LENGTH + 1
        if starts <= 0:
            break
        hashes = _mixed(Prefixes(part).of(np.arange(len(part) - K + 1), K))
        low = np.uint64((1 << _PLACE) - 1)
        keys = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
        least, span = keys, 1  # the least of each window, by doubling
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:starts], least[width - span :][:starts])
        place = (low - (least & low)).astype(np.int64)
        at = np.arange(base, base + starts)
        ends = texts.bounds[texts.doc_of(at) + 1]
        place[at + LENGTH > ends] = -1  # no string begins here
        cut = np.flatnonzero(np.diff(place, prepend=-2))
        last = np.concatenate([cut[1:], [starts]]) - 1
        real = place[cut] >= 0
        cut, last = cut[real], last[real]
        # Anchors have the least hashes; mixed once more they are even again, as buckets need them.
        found.append((_mixed(hashes[place[cut]]), place[cut] + base, cut + base, last + base))
    if not found:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _own_hashes(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct hashes in order, whether it has them twice, and where each bucket's begin."""
    own, counts = np.unique(hashes, return_counts=True)
    return own, counts > 1, np.searchsorted(_bucket(own, buckets), np.arange(buckets + 1))


def _ask(chunks: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, twice, cuts = _own_hashes(anchors(Texts(chunk_rows(data), doc_id, text))[0], buckets)
                rows = [(b, chunk, hi - lo, own[lo:hi].tobytes(), np.packbits(twice[lo:hi]).tobytes())
                        for b, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if hi > lo]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                        names=["bucket", "chunk", "n", "hashes", "twice"])

    return chunks.select("chunk", "rows").mapInArrow(run, "bucket int, chunk long, n int, hashes binary, twice binary")


def _tell(table: pa.Table) -> pa.Table:
    """Per chunk: which of its hashes occur again (1) and which in more than CROWD chunks (2)."""
    hashes = np.frombuffer(b"".join(table["hashes"].to_pylist()), np.uint64)
    sizes = table["n"].to_numpy()
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(table["twice"].to_pylist(), sizes)])
    _, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    again = np.bincount(which, twice) + (counts > 1) > 0
    told = np.where(counts > CROWD, 2, again.astype(np.int64)).astype(np.uint8)[which]
    parts = np.split(told, np.cumsum(sizes)[:-1])
    return pa.Table.from_arrays([table["bucket"], table["chunk"], table["n"], pa.array([blob(p) for p in parts], pa.binary())],
                                names=["bucket", "chunk", "n", "told"])


PASSAGES = pa.schema([("hash", pa.uint64()), ("doc", pa.int64()), ("row", pa.int32()), ("start", pa.int64()), ("back", pa.int32()),
                      ("bytes", pa.binary())])
STRINGS = pa.schema([("g1", pa.uint64()), ("g2", pa.uint64()), ("doc", pa.int64()), ("row", pa.int32()), ("start", pa.int64())])
SPANS = pa.schema([("row", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_LOCAL, _PASSAGES, _STRINGS = 0, 1, 2


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _send(asked: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """(bucket, chunk, kind, data): passages and strings around repeated anchors, and what a chunk settles itself."""
    def run(batches):
        for batch in batches:
            for chunk, data, answers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                texts = Texts(chunk_rows(data), doc_id, text)
                hashes, place, lo, hi = anchors(texts)
                own, _, cuts = _own_hashes(hashes, buckets)
                told = np.zeros(len(own), np.uint8)
                for a in answers or []:
                    told[cuts[a["bucket"]] : cuts[a["bucket"] + 1]] = unblob(a["told"], a["n"], np.uint8)
                kind = told[np.searchsorted(own, hashes)]
                docs = texts.doc_of(place)
                whole = texts.data.tobytes()
                seen, out, strings, local = {}, [], [], []  # seen: where a passage or string was sent from
                for i in np.flatnonzero(kind).tolist():
                    begin, end, doc = int(lo[i]), int(hi[i]), int(docs[i])
                    row, zero = int(texts.rows[doc]), int(texts.bounds[doc])
                    passage = whole[begin : end + LENGTH]
                    key = (int(place[i]) - begin, xxhash.xxh3_128_digest(passage))
                    first = seen.setdefault(key, begin)
                    if first < begin and whole.startswith(passage, first):
                        local.append((row, begin - zero, end - zero + LENGTH))
                        continue
                    if kind[i] == 1:
                        out.append((int(hashes[i]), int(texts.ids[doc]), row, begin - zero, int(place[i]) - begin, passage))
                    else:
                        for start in range(begin, end + 1):
                            string = whole[start : start + LENGTH]
                            g = xxhash.xxh3_128_digest(string)
                            first = seen.setdefault(g, start)
                            if first < start and whole.startswith(string, first):
                                local.append((row, start - zero, start - zero + LENGTH))
                            else:
                                strings.append((*np.frombuffer(g, np.uint64).tolist(), int(texts.ids[doc]), row, start - zero))
                rows = []
                for name, found, schema in ((_LOCAL, local, SPANS), (_PASSAGES, out, PASSAGES), (_STRINGS, strings, STRINGS)):
                    if found:
                        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
                        to = _bucket(table.column(0).to_numpy(), buckets) if name != _LOCAL else np.full(len(table), chunk % buckets)
                        order = np.argsort(to, kind="stable")
                        table, to = table.take(order), to[order]
                        edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
                        rows += [(int(to[a]), chunk, name, _packed(table.slice(a, b - a))) for a, b in zip(edges[:-1], edges[1:])]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                        names=["bucket", "chunk", "kind", "data"])

    return asked.select("chunk", "rows", "told").mapInArrow(run, "bucket int, chunk long, kind int, data binary")


class Suffixes:
    """Suffixes of passages from their anchors to the passages' ends, in one byte array."""

    def __init__(self, data: np.ndarray, at: np.ndarray, end: np.ndarray):
        self.data, self.at, self.end, self.prefixes = data, at, end, Prefixes(data)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y: binary search over prefix hashes."""
        a, b = self.at[x], self.at[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.end[x] - a, self.end[y] - b)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.prefixes.of(a, middle) == self.prefixes.of(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before suffix y; of equal ones, or with one a prefix of the other, the shorter first."""
        shared = self.common(x, y)
        a, b = self.at[x] + shared, self.at[y] + shared
        over_x, over_y = a >= self.end[x], b >= self.end[y]
        last = len(self.data) - 1
        less = self.data[np.minimum(a, last)] < self.data[np.minimum(b, last)]
        return np.where(over_x | over_y, over_x & (~over_y | (x < y)), less)

    def sort(self, segments: np.ndarray) -> np.ndarray:
        """The suffixes sorted within each segment (equal, adjacent numbers): a bottom-up mergesort.

        All merges of one width run together: an element's place is its place in its own run plus the number of
        elements of the sibling run before it, found by binary search.
        """
        n = len(segments)
        order = np.arange(n)
        start = np.flatnonzero(np.diff(segments, prepend=-1))
        size = np.diff(np.append(start, n))
        begin, total = np.repeat(start, size), np.repeat(size, size)
        width = 1
        while width < total.max(initial=0):
            inside = np.arange(n) - begin
            block = inside // (2 * width) * (2 * width)
            on_left = inside - block < width
            low = np.where(on_left, block + width, block)
            high = np.where(on_left, np.minimum(block + 2 * width, total), block + width)
            low = np.minimum(low, high)
            first = low.copy()
            todo = np.flatnonzero(low < high)
            while len(todo):
                middle = (low[todo] + high[todo]) // 2
                rival, mine = order[begin[todo] + middle], order[todo]
                ahead = self.before(rival, mine)
                low[todo] = np.where(ahead, middle + 1, low[todo])
                high[todo] = np.where(ahead, high[todo], middle)
                todo = todo[low[todo] < high[todo]]
            own = inside - np.where(on_left, block, block + width)
            to = begin + block + own + (low - first)
            merged = np.empty_like(order)
            merged[to] = order
            order, width = merged, width * 2
        return order


def repeated_starts(passages: list[bytes], back: np.ndarray, segments: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """For each passage the places in it where a string begins that is also in a passage of lower rank.

    Passages come sorted by segment (their anchor); ``back`` is the place of the anchor in the passage.
    """
    sizes = np.array([len(p) for p in passages], np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    suffixes = Suffixes(np.frombuffer(b"".join(passages), np.uint8), offset + back, offset + sizes)
    order = suffixes.sort(segments)
    shared = np.zeros(len(order), np.int64)  # with the suffix before
    same = np.flatnonzero(segments[order[1:]] == segments[order[:-1]]) + 1
    shared[same] = suffixes.common(order[same], order[same - 1])
    back, sizes, offset, rank = back[order], sizes[order], offset[order], rank[order]
    found_by, found_at = [], []
    for j in range(int(back.max(initial=-1)) + 1):  # bytes before the anchor
        # A string with j bytes before the anchor needs LENGTH - j from it on.
        group = np.cumsum(shared < LENGTH - j)
        active = np.flatnonzero((back >= j) & (back - j + LENGTH <= sizes))
        if len(active) < 2:
            continue
        starts = offset[active] + back[active] - j
        left = suffixes.prefixes.of(starts, j)
        by = np.lexsort((rank[active], left, group[active]))
        active, starts, left = active[by], starts[by], left[by]
        new = np.concatenate([[True], (np.diff(group[active]) != 0) | (left[1:] != left[:-1])])
        later = np.flatnonzero(~new)
        if not len(later):
            continue
        head = np.flatnonzero(new)[np.cumsum(new)[later] - 1]
        span = np.arange(LENGTH)
        equal = (suffixes.data[starts[later][:, None] + span] == suffixes.data[starts[head][:, None] + span]).all(1)
        for k in later[~equal].tolist():  # a hash collision: compare with all before it in the group
            h = int(np.flatnonzero(new[: k + 1])[-1])
            string = lambda i: suffixes.data[starts[i] : starts[i] + LENGTH].tobytes()
            if any(string(i) == string(k) for i in range(h, k)):
                found_by.append(order[active[[k]]])
                found_at.append((back[active] - j)[[k]])
        found_by.append(order[active[later[equal]]])
        found_at.append((back[active] - j)[later[equal]])
    out = [np.zeros(0, np.int64)] * len(passages)
    if found_by:
        who, where = np.concatenate(found_by), np.concatenate(found_at)
        by = np.lexsort((where, who))
        who, where = who[by], where[by]
        cuts = np.flatnonzero(np.diff(who, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(who))):
            out[int(who[a])] = where[a:b]
    return out


def _settle(table: pa.Table) -> pa.Table:
    """The spans to remove, per chunk, that follow from one bucket."""
    chunks, spans = [], []
    kinds, names, data = (table[c].to_pylist() for c in ("kind", "chunk", "data"))

    def read(kind: int) -> tuple[pa.Table, np.ndarray] | None:
        parts = [(n, chunk_rows(d)) for k, n, d in zip(kinds, names, data) if k == kind]
        if not parts:
            return None
        return pa.concat_tables([t for _, t in parts]).combine_chunks(), np.repeat([n for n, _ in parts], [len(t) for _, t in parts])

    def say(chunk, row, start, end):
        chunks.append(np.asarray(chunk, np.int64))
        spans.append(np.stack([np.asarray(x, np.int64) for x in (row, start, end)]))

    if local := read(_LOCAL):
        say(local[1], *(local[0][c].to_numpy() for c in ("row", "start", "end")))
    if strings := read(_STRINGS):
        t, chunk = strings
        g1, g2, doc, row, start = (t[c].to_numpy() for c in ("g1", "g2", "doc", "row", "start"))
        by = np.lexsort((start, row, chunk, doc, g2, g1))
        later = by[1:][(g1[by[1:]] == g1[by[:-1]]) & (g2[by[1:]] == g2[by[:-1]])]
        say(chunk[later], row[later], start[later], start[later] + LENGTH)
    if sent := read(_PASSAGES):
        t, chunk = sent
        hashes, doc, row, start, back = (t[c].to_numpy() for c in ("hash", "doc", "row", "start", "back"))
        by = np.lexsort((start, row, chunk, doc, hashes))
        texts = t["bytes"].to_pylist()
        first: dict[tuple, int] = {}
        later, kept = [], []
        for i in by.tolist():
            key = (back[i], texts[i])
            if key in first:
                later.append(i)
            else:
                first[key] = i
                kept.append(i)
        later, kept = np.array(later, np.int64), np.array(kept, np.int64)
        length = np.array([len(x) for x in texts], np.int64)
        say(chunk[later], row[later], start[later], start[later] + length[later])
        counts = np.unique(hashes[kept], return_inverse=True, return_counts=True)
        kept = kept[counts[2][counts[1]] > 1]  # a passage alone with its anchor has nothing to repeat
        if len(kept):
            found = repeated_starts([texts[i] for i in kept], back[kept].astype(np.int64), np.unique(hashes[kept], return_inverse=True)[1],
                                    np.arange(len(kept)))
            for i, places in zip(kept.tolist(), found):
                if len(places):
                    cut = np.flatnonzero(np.diff(places, prepend=-9) != 1)
                    a, b = places[cut], places[np.append(cut[1:], len(places)) - 1]
                    say(np.full(len(a), chunk[i]), np.full(len(a), row[i]), start[i] + a, start[i] + b + LENGTH)
    if not chunks:
        return pa.Table.from_pydict({"chunk": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "spans": pa.array([], pa.binary())})
    chunk, all_spans = np.concatenate(chunks), np.concatenate(spans, axis=1)
    by = np.argsort(chunk, kind="stable")
    cuts = np.flatnonzero(np.diff(chunk[by], prepend=np.int64(-1)))
    parts = [all_spans[:, by[a:b]] for a, b in zip(cuts, np.append(cuts[1:], len(by)))]
    return pa.Table.from_arrays(
        [pa.array(chunk[by[cuts]]), pa.array([p.shape[1] for p in parts], pa.int32()), pa.array([blob(p) for p in parts], pa.binary())],
        names=["chunk", "n", "spans"])


def removed_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Every row with a ``removed`` column: the maximal spans (start, end; bytes of the UTF-8 text) to cut out.

    A byte goes if a string of LENGTH bytes over it also begins earlier: in a row of smaller doc_id (rows without
    one come first; of equal ids the order of reading decides), or earlier in the same text. Texts are judged as
    they are, not by what is left of others. Null and short texts lose nothing. Also returns the column's name.
    """
    spark, name = docs.sparkSession, free_name("removed", docs.columns)
    buckets = 8 * partitions(spark)
    chunks = write_chunks(docs, text, CHUNK)
    told = _ask(chunks, doc_id, text, buckets).groupBy("bucket").applyInArrow(
        lambda table: _tell(table), "bucket int, chunk long, n int, told binary")
    told = materialize(told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "told")).alias("told")), "told")
    sent = _send(answer_chunks(chunks, told), doc_id, text, buckets)
    spans = sent.groupBy("bucket").applyInArrow(lambda table: _settle(table), "chunk long, n int, spans binary")
    spans = materialize(spans.groupBy("chunk").agg(F.collect_list(F.struct("n", "spans")).alias("spans")), "spans")

    def run(batches):
        for batch in batches:
            for data, answers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = chunk_rows(data)
                sizes = np.array([len(t) for t in column_bytes(table[text].combine_chunks())], np.int64)
                zero = np.concatenate([[0], np.cumsum(sizes + 1)])  # a byte between texts keeps spans apart
                change = np.zeros(zero[-1] + 1, np.int32)
                for a in answers or []:
                    row, start, end = unblob(a["spans"], 3 * a["n"], np.int64).reshape(3, -1)
                    np.add.at(change, zero[row] + start, 1)
                    np.add.at(change, zero[row] + end, -1)
                edges = np.flatnonzero(np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0))
                starts, ends = edges[::2], edges[1::2]
                row = np.searchsorted(zero, starts, "right") - 1
                offsets = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(starts - zero[row]), pa.array(ends - zero[row])], names=["start", "end"])
                table = table.append_column(name, pa.ListArray.from_arrays(pa.array(offsets), pairs))
                yield from table.to_batches(max_chunksize=2000)

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(span))])
    return answer_chunks(chunks, spans).select("rows", "spans").mapInArrow(run, schema), name


def cut_out(text: bytes, spans: list[dict]) -> bytes:
    """The bytes outside the spans."""
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : s["start"]])
        at = s["end"]
    return b"".join([*kept, text[at:]])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    marked, name = removed_bytes(rows)

    def run(batches):
        for batch in batches:
            texts, spans = column_bytes(batch.column(1)), batch.column(2).to_pylist()
            rows = [(len(t), sum(s["end"] - s["start"] for s in cut), len(cut), hashlib.sha256(cut_out(t, cut)).hexdigest())
                    for t, cut in zip(texts, spans)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 4, kinds))],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.select("doc_id", "text", name).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
