"""Line dedup: range-partitioned line hashes, sorted by document and position, give keep bitmaps per document.

Only 128-bit hashes of line keys are shuffled. The range covers hash, document and position, so a line that a
third of all documents share spans as many partitions as it needs. Each partition is streamed; a line's
decision is final once enough documents have been seen. Lines at the edges of a partition, of which there are
two per partition, are settled from the partitions' summaries; so are lines that few documents repeat over
``HELD`` times, which a task writes out undecided instead of holding them. Back come positions, which end as one
compressed bitmap per document; the texts stay in their chunks.
"""

from __future__ import annotations

import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecatlas.llm.tables import NO_ID, answer_chunks, chunk_rows, column_bytes, free_name, partitions, write_chunks
from vecatlas.session import materialize, small_table

LINES = "h1 long, h2 long, doc long, chunk long, row int, pos int"
MARKS = "kind int, h1 long, h2 long, chunk long, row int, pos int, n long, first long, last long, part int"
DROP, OPEN, EDGE, FIRST = 0, 1, 2, 3
HELD = 1 << 18


def line_keys(text: bytes) -> list[bytes]:
    """Per line: stripped of ASCII white space and with A-Z lower-cased."""
    return [line.strip().lower() for line in text.split(b"\n")]


def _hashed_lines(chunks: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for chunk, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                table = chunk_rows(data)
                ids, digests, rows, positions = table[doc_id].to_pylist(), [], [], []
                for row, whole in enumerate(column_bytes(table[text].combine_chunks())):
                    for pos, key in enumerate(line_keys(whole)):
                        if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
                            digests.append(xxhash.xxh3_128_digest(key))
                            rows.append(row)
                            positions.append(pos)
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                docs = np.array([NO_ID if x is None else int(x) for x in ids], np.int64)
                at = np.array(rows, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), pa.array(docs[at]),
                     pa.array(np.full(len(at), chunk, np.int64)), pa.array(at), pa.array(np.array(positions, np.int32))],
                    names=["h1", "h2", "doc", "chunk", "row", "pos"])

    return chunks.mapInArrow(run, LINES)


def _mark(min_docs: int, keep_first: bool):
    """Stream one sorted partition; see MARKS. A run is the lines of one hash."""
    spared = int(keep_first)  # a run's first row needs no answer then
    names = ["h1", "h2", "doc", "chunk", "row", "pos"]

    def out(kind, part, cols, n=0, first=0, last=0):
        size = len(cols["h1"])
        full = lambda value, kind: np.full(size, value, kind)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (full(kind, np.int32), cols["h1"], cols["h2"], cols["chunk"], cols["row"], cols["pos"],
                                   full(n, np.int64), full(first, np.int64), full(last, np.int64), full(part, np.int32))],
            names=[x.split()[0] for x in MARKS.split(", ")])

    def run(batches):
        part = TaskContext.get().partitionId()
        held = None  # the rows of the run that may go on; its first `told` rows have been answered
        told, before, first_doc = spared, 0, 0  # `before`: its documents ahead of the held rows
        edge, spilled = True, False  # it is the partition's first run; some of its rows were written undecided

        for batch in batches:
            if not batch.num_rows:
                continue
            new = {k: c.to_numpy() for k, c in zip(names, batch.columns)}
            cols = {k: np.concatenate([held[k], v]) for k, v in new.items()} if held else new
            if held is None:
                first_doc = int(cols["doc"][0])
                if keep_first:  # unless the run began in an earlier partition
                    yield out(FIRST, part, {k: v[:1] for k, v in cols.items()})
            cut = (np.diff(cols["h1"]) != 0) | (np.diff(cols["h2"]) != 0)
            starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
            ends = np.concatenate([starts[1:], [len(cols["h1"])]])
            fresh = np.concatenate([[True], cut | (np.diff(cols["doc"]) != 0)])
            docs = np.add.reduceat(fresh.astype(np.int64), starts)
            docs[0] += before
            drop = np.repeat(docs >= min_docs, ends - starts)
            drop[:told] = False
            if keep_first:
                drop[starts[1:]] = False
            if len(starts) > 1:  # the first run has ended
                if edge:
                    if docs[0] < min_docs:
                        yield out(OPEN, part, {k: v[told:ends[0]] for k, v in cols.items()})
                    yield out(EDGE, part, {k: v[:1] for k, v in cols.items()}, docs[0], first_doc, int(cols["doc"][ends[0] - 1]))
                    edge = False
                elif spilled and docs[0] >= min_docs:
                    yield out(EDGE, part, {k: v[:1] for k, v in cols.items()}, docs[0], first_doc, int(cols["doc"][ends[0] - 1]))
                spilled = False
                told, before, first_doc = spared, 0, int(cols["doc"][starts[-1]])
            if drop.any():
                yield out(DROP, part, {k: v[drop] for k, v in cols.items()})
            if docs[-1] >= min_docs:  # answered; keep only what the count needs
                held, told, before = {k: v[-1:].copy() for k, v in cols.items()}, 1, int(docs[-1]) - 1
            elif ends[-1] - starts[-1] > HELD:
                yield out(OPEN, part, {k: v[starts[-1] + told:] for k, v in cols.items()})
                held, told, before, spilled = {k: v[-1:].copy() for k, v in cols.items()}, 1, int(docs[-1]) - 1, True
            else:
                held = {k: v[starts[-1]:].copy() for k, v in cols.items()}
        if held:
            fresh = 1 + int((np.diff(held["doc"]) != 0).sum())
            n = before + fresh
            if n < min_docs:
                yield out(OPEN, part, {k: v[told:] for k, v in held.items()})
            yield out(EDGE, part, {k: v[:1] for k, v in held.items()}, n, first_doc, int(held["doc"][-1]))

    return run


def _spanning(edges: DataFrame, min_docs: int) -> list[tuple[int, int, int]]:
    """Hashes at partition edges with enough documents in all, and the partition where they begin.

    Two rows per partition reach the driver, and one for each hash with more than HELD undecided lines.
    """
    totals: dict[tuple[int, int], list[int]] = {}
    for r in edges.select("h1", "h2", "n", "first", "last", "part").orderBy("h1", "h2", "part").collect():
        known = totals.get((r["h1"], r["h2"]))
        if known is None:
            totals[r["h1"], r["h2"]] = [r["n"], r["last"], r["part"]]
        else:
            known[0] += r["n"] - (r["first"] == known[1])
            known[1] = r["last"]
    return [(*h, part) for h, (n, _, part) in totals.items() if n >= min_docs]


def repeated_lines(chunks: DataFrame, doc_id: str, text: str, min_docs: int, min_chars: int = 1,
                   keep_first: bool = False) -> DataFrame:
    """(chunk, row, pos) of every line whose key stands in at least ``min_docs`` documents.

    With ``keep_first`` the first of a key's lines (by document and position) is not among them.
    """
    spark = chunks.sparkSession
    order = ["h1", "h2", "doc", "chunk", "row", "pos"]
    hashed = _hashed_lines(chunks, doc_id, text, min_chars)
    ranged = hashed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    marks = materialize(ranged.mapInArrow(_mark(min_docs, keep_first), MARKS), "lines")
    decided = _spanning(marks.where(F.col("kind") == EDGE), min_docs)
    place = ["chunk", "row", "pos"]
    drops = marks.where(F.col("kind") == DROP).select(*place)
    if decided:  # at most two hashes per partition, and one per HELD lines
        h1, h2, begin = (list(x) for x in zip(*decided))
        table = small_table(spark, {"h1": h1, "h2": h2, "begin": begin}, "h1 long, h2 long, begin int")
        late = marks.where((F.col("kind") == OPEN) | (F.col("kind") == FIRST)).join(F.broadcast(table), ["h1", "h2"])
        late = late.where((F.col("kind") == OPEN) | (F.col("part") > F.col("begin")))
        drops = drops.unionByName(late.select(*place))
    return drops


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                 apply: bool = False, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str, str, str]:
    """Every row of ``docs`` with its number of lines, of dropped lines, and a zlib-compressed keep bitmap.

    Returns the table and the names of the three added columns (n_lines, n_dropped, keep; with underscores in
    front where ``docs`` has such a column). With ``apply`` the text column holds the kept lines. A bit per line, first line in the highest bit, 1 for a kept line. A
    null text counts as one empty line. Documents are told apart by ``doc_id``: rows with an equal one count
    once towards ``min_docs``, as do all rows without one.
    """
    n_lines, n_dropped, keep = (free_name(x, docs.columns) for x in ("n_lines", "n_dropped", "keep"))
    chunks = write_chunks(docs, text)
    drops = repeated_lines(chunks, doc_id, text, min_docs, min_chars, keep_first)
    answers = drops.groupBy("chunk").agg(F.collect_list(F.struct("row", "pos")).alias("drops"))

    def run(batches):
        for batch in batches:
            for _, _, data, dropped in zip(*(x.to_pylist() for x in batch.columns[:3]), batch.column(3)):
                table = chunk_rows(data)
                texts = column_bytes(table[text].combine_chunks())
                sizes = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                kept = np.ones(starts[-1], bool)
                if dropped.is_valid and len(dropped.values):
                    rows, pos = (dropped.values.field(k).to_numpy() for k in (0, 1))
                    kept[starts[rows] + pos] = False
                lost = sizes - np.add.reduceat(kept, starts[:-1]).astype(np.int64)
                maps = [zlib.compress(np.packbits(kept[a:b]).tobytes(), 1) for a, b in zip(starts[:-1], starts[1:])]
                if apply:
                    pairs = zip(texts, np.split(kept, starts[1:-1]), lost.tolist())
                    left = [b"\n".join(compress(t.split(b"\n"), bits)) if gone else t for t, bits, gone in pairs]
                    at = table.schema.get_field_index(text)
                    table = table.set_column(at, table.schema.field(at), pa.array(left, pa.binary()).cast(pa.string()))
                table = table.append_column(n_lines, pa.array(sizes)).append_column(n_dropped, pa.array(lost))
                yield from table.append_column(keep, pa.array(maps, pa.binary())).to_batches()

    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType()),
                           T.StructField(keep, T.BinaryType())])
    out = answer_chunks(chunks, answers).select("chunk", "n_rows", "rows", "drops").mapInArrow(run, schema)
    return out, n_lines, n_dropped, keep


def kept_text(text: str, keep: bytes) -> str:
    """The kept lines, joined."""
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return text or "" if bits.all() else "\n".join([x for x, b in zip(lines, bits) if b])
