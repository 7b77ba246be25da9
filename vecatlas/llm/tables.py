"""Shared helpers: text columns as bytes, and rows packed into chunks that a bucketed table keeps in place.

A chunk is some megabytes of whole rows (all columns, as a compressed Arrow batch) under one number. Operators
that send something about each row away and get an answer back (which lines to drop, which bytes are repeated)
address rows as (chunk, row). The chunk table is bucketed by its number, so the answers are shuffled to the
chunks and the texts stay where they are. Repeated rows, and rows without an id, stay apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecatlas.session import scratch_path
from vecatlas.sources.storage import Storage

CHUNK_BYTES = 8 << 20
NO_ID = -(1 << 63)
_CHUNKS = "vecatlas_chunks_"


_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold 4 MB of text (a session that has set another size keeps it).

    Spark's 64 MB, several times over on either side of a pipe, crowd an executor of a few GB.
    """
    if int(spark.conf.get(_BATCH).rstrip("b")) == _DEFAULT:
        spark.conf.set(_BATCH, "4194304b")


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores in front until no given column has it (Spark ignores case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def column_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blob(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True) if values.size else b""


def unblob(data: bytes | None, n: int, dtype) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    size = n * np.dtype(dtype).itemsize
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), dtype)


def slices(batch: pa.RecordBatch, text: int, limit: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Pieces of the batch with at most ``limit`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    piece = (np.cumsum(sizes) - 1) // limit
    starts = np.flatnonzero(np.diff(piece, prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(lo, hi - lo), int(sizes[lo:hi].sum())


def write_chunks(docs: DataFrame, text: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """Pack the rows into chunks of about ``limit`` bytes of text, once, without a shuffle.

    Columns: chunk (long), n_rows (int), rows (an Arrow stream with every column of ``docs``).
    """
    spark, at = docs.sparkSession, docs.columns.index(text)
    small_batches(spark)

    def pack(batches):
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def packed():
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            return pa.RecordBatch.from_pydict(
                {"chunk": pa.array([(part << 32) + made], pa.int64()), "n_rows": pa.array([table.num_rows], pa.int32()),
                 "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            for piece, weight in slices(batch, at, limit):
                if held and size + weight > limit:
                    yield packed()
                    made, held, size = made + 1, [], 0
                held.append(piece)
                size += weight
        if held:
            yield packed()

    path = scratch_path(spark, "chunks")
    name = f"{_CHUNKS}{uuid.uuid4().hex}"
    packed_rows = docs.mapInArrow(pack, "chunk long, n_rows int, rows binary")
    (packed_rows.write.bucketBy(partitions(spark), "chunk").format("parquet")
     .option("path", path).option("compression", "uncompressed").saveAsTable(name))
    return spark.table(name)


def chunk_tables(spark: SparkSession) -> set[str]:
    """Names of the chunk tables that exist; results that were not written yet may still read them."""
    return {t.name for t in spark.catalog.listTables() if t.name.startswith(_CHUNKS)}


def drop_chunks(spark: SparkSession, names: set[str]) -> None:
    """Remove chunk tables and their files, once what was made from them is written."""
    for name in names:
        (path,) = {r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect() if r["col_name"] == "Location"}
        spark.sql(f"DROP TABLE {name}")
        Storage(spark).delete(path)


def chunk_rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.BufferReader(data)).read_all().combine_chunks()


def answer_chunks(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks with their answer columns; only the answers (one row per chunk) are shuffled."""
    return chunks.join(answers.hint("shuffle_hash"), "chunk", "left")


def id_column(docs: DataFrame, name: str = "doc_id"):
    return F.col(name).cast("long")
