"""Files written and copied by tasks, with a flag for each file.

Tasks use pyarrow's file systems (local, HDFS, S3, GCS: whatever a path's scheme names), so that no content passes
the driver. A file is written beside its name and moved there when it is complete: a task that is repeated
writes it again, and a reader never sees half of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PIECE = 1 << 20
_RESULT = "ok boolean, bytes long, error string"


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _store(target: str, pieces: Iterator[bytes]) -> int:
    """Write the pieces as one file; the number of bytes."""
    system, name = _located(target)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    draft, size = f"{name}.draft-{TaskContext.get().taskAttemptId()}", 0
    try:
        with system.open_output_stream(draft) as out:
            for piece in pieces:
                out.write(piece)
                size += len(piece)
        system.move(draft, name)
    except Exception:
        if system.get_file_info(draft).type != fs.FileType.NotFound:
            system.delete_file(draft)
        raise
    return size


def _contents(path: str) -> Iterator[bytes]:
    system, name = _located(path)
    with system.open_input_stream(name) as source:
        while piece := source.read(_PIECE):
            yield piece


def _flagged(rows: DataFrame, write: Callable[[dict], int]) -> DataFrame:
    """The rows (without ``content``) with what became of each file: ``ok``, ``bytes`` and ``error`` (empty if it went well)."""
    kept = [c for c in rows.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                try:
                    found.append((True, write(row), ""))
                except (OSError, pa.ArrowException) as problem:
                    found.append((False, 0, type(problem).__name__))
            ok, size, error = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(ok, pa.bool_()), pa.array(size, pa.int64()), pa.array(error, pa.string())],
                names=[*kept, "ok", "bytes", "error"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, {_RESULT}")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``rows(name, content)``, binary, below ``folder``, one file per row: ``name, ok, bytes, error``.

    The files are written when the result is computed; names are distinct. A null content is an empty file.
    """
    folder = folder.rstrip("/")
    return _flagged(rows.select("name", "content"), lambda row: _store(f"{folder}/{row['name']}", iter([row["content"] or b""])))


def export_copies(manifest: DataFrame, folder: str) -> DataFrame:
    """Copy each ``src_path`` of a manifest to ``folder`` under its ``target_name``: ``src_path, target_name, ok, bytes, error``.

    The files are copied when the result is computed. A source that is missing or cannot be read has ``ok`` false, and no target.
    """
    folder = folder.rstrip("/")

    def copy(row: dict) -> int:
        source, target = _located(row["src_path"]), _located(f"{folder}/{row['target_name']}")
        if source[1] == target[1] and source[0].type_name == target[0].type_name:
            return source[0].get_file_info(source[1]).size  # the file lies there already
        return _store(f"{folder}/{row['target_name']}", _contents(row["src_path"]))

    return _flagged(manifest.select("src_path", "target_name"), copy)


def all_ok(copies: DataFrame) -> DataFrame:
    """The overall flag: false if any file failed; ``ok, files, failed``."""
    return copies.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"), F.count(F.lit(1)).alias("files"),
                      F.count_if(~F.col("ok")).alias("failed"))
