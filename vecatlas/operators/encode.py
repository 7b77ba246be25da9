"""Batch embedding with a pluggable encoder.

An encoder factory is called once per task and returns a function from a batch
(``[n, ...]`` array) to vectors (``[n, dim]``). A row that fails alone gets a NULL embedding.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecatlas.functions.text import rewrite_prompt, strip
from vecatlas.operators.wordpiece import model_input, model_windows, wordpiece

BatchEncoder = Callable[[np.ndarray], np.ndarray]
EncoderFactory = Callable[[], BatchEncoder]


@dataclass(frozen=True)
class OnnxEncoder:
    """First output of an ONNX model, on one CPU thread per worker; ``path`` is readable by all executors."""

    path: str

    def __call__(self) -> BatchEncoder:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        options.inter_op_num_threads = 1
        session = onnxruntime.InferenceSession(self.path, options, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name

        def run(batch: np.ndarray) -> np.ndarray:
            return session.run([], {name: batch})[0].reshape(len(batch), -1)

        return run


@dataclass(frozen=True)
class HashingEncoder:
    """A deterministic stand-in for a text model: each token id adds a fixed vector of signs.

    It carries no meaning beyond shared tokens and serves tests and demonstrations.
    """

    dim: int = 64

    def __call__(self) -> BatchEncoder:
        dim = self.dim

        def signs(ids: np.ndarray) -> np.ndarray:
            x = ids.astype(np.uint64)[:, None] * np.uint64(dim) + np.arange(dim, dtype=np.uint64)[None, :]
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            return np.where((x ^ (x >> np.uint64(31))) & np.uint64(1), 1.0, -1.0)

        def run(batch: np.ndarray) -> np.ndarray:
            ids, place = np.unique(batch, return_inverse=True)
            weights = (signs(ids) * (ids != 0)[:, None]).astype(np.float32)  # sums of signs are exact
            return weights[place.reshape(batch.shape)].sum(axis=1)

        return run


def _run_rows(encoder: BatchEncoder, batch: np.ndarray) -> list[np.ndarray | None]:
    try:
        return list(encoder(batch))
    except Exception:
        if len(batch) == 1:
            logging.getLogger(__name__).warning("row could not be encoded", exc_info=True)
            return [None]
    return [vector for i in range(len(batch)) for vector in _run_rows(encoder, batch[i : i + 1])]


def _unit(vectors: np.ndarray, legacy: bool) -> list[np.ndarray | None]:
    """What ``functions.vectors.normalize`` makes of the rows, summed in the same order; None for a zero vector."""
    value = vectors.astype(np.float32).astype(np.float64)
    with np.errstate(all="ignore"):
        total = np.cumsum(value * value, axis=1)[:, -1] if value.shape[1] else np.zeros(len(value))
        if legacy:
            value[value == 0.0] = 1.0
        unit = (value / np.sqrt(total)[:, None]).astype(np.float32)
    return [row if known else None for row, known in zip(unit, (total > 0) | np.isnan(total))]


def _units(vectors: list[np.ndarray | None], legacy: bool) -> list[np.ndarray | None]:
    known = [vector for vector in vectors if vector is not None]
    if len(known) == len(vectors) and len({np.shape(vector) for vector in known}) == 1:
        return _unit(np.stack(known), legacy)
    return [None if vector is None else _unit(np.stack([vector]), legacy)[0] for vector in vectors]


def encode(
    df: DataFrame,
    column: str,
    shape: Sequence[int],
    dtype: str,
    factory: EncoderFactory,
    normalization: bool = True,
    legacy: bool = False,
    batch_rows: int = 64,
) -> DataFrame:
    """Replace the array ``column`` by ``embedding``; rows without input or with a failure get NULL."""
    kept = [c for c in df.columns if c != column]
    schema = T.StructType(
        [df.schema[c] for c in kept] + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )
    row_size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = factory()
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                inputs = batch.column(column)
                sizes = inputs.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                usable = np.nonzero(sizes == row_size)[0]
                vectors: list[np.ndarray | None] = [None] * batch.num_rows
                if len(usable):
                    flat = inputs.take(pa.array(usable)).flatten().to_numpy(zero_copy_only=False)
                    tensor = flat.astype(dtype).reshape(len(usable), *shape)
                    made = _run_rows(encoder, tensor)
                    if normalization:
                        made = _units(made, legacy)
                    for row, vector in zip(usable, made):
                        vectors[row] = vector
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.array(vectors, pa.list_(pa.float32()))],
                    names=[*kept, "embedding"],
                )

    return df.select(*kept, column).mapInArrow(run, schema)


def encode_texts(
    df: DataFrame,
    key: str,
    text: str,
    vocabulary: DataFrame,
    factory: EncoderFactory,
    context_length: int = 52,
    normalization: bool = True,
    legacy: bool = False,
    windows: bool = False,
) -> DataFrame:
    """``df`` with the embedding of ``text``: tokenise, fit to the model's context, run the model.

    The model sees a text's first ids only; with ``windows`` there is a row for each part of the text.
    """
    pieces = wordpiece(df, key, text, vocabulary)
    if windows:
        rows = model_windows(pieces, vocabulary, context_length, keep_ids=False)
    else:
        rows = model_input(pieces, vocabulary, context_length).drop("token_ids")
    return encode(rows, "input_ids", (context_length,), "int64", factory,
                  normalization, legacy)


def encode_queries(
    queries: DataFrame, vocabulary: DataFrame, factory: EncoderFactory, context_length: int = 52,
    legacy: bool = False, windows: bool = False,
) -> DataFrame:
    """Text queries ``query_id, text`` -> ``query_id, embedding``; blank queries give no row.

    The model sees a query's first ids only; with ``windows`` there is a row ``query_id, window, embedding`` for each part.
    """
    asked = queries.filter(strip(F.col("text")) != "").select(
        "query_id", rewrite_prompt(F.col("text"), legacy).alias("text")
    )
    encoded = encode_texts(asked, "query_id", "text", vocabulary, factory, context_length, windows=windows)
    return encoded.select("query_id", *(["window"] if windows else []), "embedding")


def split_errors(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to index, and rows to report and try again at the next sync."""
    failed = encoded.filter("embedding is null").drop("embedding")
    return encoded.filter("embedding is not null"), failed.withColumn("error", F.lit("could not be encoded"))
