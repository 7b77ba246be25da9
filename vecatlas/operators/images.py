"""Decoded images -> metadata and model input tensors.

Images use the struct of Spark's image source: ``origin, height, width, nChannels, mode, data`` with
the bytes in row order and channels as gray, BGR or BGRA.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Mean and standard deviation per channel of the two model configurations.
CLIP_MEAN = (0.48145466, 0.4578275, 0.40821073)
CLIP_STD = (0.26862954, 0.26130258, 0.27577711)
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)

_WEIGHT_BITS = 22


def image_metadata(images: DataFrame) -> DataFrame:
    """``origin, width, height, error``; an undecodable image has size (0, 0) and an error."""
    bad = F.coalesce(F.col("image.height") < 0, F.lit(True))
    return images.select(
        F.col("image.origin").alias("origin"),
        F.when(bad, 0).otherwise(F.col("image.width")).alias("width"),
        F.when(bad, 0).otherwise(F.col("image.height")).alias("height"),
        F.when(bad, "image could not be decoded").otherwise("").alias("error"),
    )


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    near = (1.5 * x - 2.5) * x * x + 1.0
    far = ((-0.5 * x + 2.5) * x - 4.0) * x + 2.0
    return np.where(x < 1.0, near, np.where(x < 2.0, far, 0.0))


# Weights by size and target. A plain dictionary: a decorated cache would not travel by value.
_WEIGHTS: dict[tuple[int, int], np.ndarray] = {}
_MAX_WEIGHTS = 1024


def bicubic_weights(size: int, target: int) -> np.ndarray:
    """Fixed-point weights ``[target, size]``; the kernel widens when the image shrinks."""
    if (size, target) in _WEIGHTS:
        return _WEIGHTS[size, target]
    scale = size / target
    stretch = max(scale, 1.0)
    centers = (np.arange(target) + 0.5) * scale
    low = np.maximum(np.trunc(centers - 2.0 * stretch + 0.5), 0)
    high = np.minimum(np.trunc(centers + 2.0 * stretch + 0.5), size)
    source = np.arange(size)
    weights = _cubic((source[None, :] - centers[:, None] + 0.5) / stretch)
    weights *= (source[None, :] >= low[:, None]) & (source[None, :] < high[:, None])
    weights /= weights.sum(axis=1, keepdims=True)
    if len(_WEIGHTS) >= _MAX_WEIGHTS:
        _WEIGHTS.clear()
    _WEIGHTS[size, target] = np.floor(weights * (1 << _WEIGHT_BITS) + 0.5)
    return _WEIGHTS[size, target]


def _resize_axis(pixels: np.ndarray, target: int, axis: int) -> np.ndarray:
    if pixels.shape[axis] == target:
        return pixels
    # The sums stay far below 2**53, so float64 products are exact.
    sums = np.tensordot(bicubic_weights(pixels.shape[axis], target), pixels, axes=(1, axis))
    rounded = np.floor((sums + (1 << (_WEIGHT_BITS - 1))) / (1 << _WEIGHT_BITS))
    return np.moveaxis(np.clip(rounded, 0, 255), 0, axis)


def rgb_pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Image bytes -> RGB; transparent pixels are composited on black."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int64)
    if channels == 1:
        return np.repeat(pixels, 3, axis=2)
    rgb = pixels[:, :, 2::-1]
    if channels == 4:
        blended = rgb * pixels[:, :, 3:] + 128
        rgb = ((blended >> 8) + blended) >> 8
    return rgb


def tensor_of(data: bytes, height: int, width: int, channels: int, size: int, mean: Sequence[float],
              std: Sequence[float]) -> np.ndarray:
    pixels = rgb_pixels(data, height, width, channels).astype(np.float64)
    square = _resize_axis(_resize_axis(pixels, size, 1), size, 0)
    planes = square.transpose(2, 0, 1).astype(np.float32)
    shift = np.asarray(mean, np.float32)[:, None, None]
    return (planes / np.float32(255.0) - shift) / np.asarray(std, np.float32)[:, None, None]


def image_tensors(
    images: DataFrame, size: int = 224, mean: Sequence[float] = CLIP_MEAN, std: Sequence[float] = CLIP_STD
) -> DataFrame:
    """Replace ``image`` by ``tensor`` (3 x size x size, flattened); an undecodable image gives NULL."""
    kept = [c for c in images.columns if c != "image"]
    schema = T.StructType(
        [images.schema[c] for c in kept] + [T.StructField("tensor", T.ArrayType(T.FloatType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # A tensor is large, so few leave at a time.
            for start in range(0, whole.num_rows, 32):
                batch = whole.slice(start, 32)
                tensors = []
                for image in batch.column("image").to_pylist():
                    if image is None or image["height"] is None or image["height"] < 0:
                        tensors.append(None)
                        continue
                    shape = (image["height"], image["width"], image["nChannels"])
                    tensors.append(tensor_of(image["data"], *shape, size, mean, std).ravel())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.array(tensors, pa.list_(pa.float32()))],
                    names=[*kept, "tensor"],
                )

    return images.select(*kept, "image").mapInArrow(run, schema)
