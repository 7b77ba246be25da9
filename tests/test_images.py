import math
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vecatlas.functions.vectors import normalize
from vecatlas.operators import images as I
from vecatlas.operators.encode import HashingEncoder, OnnxEncoder, _units, encode, encode_queries, split_errors
from vecatlas.plans.search import example_search
from vecatlas.plans.sync import sync_files
from vecatlas.session import scratch_path
from vecatlas.sources.commitlog import CommitLog
from vecatlas.sources.files import list_files, read_images

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def png(rows, kind):
    """PNG bytes of ``rows[height][width]`` tuples; kind 0 gray, 2 RGB, 4 gray+alpha, 6 RGBA."""
    raw = b"".join(b"\0" + bytes(v for pixel in row for v in pixel) for row in rows)

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def tree(tmp_path):
    folder = tmp_path / "tree"
    (folder / "sub").mkdir(parents=True)
    (folder / "rgb.png").write_bytes(png([[(10, 20, 30)] * 3] * 2, 2))
    (folder / "sub" / "ALPHA.PNG").write_bytes(png([[(10, 20, 30, 128)] * 4] * 4, 6))
    (folder / "sub" / "gray.png").write_bytes(png([[(77,)] * 2] * 2, 0))
    (folder / "bad.jpg").write_bytes(b"xx")
    (folder / "n.txt").write_bytes(b"xx")
    return folder


def test_listing(spark, tree, explain):
    found = list_files(spark, [str(tree), str(tree / "sub"), str(tree / "absent")])
    rows = {r["path"]: r["size"] for r in found.collect()}
    assert sorted(rows) == sorted(str(tree / p) for p in ("rgb.png", "sub/ALPHA.PNG", "sub/gray.png", "bad.jpg"))
    assert rows[str(tree / "bad.jpg")] == 2
    assert "content" not in explain(found).split("ReadSchema")[-1]
    assert list_files(spark, [str(tree / "absent")]).count() == 0


def test_metadata(spark, tree):
    report = I.image_metadata(read_images(spark, [str(tree)], drop_invalid=False))
    rows = {r["origin"].rsplit("/", 1)[-1]: (r["width"], r["height"], r["error"] != "") for r in report.collect()}
    assert rows == {"rgb.png": (3, 2, False), "ALPHA.PNG": (4, 4, False), "gray.png": (2, 2, False),
                    "bad.jpg": (0, 0, True)}
    assert read_images(spark, [str(tree)]).count() == 3


def test_tensor_values(spark, tree):
    rows = I.image_tensors(read_images(spark, [str(tree)], drop_invalid=False), 2).collect()
    tensors = {r["path"].rsplit("/", 1)[-1]: r["tensor"] for r in rows}
    assert tensors["bad.jpg"] is None

    def planes(rgb):
        return [np.float32((np.float32(v) / np.float32(255) - np.float32(m)) / np.float32(s))
                for v, m, s in zip(rgb, I.CLIP_MEAN, I.CLIP_STD) for _ in range(4)]

    assert np.allclose(tensors["rgb.png"], planes((10, 20, 30)), atol=1e-6)
    assert np.allclose(tensors["ALPHA.PNG"], planes((5, 10, 15)), atol=1e-6)
    assert np.allclose(tensors["gray.png"], planes((77, 77, 77)), atol=1e-6)


def resize_by_pixel(plane, target):
    """Rows, then columns, one pixel at a time in floating point."""
    def line(values):
        scale, out = len(values) / target, []
        wide = max(scale, 1.0)
        for x in range(target):
            center = (x + 0.5) * scale
            total = weight_sum = 0.0
            for i in range(max(int(center - 2 * wide + 0.5), 0), min(int(center + 2 * wide + 0.5), len(values))):
                d = abs((i + 0.5 - center) / wide)
                w = 1.5 * d**3 - 2.5 * d**2 + 1 if d < 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0
                total, weight_sum = total + w * values[i], weight_sum + w
            out.append(min(max(math.floor(total / weight_sum + 0.5), 0), 255))
        return out

    half = [line(row) for row in plane]
    return np.array([line(column) for column in zip(*half)]).T


@pytest.mark.parametrize("height, width, target", [(5, 9, 4), (4, 4, 8), (30, 7, 10), (8, 8, 8)])
def test_resize(height, width, target):
    rng = np.random.default_rng(height)
    bgr = rng.integers(0, 256, size=(height, width, 3), dtype=np.uint8)
    tensor = I.tensor_of(bgr.tobytes(), height, width, 3, target, (0, 0, 0), (1, 1, 1))
    for c in range(3):
        expected = resize_by_pixel(bgr[:, :, 2 - c].tolist(), target)
        # Fixed-point weights may move a value that lies on a rounding edge.
        assert np.abs(tensor[c] * 255 - expected).max() <= 1.001
        assert np.mean(np.abs(tensor[c] * 255 - expected) > 0.01) < 0.02


class MeanModel:
    def __call__(self):
        return lambda batch: batch.reshape(len(batch), 3, -1).mean(axis=2)


def test_sync_and_search_files(spark, tree):
    log = CommitLog(spark, scratch_path(spark, "atlas"))
    result = sync_files(log, [str(tree)], MeanModel(), "sync-0", size=4)
    assert [r["path"] for r in result.errors.collect()] == [str(tree / "bad.jpg")]
    # The undecodable file sorts first and leaves its slot free.
    assert {r["slot"]: r["live"] for r in log.catalog().collect()} == {0: False, 1: True, 2: True, 3: True}
    hits = example_search(spark, log.vectors(), [str(tree / "sub")], MeanModel(), 2, size=4)
    best = {r["query_id"]: r["path"] for r in hits.filter("rank = 1").collect()}
    assert best == {str(tree / "sub" / n): str(tree / "sub" / n) for n in ("ALPHA.PNG", "gray.png")}
    (tree / "sub" / "gray.png").unlink()
    again = sync_files(log, [str(tree)], MeanModel(), "sync-1", size=4)
    assert [r["path"] for r in again.gone.collect()] == [str(tree / "sub" / "gray.png")]
    assert log.vectors().count() == 2


class Fussy:
    """Fails on any batch that holds a 9."""

    def __call__(self):
        def run(batch):
            if (batch == 9).any():
                raise ValueError("nine")
            return batch * np.float32(2)

        return run


def test_failing_rows_become_null(spark):
    df = spark.createDataFrame([(0, [3, 4]), (1, [9, 1]), (2, None), (3, [1, 2, 3]), (4, [0, 0])],
                               "k int, ids array<long>").coalesce(1)
    encoded = encode(df, "ids", (2,), "int64", Fussy())
    rows = {r["k"]: r["embedding"] for r in encoded.collect()}
    assert np.allclose(rows[0], [0.6, 0.8]) and [k for k, v in rows.items() if v is None] == [1, 2, 3, 4]
    good, bad = split_errors(encoded)
    assert (good.count(), bad.count()) == (1, 4)
    raw = encode(df, "ids", (2,), "int64", Fussy(), normalization=False).filter("k = 0").first()
    assert raw["embedding"] == [6.0, 8.0]


def test_unit_vectors_equal_the_column_function(spark):
    rows = [[3.0, -0.1, 0.0], [0.0, -0.0, 0.0], [1e-30, 2e20, 7.0], [0.3, 0.7, 0.11], [float("nan"), 1.0, 2.0], [float("inf"), 1.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, v array<float>").coalesce(1)
    for legacy in (False, True):
        want = df.select("k", normalize(F.col("v"), legacy).cast("array<float>").alias("u")).orderBy("k").collect()
        made = _units([np.array(r, np.float32) for r in rows], legacy)
        assert [str(r["u"]) for r in want] == [str(None if u is None else u.tolist()) for u in made]


def field(number, value):
    if isinstance(value, int):
        return bytes([number << 3, value])
    data = value.encode() if isinstance(value, str) else value
    return bytes([number << 3 | 2]) + bytes([len(data)]) + data


def flatten_model(batch):
    """A one-node ONNX model, Flatten, for inputs [batch, 3, 2, 2]."""
    def info(name, *dims):
        shape = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
        return field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))

    node = field(1, "x") + field(2, "y") + field(4, "Flatten")
    graph = field(1, node) + field(2, "g") + field(11, info("x", batch, 3, 2, 2)) + field(12, info("y", batch, 12))
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


@pytest.mark.parametrize("batch", ["n", 1])
def test_onnx_model(spark, tmp_path, batch):
    pytest.importorskip("onnxruntime")
    path = tmp_path / "model.onnx"
    path.write_bytes(flatten_model(batch))
    rows = [(i, [float(i * 12 + j) for j in range(12)]) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, t array<float>").coalesce(1)
    encoded = encode(df, "t", (3, 2, 2), "float32", OnnxEncoder(str(path)), normalization=False)
    assert {r["k"]: r["embedding"] for r in encoded.collect()} == dict(rows)


def test_text_queries(spark):
    words = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "cat", "dog"]
    vocabulary = spark.createDataFrame([(t, i) for i, t in enumerate(words)], "token string, id long")
    queries = spark.createDataFrame([(0, "cat"), (1, "  "), (2, "dog"), (3, "CAT ")], "query_id int, text string")
    rows = {r["query_id"]: r["embedding"] for r in
            encode_queries(queries, vocabulary, HashingEncoder(32), 8).collect()}
    assert sorted(rows) == [0, 2, 3] and rows[0] == rows[3] != rows[2]
    assert np.isclose(np.linalg.norm(rows[0]), 1)
    with pytest.raises(ValueError, match="vocabulary lacks"):
        encode_queries(queries, vocabulary.filter("token <> '[CLS]'"), HashingEncoder(32), 8)


def test_names_with_special_characters(spark, tmp_path):
    folder = tmp_path / "odd names"
    folder.mkdir()
    names = ["plain.png", "a b.png", "a#b.png", "a%20b.png", "a+b.png", "ä€.png", "a[1].png", "100%.png"]
    for i, name in enumerate(names):
        (folder / name).write_bytes(png([[(i, 20, 30)] * 3] * 2, 2))
    want = sorted(f"{folder}/{name}" for name in names)
    assert sorted(r["path"] for r in list_files(spark, [str(folder)]).collect()) == want
    images = read_images(spark, [str(folder)])
    assert sorted(r["path"] for r in images.collect()) == want
    assert sorted(r["o"] for r in images.selectExpr("image.origin as o").collect()) == want
    asked = spark.createDataFrame([(p,) for p in [*want[:4], f"{folder}/gone.png"]], "path string")
    assert sorted(r["path"] for r in read_images(spark, [str(folder)], only=asked).collect()) == want[:4]
