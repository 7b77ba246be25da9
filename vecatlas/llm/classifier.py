"""Quality classifier: Naive Bayes support vectors.

Indicators of hashed n-grams (words and pairs of words; three bytes in a row; three words in a row that the text
repeats, by how often) are scaled by the classes' log-count ratios. A linear model is fitted on them with hinge
loss by dual coordinate descent, and a logistic curve over margins of rows left out of the fit turns margins into
scores. Scoring is one scan without a shuffle.

The fit uses at most ``SAMPLE`` labelled rows (those of smallest hash of their id, the same at every run), in one
task; the sample's ids are the only join with the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.tables import column_bytes, small_batches

SAMPLE = 8_000
DIMENSIONS = 1 << 18
EPOCHS = 12
COST = 1.0
SMOOTHING = 1.0
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 18)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def features(text: bytes, known: WordHashes) -> np.ndarray:
    """Sorted distinct n-gram numbers of a text, at least one (the last number stands for every text)."""
    low = text.lower()
    hashes = np.fromiter(map(known.__getitem__, low.split()), np.uint64)
    found = [hashes]
    if len(hashes) > 1:
        found.append(hashes[:-1] * np.uint64(3) + hashes[1:])
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(raw) > 2:
        found.append((raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:]) + np.uint64(1 << 32))
    if len(hashes) > 2:
        threes = hashes[:-2] * np.uint64(9) + hashes[1:-1] * np.uint64(3) + hashes[2:]
        again = len(threes) - len(np.unique(threes))
        share = int(8 * again / len(threes))  # how much of the text is repeated, in eighths
        if again:
            found.append(np.arange(share + 1, dtype=np.uint64) + np.uint64(1 << 33))
    mixed = np.concatenate(found) * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
    return np.append(np.unique((mixed >> _SHIFT).astype(np.int32)), np.int32(DIMENSIONS))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.zeros((2, DIMENSIONS + 1))
    for row, y in zip(rows, labels):
        counts[y, row] += 1
    counts += SMOOTHING
    p, q = counts[1] / counts[1].sum(), counts[0] / counts[0].sum()
    ratio = np.log(p / q)
    ratio[DIMENSIONS] = 1.0  # the constant
    return ratio.astype(np.float32)


def scaled(row: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    x = ratio[row]
    return x / max(1e-6, float(np.sqrt(x @ x)))


def fit_margin(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by dual coordinate descent on the hinge loss; classes weigh the same in all."""
    weights, alpha = np.zeros(DIMENSIONS + 1), np.zeros(len(rows))
    xs = [scaled(row, ratio) for row in rows]
    share = np.maximum(1, np.bincount(labels, minlength=2)) / len(rows)
    bound = cost * 0.5 / share[labels]
    y = 2.0 * labels - 1
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            row, x = rows[i], xs[i]
            gradient = y[i] * float(weights[row] @ x) - 1
            new = min(max(alpha[i] - gradient, 0.0), bound[i])  # rows have unit length
            if new != alpha[i]:
                weights[row] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
    return weights


def fit_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps on smoothed targets."""
    pos, neg = int(labels.sum()), int(len(labels) - labels.sum())
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, w = p - target, np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[(w * margins**2).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hessian, [(d * margins).sum(), d.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weight of each n-gram's scaled indicator, slope, offset) from rows in a random order."""
    if len(set(labels.tolist())) < 2:  # one class only: its share is the score
        return np.zeros(DIMENSIONS + 1), 0.0, float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    held = np.arange(len(rows)) % 4 == 0
    inner, outer = np.flatnonzero(~held), np.flatnonzero(held)
    if len(set(labels[inner].tolist())) == 2:
        part = [rows[i] for i in inner]
        ratio = log_count_ratio(part, labels[inner])
        weights = fit_margin(part, labels[inner], ratio)
        slope, offset = fit_curve(np.array([weights[rows[i]] @ scaled(rows[i], ratio) for i in outer]), labels[outer])
    else:
        slope, offset = 1.0, 0.0
    ratio = log_count_ratio(rows, labels)
    return np.stack([fit_margin(rows, labels, ratio), ratio]), slope, offset


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned: a fifth by CRC-32 of the id; a missing id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> bytes:
    """A model from at most ``sample`` labelled rows that are not held out.

    Ids with several labels take the smallest; null labels do not count; repeated rows count each time, up to the
    bound. Without any row every text scores one half.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).where(~held_out("doc_id"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")  # at most ``sample`` rows of two numbers

    def extract(batches):
        words = WordHashes()
        for batch in batches:
            found = [features(t, words).tobytes() for t in column_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], names=["doc_id", "y", "x"])

    def learn(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.int32) for x in table.column("x").to_pylist()]
        model, slope, offset = fit(rows, table.column("y").to_numpy().astype(np.int64))
        packed = pa.compress(model.astype(np.float32).tobytes(), codec="zstd", asbytes=True)
        return pa.Table.from_pydict({"model": [packed], "n": [model.size], "slope": [slope], "offset": [offset]})

    found = rows.mapInArrow(extract, "doc_id long, y int, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample)
    fitted = found.groupBy().applyInArrow(learn, "model binary, n long, slope double, offset double").collect()
    return fitted[0] if fitted else None


def score(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a null text is empty."""
    sc = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    shared = sc.broadcast(bytes(model["model"]) if model else b"")  # 2^18 dimensions
    n, slope, offset = (model["n"], model["slope"], model["offset"]) if model else (0, 0.0, 0.0)

    def run(batches):
        words = WordHashes()
        flat = np.frombuffer(pa.decompress(shared.value, 4 * n, codec="zstd", asbytes=True), np.float32) if n else np.zeros(0)
        weights, ratio = flat.reshape(2, -1) if n == 2 * (DIMENSIONS + 1) else (np.zeros(DIMENSIONS + 1),) * 2
        for batch in batches:
            margins = np.zeros(batch.num_rows)
            for i, whole in enumerate(column_bytes(batch.column(1))):
                row = features(whole, words)
                margins[i] = weights[row] @ scaled(row, ratio)
            scores = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
