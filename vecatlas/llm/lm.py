"""Language-model scoring by deleted interpolation.

    P(w | v) = a(b) c(v w) / c(v) + u(b) c(w) / N + z(b) / (V + 1)

with a context's bucket b = floor(log2(c(v) + 1)): how far a text's own pair counts are trusted depends on how
often the context was seen. The three weights of each bucket come from expectation-maximisation over the pairs of
a fold of training texts, under the counts of all other training texts (the fold's own are deleted). Texts begin
in a start context and end with an end token, so probabilities of texts add up.

All pairs of all texts are counted. Chunks of rows send each distinct token and pair once, with their counts, to
hash buckets and hear the corpus counts; texts stay in their chunks. A word that makes up a third of all tokens is
one number per chunk. Tokens and pairs are known by 64-bit hashes. The driver sees, apart from totals, the cells
of a three-way histogram (bucket, and the two probabilities in quarter octaves), whose size has a bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.tables import answer_chunks, blob, chunk_rows, column_bytes, partitions, unblob, write_chunks
from vecatlas.session import materialize

CHUNK = 8 << 20
FOLDS = 10  # of the hash of the id: 0 is never learned from, 1 is deleted while the weights are learned
HELD_OUT, DELETED, NO_FOLD = 0, 1, 2
END, START = np.uint64(0xE5D0E5D0E5D0E5D1), np.uint64(0x57A2757A2757A275)
TOKEN, PAIR = 0, 1
STEPS = 4.0  # cells per octave
ROUNDS = 200
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _plane(values: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte of the same weight, compressed: the high bytes vanish."""
    steps = np.diff(values, prepend=np.uint64(0))
    return blob(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def _unplane(data: bytes, n: int) -> np.ndarray:
    planes = unblob(data, 8 * n, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


class Tokens:
    """The tokens of a chunk: per token its hash's number, its pair's number, its context's number and its text."""

    def __init__(self, table: pa.Table, text: str):
        memory: dict[bytes, int] = {}

        def hashed(word: bytes) -> int:
            found = memory[word] = xxhash.xxh64_intdigest(word)
            return found

        parts, sizes = [], []
        for whole in column_bytes(table[text].combine_chunks()):
            words = whole.lower().split()
            get = memory.get
            parts.append(np.fromiter((get(w) or hashed(w) for w in words), np.uint64, len(words)))
            parts.append(END[None])
            sizes.append(len(words) + 1)
            if len(memory) > 100_000:
                memory.clear()
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        token = np.concatenate([np.zeros(0, np.uint64), *parts])
        context = np.roll(token, 1)
        context[self.starts] = START
        pair = (context * np.uint64(3) + (token ^ (token >> np.uint64(31)))) * _MIX
        pair ^= pair >> np.uint64(32)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        # START is a context and no token: it stands among the tokens, once per text, for its count.
        self.tokens, number = np.unique(np.append(token, np.full(len(sizes), START)), return_inverse=True)
        self.token, start = number[: len(token)], number[len(token) :]
        self.context = np.roll(self.token, 1)
        self.context[self.starts] = start
        self.all_tokens = number
        self.pairs, self.pair = np.unique(pair, return_inverse=True)

    def sums(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the distinct tokens and pairs over the texts of weight 1."""
        each = weight[self.doc]
        tokens = np.bincount(self.all_tokens, np.append(each, weight), len(self.tokens))
        return tokens.astype(np.int64), np.bincount(self.pair, each, len(self.pairs)).astype(np.int64)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.starts) else np.zeros(0)


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    of = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))


def _ask(chunks: DataFrame, text: str, buckets: int) -> DataFrame:
    """(bucket, chunk, kind, n, hashes, counts, deleted): counts in training texts, and in those of the deleted fold."""
    def run(batches):
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = chunk_rows(data)
                fold, tokens = table["fold"].to_numpy(), Tokens(table, text)
                counts, deleted = tokens.sums((fold != HELD_OUT) * 1.0), tokens.sums((fold == DELETED) * 1.0)
                rows = []
                for kind, hashes in ((TOKEN, tokens.tokens), (PAIR, tokens.pairs)):
                    cuts = _cuts(hashes, buckets).tolist()
                    rows += [(b, chunk, kind, hi - lo, _plane(hashes[lo:hi]), blob(counts[kind][lo:hi]), blob(deleted[kind][lo:hi]))
                             for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo]
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 7, kinds)],
                                                 names=["bucket", "chunk", "kind", "n", "hashes", "counts", "deleted"])

    return chunks.select("chunk", "rows").mapInArrow(
        run, "bucket int, chunk long, kind int, n int, hashes binary, counts binary, deleted binary")


TOLD = "bucket int, chunk long, kind int, n int, counts binary, deleted binary, tokens long, deleted_tokens long, types long"


def _tell(table: pa.Table) -> pa.Table:
    """The corpus counts of what each chunk has asked for; a bucket's first row of tokens also carries its totals."""
    out = []
    for kind in (TOKEN, PAIR):
        part = table.filter(pc.equal(table["kind"], kind))
        if not len(part):
            continue
        sizes = part["n"].to_numpy()
        read = lambda name: np.concatenate([unblob(d, n, np.int64) for d, n in zip(part[name].to_pylist(), sizes)])
        hashes = np.concatenate([_unplane(d, n) for d, n in zip(part["hashes"].to_pylist(), sizes.tolist())])
        types, number = np.unique(hashes, return_inverse=True)
        sums = [np.bincount(number, read(name), len(types)).astype(np.int64) for name in ("counts", "deleted")]
        real = types != START
        totals = [int(sums[0][real].sum()), int(sums[1][real].sum()), int((sums[0][real] > 0).sum())] if kind == TOKEN else [0, 0, 0]
        ends = np.cumsum(sizes)
        for i, (chunk, n, end) in enumerate(zip(part["chunk"].to_pylist(), sizes.tolist(), ends.tolist())):
            mine = number[end - n : end]
            out.append((part["bucket"][0].as_py(), chunk, kind, n, *(blob(s[mine]) for s in sums), *(totals if i == 0 else [0, 0, 0])))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in TOLD.split(", ")])


def _heard(tokens: Tokens, answers: list[dict], buckets: int, names: tuple[str, ...]) -> list[list[np.ndarray]]:
    """[kind][name]: the corpus counts of the chunk's distinct tokens and pairs."""
    out = [[np.zeros(len(h), np.int64) for _ in names] for h in (tokens.tokens, tokens.pairs)]
    cuts = [_cuts(h, buckets) for h in (tokens.tokens, tokens.pairs)]
    for a in answers or []:
        lo, hi = cuts[a["kind"]][a["bucket"] : a["bucket"] + 2]
        for array, name in zip(out[a["kind"]], names):
            array[lo:hi] = unblob(a[name], a["n"], np.int64)
    return out


def _share(part: np.ndarray, whole) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _bucket_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts + 1.0)).astype(np.int64)


def _cells(asked: DataFrame, text: str, buckets: int, n_tokens: int) -> DataFrame:
    """(b, pair, single, n): tokens of the deleted fold by context bucket and both probabilities without the fold."""
    def run(batches):
        for batch in batches:
            for data, answers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = chunk_rows(data)
                tokens = Tokens(table, text)
                (c1, d1), (c2, d2) = _heard(tokens, answers, buckets, ("counts", "deleted"))
                mine = table["fold"].to_numpy()[tokens.doc] == DELETED
                token, context, pair = tokens.token[mine], tokens.context[mine], tokens.pair[mine]
                c1, c2 = c1 - d1, c2 - d2
                step = lambda p: np.where(p > 0, np.round(STEPS * np.log2(np.maximum(p, 1e-300))), 1).astype(np.int64)
                cell = np.stack([_bucket_of(c1[context]), step(_share(c2[pair], c1[context])), step(_share(c1[token], n_tokens))])
                cells, counts = np.unique(cell, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cells), pa.array(counts)], names=["b", "pair", "single", "n"])

    found = asked.select("rows", "told").mapInArrow(run, "b long, pair long, single long, n long")
    return found.groupBy("b", "pair", "single").agg(F.sum("n").alias("n"))


def learn_weights(cells: np.ndarray, flat: float, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Weights (pair, single, flat) by context bucket; bucket -1 holds those of all together.

    ``cells`` has columns b, pair, single, n; a probability is 2^(column / STEPS), and 0 for a column of 1. A bucket's
    expected counts are joined by ten of the common weights, which steadies buckets with few tokens.
    """
    def run(rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
        p = np.stack([*(np.where(rows[:, k] == 1, 0.0, np.exp2(rows[:, k] / STEPS)) for k in (1, 2)), np.full(len(rows), flat)])
        weights = np.array([0.5, 0.4, 0.1])
        for _ in range(rounds):
            joint = weights[:, None] * p
            expected = (joint / joint.sum(0) * rows[:, 3]).sum(1) + prior
            new = expected / expected.sum()
            done = np.abs(new - weights).max() < 1e-9
            weights = new
            if done:
                break
        return weights

    if not len(cells):
        return {-1: np.array([0.3, 0.6, 0.1])}
    out = {-1: run(cells, np.full(3, 1e-3))}
    for b in np.unique(cells[:, 0]):
        out[int(b)] = run(cells[cells[:, 0] == b], 10 * out[-1])
    return out


def _weights_at(buckets: np.ndarray, known: dict[int, np.ndarray]) -> np.ndarray:
    """Weights per row; a bucket without its own takes those of the nearest one below, an unseen context none for pairs."""
    most = max(int(buckets.max(initial=0)), max(known))
    table, last = np.zeros((most + 1, 3)), known[-1]
    for b in range(most + 1):
        last = known.get(b, last)
        table[b] = last
    table[0, 0] = 0.0
    table[0] /= table[0].sum()
    return table[buckets]


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows whose CRC-32 of the id leaves a remainder other than 0 by ten; rows without an id are
    learned from. ``base_score`` is the add-0.1 unigram score, ``score`` the model's log10 probability. A null text
    is empty: its one token is the end. Repeated rows count as often as they stand there.
    """
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    fold = F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)).cast("int"), F.lit(NO_FOLD))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), fold.alias("fold"), F.col(text).cast("string").alias("text"))
    chunks = write_chunks(rows, "text", CHUNK)
    told = materialize(_ask(chunks, "text", buckets).groupBy("bucket").applyInArrow(lambda table: _tell(table), TOLD), "told")
    n, n_deleted, types = (int(x or 0) for x in told.agg(F.sum("tokens"), F.sum("deleted_tokens"), F.sum("types")).first())
    heard = lambda *names: answer_chunks(chunks, told.groupBy("chunk").agg(
        F.collect_list(F.struct("bucket", "kind", "n", *names)).alias("told")))
    cells = _cells(heard("counts", "deleted"), "text", buckets, n - n_deleted).collect()
    weights = learn_weights(np.array([tuple(r) for r in cells], np.int64).reshape(-1, 4), 1 / (types + 1))

    def run(batches):
        for batch in batches:
            for data, answers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = chunk_rows(data)
                tokens = Tokens(table, "text")
                (c1,), (c2,) = _heard(tokens, answers, buckets, ("counts",))
                one, seen = c1[tokens.token], c1[tokens.context]
                mix = _weights_at(_bucket_of(seen), weights)
                p = mix[:, 0] * _share(c2[tokens.pair], seen) + mix[:, 1] * _share(one, n) + mix[:, 2] / (types + 1)
                base = np.log10((one + 0.1) / (n + 0.1 * (types + 1)))
                yield pa.RecordBatch.from_arrays(
                    [table["doc_id"].combine_chunks(), pa.array(table["fold"].to_numpy() == HELD_OUT), pa.array(tokens.sizes),
                     pa.array(tokens.per_text((one > 0).astype(np.int64))), pa.array(np.full(len(tokens.sizes), n, np.int64)),
                     pa.array(tokens.per_text(base)), pa.array(tokens.per_text(np.log10(p)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return heard("counts").select("rows", "told").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
