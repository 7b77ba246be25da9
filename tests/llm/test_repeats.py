import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pytest

from vecatlas.llm import queries, repeats


def brute(rows):
    """Removed places of each row, rows in the order of (id, place), rows without an id first."""
    seen, out = set(), [None] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)):
        data = (rows[i][1] or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        out[i] = gone
    return out


def digest(data, gone):
    kept = bytes(b for b, g in zip(data, gone) if not g)
    return (len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())


def check(spark, rows, parts=1):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.digests(docs.coalesce(1) if parts == 1 else docs.repartition(parts)).collect()
    want = [(d, *digest((t or "").encode(), gone)) for (d, t), gone in zip(rows, brute(rows))]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def passages(words, n=60):
    pick = random.Random(5)
    shared = [words(900 + i, 12 + 6 * i) for i in range(8)]
    rows = []
    for i in range(n):
        parts = [words(i, pick.randint(1, 60))]
        for _ in range(pick.randint(0, 3)):
            s = pick.choice(shared)
            a = pick.randint(0, len(s) // 2)
            parts += [s[a : pick.randint(a, len(s))], words(1000 + i, pick.randint(0, 20))]
        rows.append((i * 3 % 61, " ".join(parts)))
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_shared_passages(spark, words, parts):
    check(spark, passages(words), parts)


def test_own_repeats_ties_and_odd_rows(spark, odd, words):
    rows = [(1, "ab" * 400), (2, words(1, 40) * 3), (3, "z" * 99), (4, "z" * 100), (5, "z" * 101), (6, words(2, 60)), (6, words(2, 60)),
            (None, words(2, 60)), (7, "é" * 120), (8, "€uro " * 60), (9, None), (10, "")]
    check(spark, rows)
    check(spark, [(r["doc_id"], r["text"]) for r in odd.collect()])


def test_crowded_anchors_send_strings(spark, words, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 2)
    check(spark, passages(words, 40), 7)


def test_blocks_join_without_a_seam(spark, words, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 256)
    monkeypatch.setattr(repeats, "CHUNK", 2000)
    check(spark, passages(words, 30))


def test_empty_and_clashing(spark, none, odd_wide):
    assert repeats.digests(none).count() == 0
    wide = odd_wide.withColumnRenamed("keep", "removed")
    marked, name = repeats.removed_bytes(wide)
    assert name == "_removed" and marked.columns == [*wide.columns, name] and marked.count() == wide.count()


def test_suffix_sort_is_the_plain_order():
    pick = random.Random(7)
    groups = [[bytes(pick.choice(b"ab") for _ in range(pick.randint(1, 12))) for _ in range(pick.choice([1, 2, 7, 30]))] for _ in range(20)]
    texts, segments = [t for g in groups for t in g], np.repeat(np.arange(20), [len(g) for g in groups])
    sizes = np.array([len(t) for t in texts])
    start = np.cumsum(sizes) - sizes
    suffixes = repeats.Suffixes(np.frombuffer(b"".join(texts), np.uint8), start, start + sizes)
    order = suffixes.sort(segments)
    assert [texts[i] for i in order] == [t for g in groups for t in sorted(g)]
    x, y = np.array([pick.randrange(len(texts)) for _ in range(50)]), np.array([pick.randrange(len(texts)) for _ in range(50)])
    common = [next((k for k, (a, b) in enumerate(zip(texts[i], texts[j])) if a != b), min(len(texts[i]), len(texts[j]))) for i, j in zip(x, y)]
    assert suffixes.common(x, y).tolist() == common


def test_a_hash_collision_is_seen(monkeypatch):
    """With hashes that agree for all strings of one size, only the comparison of bytes decides."""
    monkeypatch.setattr(repeats.Prefixes, "of", lambda self, start, size: np.zeros(len(start), np.uint64) + np.uint64(0))
    texts = [b"a" * 100, b"b" * 100, b"a" * 100]
    got = repeats.repeated_starts(texts, np.array([10, 10, 10]), np.zeros(3, np.int64), np.arange(3))
    assert [x.tolist() for x in got] == [[], [], [0]]


def test_equal_digests_of_a_chunk_are_compared(spark, words, monkeypatch):
    """With one digest for everything, what a chunk settles itself is still right."""
    monkeypatch.setattr(repeats, "xxhash", SimpleNamespace(xxh3_128_digest=lambda data: bytes(16)))
    check(spark, passages(words, 30))


def test_equal_strings_have_an_anchor_in_common(words):
    import pyarrow as pa

    shared = words(1, 30)[:100]
    table = pa.table({"doc_id": [1, 2], "text": [words(2, 50) + shared + words(3, 50), shared]})
    texts = repeats.Texts(table, "doc_id", "text")
    hashes, place, lo, hi = repeats.anchors(texts)
    at = [texts.data.tobytes().find(shared.encode(), b) for b in texts.bounds[:-1]]
    mine = [(int(hashes[i]), int(place[i]) - a) for a in at for i in np.flatnonzero((lo <= a) & (a <= hi))]
    assert len(mine) == 2 and mine[0] == mine[1]
    assert (hi >= lo).all() and (place >= hi).all() and (place + repeats.K <= lo + repeats.LENGTH).all()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(d, *digest((t or "").encode(), gone)) for (d, t), gone in zip(rows, brute(rows))}
    assert {tuple(r) for r in queries.op10_suffix_repeats(spark, sf).collect()} == want
