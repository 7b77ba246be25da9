import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vecatlas.llm import queries, simhash
from vecatlas.llm.graph import components

SIGN = lambda x: x - (1 << 64) if x >> 63 else x


def plain(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return SIGN(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))


def test_fingerprints(odd, none, words):
    got = {(r["doc_id"], r["fp"]) for r in simhash.fingerprints(odd).collect()}
    assert got == {(r["doc_id"], plain(r["text"])) for r in odd.collect()}
    assert simhash.fingerprints(none).count() == 0
    assert simhash.fingerprint(simhash.shingle_hashes(words(1, 400).encode(), 5)) == plain(words(1, 400), 5)


def test_spark_and_python_hash_alike(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row["h"] == SIGN(int(simhash.shingle_hashes(b"A b\tC", 3)[0]))


def near_pairs(fps, tau):
    return {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= tau}


def clustered(seed, n):
    pick, out = random.Random(seed), set()
    while len(out) < n:
        center = pick.getrandbits(64)
        for _ in range(12):
            fp = center
            for _ in range(pick.randint(0, 3)):
                fp ^= 1 << pick.choice([1, 2, 3, 40, 41, 63, pick.randrange(64)])
            out.add(SIGN(fp))
    return sorted(out)


@pytest.mark.parametrize("tau", [0, 1, 2, 3])
@pytest.mark.parametrize("crowd", [2, 2048])
def test_all_links_are_found(spark, tau, crowd):
    fps = [*clustered(tau, 150), 0, SIGN(1 << 63), -1]
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), tau, crowd)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == near_pairs(fps, tau)


def test_correlated_bits_share_a_partition():
    correlations = np.full((64, 64), 0.01)
    block = [3, 9, 17, 33, 50, 61]
    correlations[np.ix_(block, block)] = 0.9
    parts = simhash.bit_partitions(correlations, 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert any(set(block) <= set(p) for p in parts)


def test_thresholds_are_unequal_where_that_is_cheaper():
    # The second partition is costly to match exactly, the first is cheap even with a flipped bit.
    costs = [[0, 1, 2, 9], [0, 1000, 2000, 3000], [0, 5, 50, 500]]
    assert simhash.allocate(costs, 3) == (7, [1, -1, 0])


def test_groups(spark, odd, none):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(5, text), (3, text), (9, text.upper()), (4, None), (8, ""), (6, "alone in the world"), (None, text), (5, text)]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 3), (3, 3), (9, 3), (4, 4), (8, 4), (6, 6), (None, 3)}
    assert simhash.near_groups(odd).count() == odd.count() and simhash.near_groups(none).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 300)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_are_removed(spark, words):
    pick = random.Random(3)

    def edited(text, n):
        ws = text.split()
        for at in pick.sample(range(len(ws)), n):
            ws[at] = "edited"
        return " ".join(ws)

    rows = []
    for g in range(30):
        text = words(g, 60 + 20 * g)
        rows += [(g * 10, text), (g * 10 + 1, edited(text, max(1, len(text.split()) // 120))), (g * 10 + 2, text)]
        rows += [(g * 10 + 3, edited(text, len(text.split()) // 8))]  # too different
    rows += [(900, None), (901, " "), (902, ""), (903, "short text"), (904, "short text"), (905, "short words")]
    docs = spark.createDataFrame([(t, d, "x") for d, t in rows], "text string, doc_id long, node string")
    sets = {d: set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for d, t in rows}
    group = {d: d for d in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            union = sets[a] | sets[b]
            if a < b and (not union or len(sets[a] & sets[b]) / len(union) >= 0.8):
                group[max(root(a), root(b))] = min(root(a), root(b))
    got = simhash.without_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(d for d in sets if root(d) == d)


def brute_groups(rows):
    """The rows that stay: of smallest id in their groups over all pairs."""
    sets = {d: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for d, t in rows}
    group = {d: d for d in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group[max(root(a), root(b))] = min(root(a), root(b))
    return sorted(d for d in sets if root(d) == d), sets


def families(words):
    """Families of a template, variants just under 0.8 of it, and a near copy of each variant."""
    pick, rows, pairs = random.Random(11), [], []
    for g in range(60):
        ws = words(1000 + g, 120).split()
        rows.append((100 * g, " ".join(ws)))
        for v in range(1, 4):
            own = [*ws[: 120 - 15], *words(5000 + 10 * g + v, 15).split()]
            copy = list(own)
            copy[110] = pick.choice(["edited", "changed"])
            rows += [(100 * g + 10 * v, " ".join(own)), (100 * g + 10 * v + 1, " ".join(copy))]
            pairs.append((100 * g + 10 * v, 100 * g + 10 * v + 1))
    return rows, pairs


@pytest.mark.parametrize("block, rounds", [(simhash.BLOCK, simhash.ROUNDS), (2, (1, 1 << 62))])
def test_variants_of_a_template_meet_each_other(spark, words, monkeypatch, block, rounds):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    # Only one bucket per text, so no other one brings the variants together.
    monkeypatch.setattr(simhash, "class_fingerprints", lambda hashes: [1])
    rows, pairs = families(words)
    rows = rows[:140]
    want, sets = brute_groups(rows)
    assert any(len(sets[0] & sets[d]) < 0.8 * len(sets[0] | sets[d]) for d in (10, 20, 30)) and len(want) < len(rows)
    got = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want


def with_passage(words, n):
    """Different texts, a third of which hold one long passage, and near copies of some."""
    pick, passage, rows = random.Random(9), words(77, 40), []
    for i in range(n):
        ws = words(20_000 + i, 50).split()
        if i % 3 == 0:
            ws[25:25] = passage.split()
        rows.append((2 * i, " ".join(ws)))
        if i % 10 == 0:
            ws[pick.randrange(len(ws))] = "edited"
            rows.append((2 * i + 1, " ".join(ws)))
    return rows


def test_a_passage_in_a_third_of_the_rows(spark, words, monkeypatch):
    """Its classes are crowded: rows meet in rarer ones, and what is compared grows with the rows."""
    monkeypatch.setattr(simhash, "CROWD", 64)
    compared, cells = [], simhash._unsettled

    def counted(rest, held, *others):
        assert held is None  # each row has enough rare classes
        compared[-1] += rest.groupBy("key").count().selectExpr("sum(count * count)").first()[0] or 0
        return cells(rest, held, *others)

    monkeypatch.setattr(simhash, "_unsettled", counted)
    for n in (300, 1200):
        rows = with_passage(words, n)
        compared.append(0)
        got = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(r["doc_id"] for r in got.collect()) == brute_groups(rows)[0]
    assert compared[1] < 8 * compared[0] + 1000


def test_rows_of_crowded_classes_alone_meet_all(spark, words, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 16)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "QUIET", 1 << 20)  # all rows are lonely
    rows = with_passage(words, 150) + [(10_000 + d, t) for d, t in families(words)[0][:70]]
    got = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == brute_groups(rows)[0]


def test_share_of_pairs_found():
    """Texts just above the limit share a class in nearly all cases, whatever their length."""
    pick = np.random.default_rng(2)
    for n in (9, 30, 200, 1000):
        found = 0
        for _ in range(200):
            both = pick.integers(0, 1 << 63, int(np.ceil(0.8 * n / 0.9)), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, pick.integers(0, 1 << 63, (n - len(both)), dtype=np.uint64)])) for _ in range(2))
            found += bool(set(simhash.class_fingerprints(a)) & set(simhash.class_fingerprints(b)))
        assert found >= 196


def test_families_against_brute_force(spark, words):
    rows, _ = families(words)
    got = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == brute_groups(rows)[0]


def test_profiles_never_rule_out_a_pair():
    pick = np.random.default_rng(5)
    for n in (1, 5, 40, 300, 5000, 90_000):
        whole = np.unique(pick.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64) << np.uint64(1))
        for share in (0.0, 0.5, 0.9, 1.0):
            y = np.unique(np.concatenate([whole[: int(n * share)], whole[n : 2 * n - int(n * share)]]))
            x = whole[:n]
            bound = simhash.most_similarity(simhash.unpacked([simhash.set_profile(x)]), simhash.unpacked([simhash.set_profile(y)]))
            assert bound[0] >= simhash.similarity(x.tobytes(), y.tobytes())


def test_near_copies_of_odd_rows(odd_wide, none):
    got = [r["text"] for r in simhash.without_near_copies(odd_wide).collect()]
    assert len(got) == len(set(got)) and sum(t is None or not t.strip() for t in got) == 1
    assert simhash.without_near_copies(none).count() == 0


def test_query(spark):
    got = queries.op6_simhash(spark, "/root/testdata/sf0.001").collect()
    rows = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {d: f"{fp & (1 << 64) - 1:016x}" for d, fp in rows.items()}
    group = dict(rows)
    ids = sorted(rows)
    best = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if best[b] < best[a] and bin((group[a] ^ group[b]) & (1 << 64) - 1).count("1") <= 2:
                    best[a] = best[b]
                    changed = True
    assert {r["doc_id"]: r["component_id"] for r in got} == best
