import hashlib
import random
import zlib

import pytest

from vecatlas.llm import manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        other = at ^ 1
        out.append((nodes[other], other < at) if other < len(nodes) else None)
        at //= 2
    return out


def brute(rows):
    groups = {}
    for row in rows:
        own = claim = leaf(row)
        if row["doc_id"] is not None and row["n_chars"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0:
            claim = leaf({**row, "n_chars": row["n_chars"] + 1})
        groups.setdefault(row["lang"], []).append(((row["doc_id"] is not None, row["doc_id"] or 0, own), row["doc_id"], own, claim))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g])]) if all(x[1] is not None for x in groups[g]) else
             tree([x[2] for x in sorted(groups[g], key=lambda x: x[0])]) for g in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for g, name in enumerate(names):
        for at, (_, doc, own, claim) in enumerate(sorted(groups[name], key=lambda x: x[0])):
            steps, node = path(trees[g], at) + path(top, g), claim
            for step in steps:
                node = digest(node) if step is None else digest(step[0], node) if step[1] else digest(node, step[0])
            out.append((doc, own, trees[g][-1][0], top[-1][0], digest(*(s[0] for s in steps if s)), node, node == top[-1][0]))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def compare(df):
    got = manifest.document_manifest(df).collect()
    assert ordered(got) == ordered(brute([r.asDict() for r in df.select(*FIELDS).collect()]))
    return got


def test_documents(spark):
    got = compare(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert {r["verified"] for r in got} == {True, False}


def test_ties_nulls_and_scattered_keys(spark):
    pick = random.Random(4)
    keys = lambda: pick.choice([None, 1, 1, -3, 1 << 40, -(1 << 62), (1 << 63) - 1, 8191, 8192, pick.randrange(40_000)])
    rows = [(keys(), pick.choice([None, "", "ä"]), pick.choice([None, "", "en", "zä"]), pick.choice([None, 3]), pick.choice([None, "", "t"]))
            for _ in range(5000)]
    compare(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("n", [1, 2, 3, 1024, 1025, 2049])
def test_sizes_of_one_group(spark, n):
    compare(spark.createDataFrame([(7 * i, "s", "en", i, "t" * (i % 5)) for i in range(n)], SCHEMA))


def test_many_groups(spark):
    compare(spark.createDataFrame([(i, "s", f"g{i % 1100}", i, None) for i in range(1500)], SCHEMA))


def test_one_repeated_row_and_long_text(spark):
    compare(spark.createDataFrame([(5, "s", "en", 1, "same")] * 3000 + [(6, None, None, None, "x" * 2_000_000)], SCHEMA))


def test_empty_table_and_clashing_names(spark):
    empty = manifest.document_manifest(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    wide = spark.createDataFrame([(i, "s", "en", i, "t", 1, "x", True, 2, "y") for i in range(20)],
                                 SCHEMA + ", block int, grp string, known boolean, low int, leaf string")
    compare(wide)


def test_proofs_lead_from_leaves_to_the_root(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = manifest.merkle_manifest(docs, "doc_id", "lang", manifest.digest(*(docs[f] for f in FIELDS)))
    for r in made.limit(50).collect():
        assert manifest.folded(bytes(r["leaf"]), bytes(r["proof"]), bytes(r["sides"])) == bytes(r["root"]) == bytes(r["folded"])
        assert manifest.folded(bytes(32), bytes(r["proof"]), bytes(r["sides"])) != bytes(r["root"])
