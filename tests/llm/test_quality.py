from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from vecatlas.llm import quality

WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text + " ":
        if c in WHITE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def base(text):
    words, seen, dup = words_of(text), set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


@given(st.text(alphabet=st.sampled_from(list("ab é𝄞#|\n\t ")), max_size=60))
def test_base_counts(text):
    data = text.encode()
    assert quality.base_counts(data, data.split()) == base(text)


def test_distance_is_a_distance():
    p, q = np.array([1, 0]), np.array([0, 5])
    assert quality.distance(p, q) == pytest.approx(1) and quality.distance(p, p * 7) == 0
    assert quality.distance(np.array([1, 1]), np.array([3, 1])) == pytest.approx(quality.distance(np.array([3, 1]), np.array([1, 1])))
    assert quality.distance(np.zeros(2), p) == 0


def test_references_count_everything(spark, words):
    common = [words(i, 1) for i in range(4)]
    rows = [(i, "en" if i % 3 else "de", f"{common[i % 2]} " * 30 + words(i, 50)) for i in range(60)] + [(99, None, "x y"), (98, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    got = quality.language_references(docs)
    for lang in ("en", "de"):
        counts = Counter(w for _, x, t in rows if x == lang and t for w in words_of(t))
        total = sum(counts.values())
        assert got[lang]["total"] == total
        assert got[lang]["words"] == {w.encode(): n for w, n in counts.items() if n >= quality.WORD_SHARE * total}
        assert got[lang]["classes"].sum() == sum(len(t) for _, x, t in rows if x == lang and t)
    assert got[quality.ALL]["total"] == 2


def test_verdicts(spark, words):
    pool = words(0, 30).split()
    pick = np.random.default_rng(1)
    prose = lambda n: " ".join(pick.choice(pool, n))
    rows = [(i, prose(300)) for i in range(60)]
    rows += [(100, prose(300).upper()), (101, " ".join(words(5, 300).split())), (102, prose(40)), (103, None), (104, ""),
             (105, "again and again " * 60), (106, prose(60).upper()[:299])]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in rows], "doc_id long, text string, lang string")
    judged, names = quality.judge(docs)
    got = {r["doc_id"]: r for r in judged.collect()}
    assert all(got[i]["kept"] for i in range(60))
    assert not any(got[i]["kept"] for i in (100, 101, 102, 103, 104, 105))
    assert got[100]["class_distance"] > quality.limit(quality.CLASS_LIMIT, 300) and got[101]["word_distance"] > quality.limit(quality.WORD_LIMIT, 300)
    assert got[102]["base_failed"] and got[105]["base_failed"] and not got[100]["base_failed"]
    assert got[106]["class_distance"] is None and got[106]["word_distance"] is None  # too short to judge


def test_odd_rows_and_clashing_names(odd_wide, none, spark):
    wide = odd_wide.withColumnRenamed("keep", "KEPT")
    judged, names = quality.judge(wide)
    assert names["kept"] == "_kept" and judged.count() == odd_wide.count()
    by_text = {r["text"]: r for r in judged.collect()}
    for text, r in by_text.items():
        assert (r["n_words"], *base(text or "")) == (len(words_of(text or "")), r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.judge(empty)[0].count() == 0


def test_query(spark):
    """The registered query on whole tables: base counts and the base verdict by another way, and the method's verdict from the distances."""
    from vecatlas.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op2_quality_rules(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        words = words_of(texts[r["doc_id"]])
        if len(words) < 3000:  # the plain count of windows takes the square of a text
            assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(texts[r["doc_id"]])
        assert r["n_words"] == len(words)
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])
