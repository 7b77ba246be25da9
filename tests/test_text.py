import random
import unicodedata

from pyspark.sql import functions as F

from vecatlas.functions import text as T
from vecatlas.operators import wordpiece as wp
from vecatlas.operators.wordpiece import ids_to_tokens, model_input, split_word, wordpiece
from vecatlas.session import materialize
from vecatlas.sources.vocabulary import read_vocabulary, vocabulary_size


def words_of(text):
    """Independent restatement on single characters."""
    kept = []
    for c in text:
        kind = unicodedata.category(c)
        if c in "\t\n\r" or kind == "Zs":
            kept.append(" ")
        elif c != "�" and kind not in ("Cc", "Cf"):
            kept.append(f" {c} " if any(a <= ord(c) <= b for a, b in T.CJK_RANGES) else c)
    plain = "".join(c for c in unicodedata.normalize("NFD", "".join(kept).lower())
                    if unicodedata.category(c) != "Mn")
    marked = (f" {c} " if unicodedata.category(c)[0] == "P" or c in "$+<=>^`|~" else c for c in plain)
    return "".join(marked).split()


def tokens(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", T.basic_tokens(F.col("t")).alias("w")).orderBy("i").collect()
    return [r["w"] for r in rows]


def test_literal_tokens(spark):
    cases = {
        "ab中𠀁x": ["ab", "中", "𠀁", "x"],
        "한글 かな": [unicodedata.normalize("NFD", "한글"), "かな"],
        "Élève": ["eleve"],
        "a$b—c": ["a", "$", "b", "—", "c"],
        "so­ft a　b c\x00�\td": ["soft", "a", "b", "c", "d"],
        "a≠b": ["a", "=", "b"],
        " ": [],
    }
    assert tokens(spark, list(cases)) == list(cases.values())


def test_tokens_equal_character_rules(spark):
    rng = random.Random(1)
    pool = ([chr(c) for c in range(1, 0x600)] + [chr(c) for c in range(0x1E00, 0x2070)]
            + list("中文𠀁한글かなΣΑΣ ≠≮≯`;Kİ") + [" "] * 300)
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 200))) for _ in range(300)]
    assert tokens(spark, texts) == [words_of(t) for t in texts]


def test_single_steps_compose_to_the_same_tokens(spark):
    texts = ["ab中𠀁x Élève—ΑΣ.Α", "한글 a≠b\x0bc", "so­ft a　b c\x00�\td", "", "a\x85b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    steps = T.fold_accents(T.isolate_cjk(T.clean_text(F.col("t"))))
    both = df.select(T.split_whitespace(T.isolate_punctuation(steps)), T.basic_tokens(F.col("t"))).collect()
    assert all(left == right for left, right in both)
    kept = df.limit(1).select(T.basic_tokens(F.col("t"), lower_case=False)).first()[0]
    assert kept == ["ab", "中", "𠀁", "x", "Élève", "—", "ΑΣ", ".", "Α"]
    assert spark.sql("select cast(null as string) as t").select(T.basic_tokens(F.col("t"))).first()[0] is None


def test_detokenise(spark):
    words = "un ##aff ##able , is n't it ?".split()
    row = spark.range(1).select(T.tokens_to_string(F.array(*map(F.lit, words))).alias("t"),
                                T.tokens_to_string(F.array(*map(F.lit, words)), False).alias("u")).first()
    assert tuple(row) == ("unaffable, isn't it?", "unaffable , is n't it ?")


def test_rewrite(spark):
    df = spark.createDataFrame([("cat dog",), ("a b c",), ("a, b",), ("one",), ("x|y",), ("  cat  ",)], "t string")
    rows = df.select(T.rewrite_prompt(F.col("t")), T.rewrite_prompt(F.col("t"), True)).collect()
    start = T.PROMPT_START
    assert [tuple(r) for r in rows] == [
        (start + "cat和dog", start + "和dog"),
        (start + "a、b和c", start + "a和c"),
        (start + "a、和b", start + "a和b"),
        ("one", "one"),
        (start + "x和y", start + "和y"),
        ("cat", "cat"),
    ]


VOCABULARY = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "a", "##a", ","]


def vocabulary(spark):
    return spark.createDataFrame([(t, i) for i, t in enumerate(VOCABULARY)], "token string, id long")


def test_split_word():
    known = {t: i for i, t in enumerate(VOCABULARY)}
    assert split_word("unaffable", known, 1) == [4, 5, 6]
    assert split_word("unx", known, 1) == [1]
    assert split_word("a" * 200, known, 1) == [7] + [8] * 199
    assert split_word("a" * 201, known, 1) == [1]


def test_wordpiece_both_ways(spark):
    texts = ["Unaffable, un a", "", "xyz a" + "a" * 199, "a" * 201 + " aa", "ünaff able"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    expected = [[4, 5, 6, 9, 4, 7], [], [1, 7] + [8] * 199, [1, 7, 8], [4, 5, 1]]
    for bound in (100, 2):
        rows = wordpiece(df, "k", "t", vocabulary(spark), bound).orderBy("k").collect()
        assert [r["token_ids"] for r in rows] == expected


def test_model_rows_and_inverse(spark):
    df = spark.createDataFrame([(0, list(range(10))), (1, [5]), (2, [])], "k int, token_ids array<long>")
    rows = model_input(df, vocabulary(spark), 6).orderBy("k").collect()
    assert [r["input_ids"] for r in rows] == [
        [2, 0, 1, 2, 3, 3], [2, 5, 3, 0, 0, 0], [2, 3, 0, 0, 0, 0]]
    for bound in (100, 2):
        named = ids_to_tokens(df, "k", "token_ids", vocabulary(spark), max_broadcast_tokens=bound)
        assert [r["tokens"] for r in named.orderBy("k").collect()] == [VOCABULARY, ["##aff"], []]


def test_vocabulary_file(spark, tmp_path):
    (tmp_path / "vocab.txt").write_bytes("a\r\n\n b　\na\n\nc".encode())
    loaded = read_vocabulary(spark, str(tmp_path / "vocab.txt"))
    assert {r["token"]: r["id"] for r in loaded.collect()} == {"a": 3, "": 4, "b": 2, "c": 5}
    assert vocabulary_size(loaded).first()[0] == 4


def test_slices_are_bounded(monkeypatch):
    import pyarrow as pa

    from vecatlas.functions import text

    monkeypatch.setattr(T, "SLICE_BYTES", 1000)
    for column in (pa.array(["a" * n for n in (10, 900, 5000, 0, 300)] + [None] * 40), pa.array([[1] * n for n in (1, 100, 900, 0)] + [None] * 40)):
        parts = list(text.bounded_slices(column, column))
        assert pa.concat_arrays(parts).equals(column) and len(parts) > 3 and max(map(len, parts)) <= 16
        assert len(list(text.bounded_slices(column.slice(0, 0), column.slice(0, 0)))) == 1


def test_joined_vocabulary_sends_a_word_once_per_chunk(spark, monkeypatch):
    """Chunks of a few texts, repeated and null keys, null and empty texts: the pieces of the broadcast vocabulary."""
    known = spark.createDataFrame(
        [("[UNK]", 1), ("ab", 2), ("abc", 3), ("##c", 4), ("##cd", 5), ("x", 6), ("a", 7), ("##b", 8)], "token string, id long")
    texts = ["abcd abc x", "abcd " * 40, None, "", "zz a" + "b" * 250, "abcdcdc, ABC"]
    rows = [(i % 4 or None, texts[i % 6]) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, t string").coalesce(1)
    kept = []
    monkeypatch.setattr(wp, "materialize", lambda df, tag: kept.append(materialize(df, tag)) or kept[-1])
    monkeypatch.setattr(wp, "_CHUNK_BYTES", 2000)
    monkeypatch.setattr(T, "SLICE_BYTES", 1000)
    plain = lambda df: sorted((r["k"] or 0, r["token_ids"]) for r in df.collect())
    want = plain(wp.wordpiece(df, "k", "t", known))
    assert plain(wp.wordpiece(df, "k", "t", known, max_broadcast_tokens=0)) == want
    chunks, sent, held = kept[0].selectExpr("count(distinct _chunk)", "sum(size(_words))", "sum(length(_places)) / 4").first()
    assert 1 < chunks and sent <= 8 * chunks and held > 5 * sent


def test_windows_are_cut_without_repeating_the_text(spark, explain):
    known = spark.createDataFrame([("[CLS]", 2), ("[SEP]", 3)], "token string, id long")
    lists = {0: [], 1: [9], 2: list(range(10, 14)), 3: list(range(20, 29)), 4: None}
    df = spark.createDataFrame(list(lists.items()), "k long, token_ids array<long>")
    cut = wp.model_windows(df, known, 6)
    got = {(r["k"], r["window"]): (r["token_ids"], r["input_ids"]) for r in cut.collect()}
    want = {(4, 0): (None, None)}
    for k, ids in lists.items():
        for n in range(max(1, -(-len(ids) // 4)) if ids is not None else 0):
            part = ids[4 * n : 4 * n + 4]
            want[k, n] = (part, [2, *part, 3, *[0] * (4 - len(part))])
    assert got == want and "Generate" not in explain(cut)
