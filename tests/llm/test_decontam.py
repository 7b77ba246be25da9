import numpy as np

from vecatlas.llm import decontam, queries
from vecatlas.llm.tables import documents

QUESTION = ("Alice has 12 apples and gives 3 kg of them to Bob before the market opens, then Alice sells 7 apples "
            "for 2 dollars each. How many apples does Alice still have after the market closes today?")


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_tokens():
    known = decontam.Tokens()
    literal, kinds, at = decontam.canonical("Bob paid $12.50 , for 3 kg (and km) of 7% 2nd".encode().split(), known)
    assert kinds.tolist() == [decontam.NAME, 0, decontam.NUMBER, 0, decontam.NUMBER, decontam.UNIT, 0, 0, 0, decontam.NUMBER, decontam.NUMBER]
    assert 3 not in at.tolist()  # the lone comma


def test_new_numbers_and_names_in_consistent_slots(spark, words):
    other = QUESTION.replace("Alice", "Clara").replace("Bob", "David").replace("12", "15").replace("7", "8").replace("kg", "lbs")
    mixed = QUESTION.replace("then Alice", "then Clara").replace("does Alice", "does Emma")
    docs = [(1, f"{words(1, 50)} {QUESTION} {words(2, 50)}"), (2, f"{words(3, 50)} {other} {words(4, 50)}"),
            (3, f"{words(5, 50)} {mixed} {words(6, 50)}"), (4, words(7, 200)), (5, None), (6, ""), (None, QUESTION), (2, words(8, 30))]
    got = run(spark, docs, [(10, QUESTION), (11, words(9, 40)), (12, "not there"), (13, None), (14, ""), (15, " , ")])
    assert set(got) == {(1, 10), (2, 10), (None, 10)}
    assert got[1, 10]["n_changed"] == 0 and got[2, 10]["n_changed"] >= 4


def test_half_an_item_is_a_hit_and_a_phrase_is_not(spark, words):
    item = words(11, 40)
    ws = item.split()
    docs = [(1, " ".join(["x"] * 9 + ws[:22] + ["y"] * 9)), (2, " ".join(["x"] * 9 + ws[:12] + ["y"] * 9)),
            (3, " ".join(ws[:18] + ["inserted", "words"] + ws[18:])), (4, item.upper())]
    got = run(spark, docs, [(1, item)])
    assert {d for d, _ in got} == {1, 3, 4}


def test_the_filter_holds_every_window(spark):
    windows = spark.createDataFrame([(int(x),) for x in np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 500)], "hash long")
    bits = np.unpackbits(np.frombuffer(decontam._filter(windows), np.uint8))
    spots = decontam._spot(np.array([r["hash"] for r in windows.collect()], np.int64)).astype(np.int64)
    assert len(bits) == 1 << decontam.FILTER_BITS and bits[spots].all() and bits.sum() == len(set(spots.tolist()))


def test_odd_rows_and_clashing_names(spark, odd_wide, none):
    items = spark.createDataFrame([(1, "no id " * 20), (2, "no id " * 20)], "item_id long, text string")
    wide = odd_wide.withColumnRenamed("keep", "_hit_doc")
    left = decontam.without_items(wide, items)
    assert left.columns == wide.columns and left.count() == wide.count() - 1
    assert decontam.contaminated(none, items).count() == 0
    assert decontam.without_items(wide, none.withColumnRenamed("doc_id", "item_id")).count() == wide.count()


def test_query_finds_every_planted_item(spark):
    sf = "/root/testdata/sf0.001"
    items, docs = documents(spark, sf, "benchmark").collect(), documents(spark, sf).collect()
    planted = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in (d["text"] or "")}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(spark, sf).collect()}
    assert planted <= got
    for doc, item in got - planted:  # parts of an item, word for word
        text = " ".join(next(d["text"] for d in docs if d["doc_id"] == doc).lower().split())
        ws = next(i["text"] for i in items if i["item_id"] == item).lower().split()
        assert any(" ".join(ws[k : k + 8]) in text for k in range(len(ws) - 7))


def test_one_inconsistent_slot_leaves_the_rest(spark, words):
    name, number = QUESTION.replace("then Alice", "then Bob"), QUESTION.replace("has 12", "has 7")
    start, many = "The " + words(21, 20) + " the " + words(22, 20), words(23, 30) + " 7 " + words(24, 12) + " 7 " + words(25, 30)
    docs = [(1, name), (2, number), (3, start.replace("The ", "A ")), (4, many.replace(" 7 ", " 8 ", 1)),
            (5, QUESTION.replace("Alice", "Clara").replace("does Clara", "does Alice"))]
    got = run(spark, docs, [(10, QUESTION), (11, start), (12, many)])
    assert set(got) == {(1, 10), (2, 10), (3, 11), (4, 12), (5, 10)}


def test_copies_in_another_letter_case(spark):
    items = documents(spark, "/root/testdata/sf0.001", "benchmark").collect()
    docs = [(2 * k + upper, f(r["text"])) for k, r in enumerate(items) for upper, f in enumerate((str.lower, str.upper))]
    got = run(spark, docs, [(r["item_id"], r["text"]) for r in items])
    assert {(2 * k + upper, r["item_id"]) for k, r in enumerate(items) for upper in (0, 1)} <= set(got)


def test_short_items_word_for_word(spark, words):
    item = "What is the capital of New Caledonia?".split()
    items = [(n, " ".join(item[:n])) for n in range(1, 8)]
    for n in range(1, 8):
        said = " ".join(item[:n])
        docs = [(1, f"{words(1, 30)} {said} {words(2, 30)}"), (2, said.upper()), (3, f"({said})"), (4, words(3, 60)), (5, " ".join(item[: n - 1])),
                (6, " ".join(reversed(item[:n]))), (7, f"{' '.join(item[: n - 1])} else"), (8, None), (9, "")]
        got = {d for d, i in run(spark, docs, items) if i == n}
        assert got == {1, 2, 3} | ({6} if n == 1 else set())


def brute(text, item, share, enough):
    """Whether an item stands in a text word for word, or all its words in order with other numbers."""
    fold = lambda t: [w for w in (decontam._EDGE.sub("", x).lower() for x in t.split()) if w]
    a, b = fold(text), fold(item)
    run_ = longest = 0
    table = {}
    for i, w in enumerate(b):
        table.setdefault(w, []).append(i)
    last = {}
    covered = {}
    for i, w in enumerate(a):
        now = {}
        for j in table.get(w, ()):
            now[j] = run_ = last.get(j - 1, 0) + 1
            longest = max(longest, run_)
            if run_ >= min(decontam.WINDOW, len(b)):
                covered.setdefault(i - j, set()).update(range(j - run_ + 1, j + 1))
        last = now
    whole = set().union(*covered.values()) if covered else set()
    return len(b) > 0 and (len(whole) >= share * len(b) or len(whole) >= enough)


def test_passages_word_for_word_against_brute_force(spark):
    """Every item that brute force finds word for word is found, and other hits have changed names or numbers."""
    sf = "/root/testdata/sf0.001"
    items, docs = documents(spark, sf, "benchmark").collect(), documents(spark, sf).collect()
    want = {(d["doc_id"], i["item_id"]) for d in docs for i in items if brute(d["text"] or "", i["text"], decontam.SHARE, decontam.ENOUGH)}
    found = decontam.contaminated(documents(spark, sf), documents(spark, sf, "benchmark")).collect()
    assert want and want <= {(r["doc_id"], r["item_id"]) for r in found}
    assert {(r["doc_id"], r["item_id"]) for r in found if not r["n_changed"]} <= want
