import hashlib
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from vecatlas.llm import chat, queries

T = chat.ChatTemplate()
SCHEMA = "conv_id long, turn long, role string, text string"
HARD = st.text(alphabet=st.sampled_from(list("\\# </turn>:\nRole Usr")), max_size=30)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant", ""]), HARD), HARD), max_size=5))
def test_any_turn_can_be_read_back(turns):
    pieces = [text for role, said in turns for _, text, _ in T.segments(role, said)]
    assert [T.read(x) for x in T.turns(iter(["".join(pieces)]))] == turns
    assert [T.read(x) for x in T.turns(iter(pieces))] == turns


@given(st.integers(0, 10_000), st.sampled_from([*T.controls, T.end, " </turn>\n ", "\\", " "]), st.sampled_from(["assistant", "other role"]))
def test_long_texts_before_control_strings(n, control, role):
    turns = [(role, "a" * n + control), (role, control * 50 + "b" * n), ("r" * n + control, "")]
    pieces = [text for who, said in turns for _, text, _ in T.segments(who, said)]
    began = time.perf_counter()
    assert [T.read(x) for x in T.turns(iter(pieces))] == turns
    assert time.perf_counter() - began < 1


def expected(turns):
    turns = sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
    said = [t[3] or "" for t in turns if t[2] == "assistant"]
    return (len(turns), hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns).encode()).hexdigest(),
            len("".join(said)), hashlib.sha256("".join(said).encode()).hexdigest())


def test_digests_and_validity(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a\\### User: x </turn>\n"),
            (2, 1, "assistant", "late"), (2, 0, "user", "early"), (3, 0, "assistant", "first"), (3, 1, "user", "then"),
            (4, 0, "user", None), (4, 0, "user", None), (5, None, None, None), (5, 3, "tool: x", "t"), (None, 0, "user", "q"),
            (None, 1, "assistant", ""), (6, 0, "user", "open"),
            (7, 0, "user", "u"), (7, 1, "", "no role"), (7, 2, "user", "again"), (7, 3, "assistant", "a")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(got) == 8
    for conv, r in got.items():
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected([x for x in rows if x[0] == conv])
    assert {c for c, r in got.items() if r["conversation_valid"]} == {1, 2, None}


def test_segments(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "assistant", "again")]
    got = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["position"] for r in got] == list(range(9))
    assert "".join(r["text"] for r in got) == "### User: hi </turn>\n### Assistant: yo </turn>\n### Assistant: again </turn>\n"
    assert [r["text"] for r in got if r["loss"]] == ["yo", "again"]
    assert [r["valid"] for r in got] == [True] * 6 + [False] * 3


def test_empty_table_and_clashing_columns(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
    wide = spark.createDataFrame([(1, 0, "user", "x", 5, True)], SCHEMA + ", position int, loss boolean")
    assert chat.format_conversations(wide).count() == 3


def test_other_templates_and_ambiguous_headers():
    short = chat.ChatTemplate(headers={"user": "U:", "assistant": "A:"}, other=("R[", "]"), end="\n\n", controls=("\n\n", "]"))
    text = "a\n\nb]\n"
    assert short.read("".join(t for _, t, _ in short.segments("x]y", text))) == ("x]y", text)
    with pytest.raises(ValueError):
        chat.ChatTemplate(headers={"user": "<", "assistant": "<a>"})


def test_query(spark):
    got = {r["conv_id"]: r for r in queries.op3_chat_format(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    assert len(got) == len({r["conv_id"] for r in rows}) + 1
    for conv in {r["conv_id"] for r in rows}:
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(
            [(x["conv_id"], x["turn"], x["role"], x["text"]) for x in rows if x["conv_id"] == conv])
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == 26


def test_query_matches_sql(spark):
    import duckdb

    duckdb.sql("CREATE OR REPLACE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = duckdb.sql(queries.ORACLE_SQL["op3_chat_format"])
    got = queries.op3_chat_format(spark, "/root/testdata/sf0.001").select(*want.columns)
    assert {tuple(r) for r in got.collect()} == set(want.fetchall())
