import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vecatlas.llm import bpe, queries

PATH = public_tokenizers.path(queries.TOKENIZER)
with open(PATH, "rb") as _lines:
    _RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, _lines)}
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_RANKS, special_tokens={})
BPE = bpe.ByteBpe(bpe.read_ranks(PATH, public_tokenizers.PATTERN))


def encode(texts):
    return [x.tolist() for x in BPE.encode_texts(texts, {})]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(texts):
    assert encode(texts) == [REFERENCE.encode_ordinary(t) for t in texts]
    assert [BPE.decode(x).decode() for x in BPE.encode_texts(texts, {})] == texts


def test_long_pieces_merge_equal_pairs_together():
    pick = random.Random(1)
    texts = ["a" * 20_000, "ab" * 5_000, "".join(pick.choice("abcde") for _ in range(6_000)), "é" * 3_000, " " * 9_000,
             "".join(pick.choice("theraion") for _ in range(bpe.LONG + 1)), "#" * (bpe.LONG + 1), "1" * bpe.LONG]
    assert encode(texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_pair_table_with_collisions():
    import numpy as np

    left, right = np.divmod(np.arange(5000), 70)
    table = bpe.PairTable(left, right, np.arange(5000))
    assert (table.get(left, right) == np.arange(5000)).all()
    assert (table.get(left + 1000, right) == bpe.NO_RANK).all()


def test_odd_rows(odd, odd_wide, none):
    rows = bpe.digests(odd, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd.count()
    for r in odd.collect():
        ids = REFERENCE.encode_ordinary(r["text"] or "")
        assert (r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256((r["text"] or "").encode()).hexdigest()) in {tuple(x) for x in rows}
    wide, name = bpe.with_tokens(odd_wide, PATH, public_tokenizers.PATTERN)
    assert name == "_ids" and wide.columns == [*odd_wide.columns, "_ids"]
    assert {(r["text"], tuple(r["_ids"])) for r in wide.collect()} == {
        (r["text"], tuple(REFERENCE.encode_ordinary(r["text"] or ""))) for r in odd.collect()}
    assert bpe.digests(none, PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark):
    """The registered query on the whole table against the library."""
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op9_byte_bpe(spark, sf).collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        ids = REFERENCE.encode_ordinary(text)
        assert got[doc]["n_tokens"] == len(ids)
        assert got[doc]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
