"""WordPiece tokenisation of a whole corpus.

The vocabulary travels to the workers behind a size check, and words repeat, so each task keeps its
own word -> pieces table and the corpus is never shuffled. A vocabulary beyond the bound is matched
with joins on distinct words instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecatlas.functions.text import bounded_slices, raw_words, token_places, word_tokens
from vecatlas.session import materialize

# Special tokens and the longest word that is split.
UNKNOWN, CLASS_START, SEPARATOR = "[UNK]", "[CLS]", "[SEP]"
MAX_WORD_CHARS = 200
PREFIX = "##"

MAX_BROADCAST_TOKENS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
_CACHED_WORDS = 500_000
# Texts that share a table of distinct words where the vocabulary is joined.
_CHUNK_BYTES = 4 * 1024 * 1024


def split_word(
    word: str, vocabulary: dict[str, int], unknown: int, longest: int = MAX_WORD_CHARS, longest_rest: int = MAX_WORD_CHARS
) -> list[int]:
    """Greedy longest match; one missing piece makes the whole word unknown.

    ``longest`` is the length of the longest token, ``longest_rest`` that of the longest continuation without its prefix,
    so that no longer piece is looked up.
    """
    if len(word) > MAX_WORD_CHARS:
        return [unknown]
    pieces, start = [], 0
    while start < len(word):
        lead, reach = (PREFIX, longest_rest) if start else ("", longest)
        for end in range(min(len(word), start + reach), start, -1):
            piece = vocabulary.get(lead + word[start:end])
            if piece is not None:
                break
        else:
            return [unknown]
        pieces.append(piece)
        start = end
    return pieces


def special_ids(vocabulary: DataFrame, *tokens: str) -> list[int]:
    found = {r["token"]: r["id"] for r in vocabulary.filter(F.col("token").isin(*tokens)).collect()}
    missing = [t for t in tokens if t not in found]
    if missing:
        raise ValueError(f"vocabulary lacks {missing}")
    return [found[t] for t in tokens]


def wordpiece(
    df: DataFrame, key: str, text: str, vocabulary: DataFrame, max_broadcast_tokens: int = MAX_BROADCAST_TOKENS
) -> DataFrame:
    """Replace ``text`` by ``token_ids ARRAY<BIGINT>``; ``vocabulary`` has ``token, id``."""
    table = vocabulary.select("token", "id").limit(max_broadcast_tokens + 1).toArrow()
    if table.num_rows > max_broadcast_tokens or table.nbytes > MAX_BROADCAST_BYTES:
        return _wordpiece_by_join(df, key, text, vocabulary, special_ids(vocabulary, UNKNOWN)[0])
    tokens = dict(zip(table["token"].to_pylist(), table["id"].to_pylist()))
    if UNKNOWN not in tokens:
        raise ValueError(f"vocabulary lacks ['{UNKNOWN}']")
    unknown = tokens[UNKNOWN]
    longest = max(map(len, tokens))
    longest_rest = max((len(t) - len(PREFIX) for t in tokens if t.startswith(PREFIX)), default=0)
    shared = df.sparkSession.sparkContext.broadcast(tokens)
    columns = [c for c in df.columns if c != text]
    schema = T.StructType(
        [df.schema[c] for c in columns] + [T.StructField("token_ids", T.ArrayType(T.LongType()))]
    )

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = shared.value, {}
        # Raw words such as 'Cat' and 'cat,' share tokens, so tokens are remembered too.
        split: dict[str, list[int]] = {}
        for batch in (part for whole in batches for part in bounded_slices(whole, whole.column(text))):
            if len(known) > _CACHED_WORDS:
                known, split = {}, {}
            ids: list[int] = []
            ends = np.zeros(batch.num_rows + 1, dtype=np.int32)
            for row, line in enumerate(batch.column(text).to_pylist()):
                for word in raw_words(line or ""):
                    pieces = known.get(word)
                    if pieces is None:
                        pieces = known[word] = []
                        for token in word_tokens(word):
                            if token not in split:
                                split[token] = split_word(token, vocabulary, unknown, longest, longest_rest)
                            pieces += split[token]
                    ids += pieces
                ends[row + 1] = len(ids)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), lists], names=[*columns, "token_ids"]
            )

    return df.select(*columns, text).mapInArrow(tokenize, schema)


def _wordpiece_by_join(
    df: DataFrame, key: str, text: str, vocabulary: DataFrame, unknown: int
) -> DataFrame:
    """The same result by joins: every piece of every distinct word is looked up in the vocabulary.

    Texts are dealt to chunks of some megabytes and kept as places among their chunk's distinct words, so a word travels
    once per chunk and not once per occurrence. Its pieces come back to the chunk, where rows with an equal key stay apart.
    """
    columns = [c for c in df.columns if c != text]
    fields = [df.schema[c] for c in columns]
    staged = materialize(df.select(*columns, text).mapInArrow(_places_by_chunk(columns, text), T.StructType([
        *fields, T.StructField("_chunk", T.LongType()), T.StructField("_places", T.BinaryType()),
        T.StructField("_first", T.IntegerType()), T.StructField("_words", T.ArrayType(T.StringType()))])), "texts")
    words = staged.filter("_words is not null").select("_chunk", "_first", F.posexplode("_words").alias("pos", "word")).select(
        "_chunk", (F.col("_first") + F.col("pos")).alias("place"), "word")
    distinct = words.select("word").distinct()
    tokens = vocabulary.groupBy("token").agg(F.max("id").alias("id"))
    # No longer piece is looked up than the vocabulary has, at the start of a word and after it.
    rest = F.when(F.col("token").startswith(PREFIX), F.length("token") - len(PREFIX))
    longest, longest_rest = tokens.agg(*(F.coalesce(F.max(c), F.lit(0)) for c in (F.length("token"), rest))).first()
    size = F.length("word")
    starts = distinct.filter(size <= MAX_WORD_CHARS).select(
        "word", F.explode(F.sequence(F.lit(0), size - 1)).alias("start")
    )
    reach = F.least(size - F.col("start"), F.when(F.col("start") == 0, longest).otherwise(longest_rest))
    spans = starts.select("word", "start", reach.alias("reach")).filter("reach > 0").select(
        "word", "start", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("reach"))).alias("end")
    ).withColumn(
        "token",
        F.concat(
            F.when(F.col("start") > 0, F.lit(PREFIX)).otherwise(F.lit("")),
            F.substr("word", F.col("start") + 1, F.col("end") - F.col("start")),
        ),
    )
    # The pieces of a word, of at most 200 characters, by start; of each start the longest first.
    pieces = spans.join(tokens, "token").groupBy("word").agg(
        F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("end"), "id"))).alias("pieces"))

    def step(state, piece):
        taken = F.struct((-piece["end"]).alias("at"), F.array_append(state["ids"], piece["id"]).alias("ids"))
        return F.when(state["at"] == piece["start"], taken).otherwise(state)

    start_state = F.struct(F.lit(0).alias("at"), F.array().cast("array<bigint>").alias("ids"))
    split = pieces.select("word", F.aggregate("pieces", start_state, step).alias("walk")).select(
        "word", F.when(F.col("walk.at") == F.length("word"), F.col("walk.ids")).alias("ids")
    )
    found = words.join(split, "word", "left").select(
        F.col("_chunk").alias("_of"), "place", F.coalesce("ids", F.array(F.lit(unknown).cast("long"))).alias("ids"))

    def restore(rows: pa.Table, pieces: pa.Table) -> pa.Table:
        order = pa.array(np.argsort(pieces.column("place").to_numpy()))
        lists = pieces.column("ids").combine_chunks().take(order)
        texts = rows.column("_places").to_pylist()
        places = np.frombuffer(b"".join(texts), np.int32)
        row_ends = np.cumsum([0, *(len(t) // 4 for t in texts)])
        piece_ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)[places], dtype=np.int64)])
        ids = pa.ListArray.from_arrays(pa.array(piece_ends[row_ends], pa.int32()), lists.take(pa.array(places)).flatten())
        return pa.table([*(rows.column(c) for c in columns), ids], names=[*columns, "token_ids"])

    chunks = staged.select(*columns, "_chunk", "_places").groupBy("_chunk").cogroup(found.groupBy("_of"))
    return chunks.applyInArrow(restore, T.StructType([*fields, T.StructField("token_ids", T.ArrayType(T.LongType()))]))


def _places_by_chunk(columns: list[str], text: str):
    """Rows with their ``_chunk``, their tokens as ``_places`` (32 bits each) among the chunk's distinct ones, and, on the
    first row of a slice, the ``_words`` that are new in the chunk, the first of them at place ``_first``."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, known, places = TaskContext.get().partitionId() << 33, 0, {}, {}
        for batch in (part for whole in batches for part in bounded_slices(whole, whole.column(text))):
            n = batch.num_rows
            if not n:
                continue
            if held > _CHUNK_BYTES:
                chunk, held, known, places = chunk + 1, 0, {}, {}
            held += batch.nbytes + 64 * n
            first = len(places)
            found, ends = token_places(batch.column(text), True, known, places)
            new = list(islice(places, first, None))
            offsets, data = np.array(ends, np.int32) * 4, np.array(found, np.int32)
            rest = [None] * (n - 1)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in columns), pa.array(np.full(n, chunk)),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
                pa.array([first, *rest], pa.int32()), pa.array([new, *rest], pa.list_(pa.string())),
            ], names=[*columns, "_chunk", "_places", "_first", "_words"])

    return number


def model_input(df: DataFrame, vocabulary: DataFrame, context_length: int = 52) -> DataFrame:
    """Add ``input_ids``: [CLS], the first ``context_length - 2`` ids, [SEP], then zeros."""
    start, end = special_ids(vocabulary, CLASS_START, SEPARATOR)
    row = F.concat(
        F.array(F.lit(start).cast("long")),
        F.slice("token_ids", 1, context_length - 2),
        F.array(F.lit(end).cast("long")),
    )
    padding = F.array_repeat(F.lit(0).cast("long"), F.lit(context_length) - F.size(row))
    return df.withColumn("input_ids", F.concat(row, padding))


def model_windows(df: DataFrame, vocabulary: DataFrame, context_length: int = 52, keep_ids: bool = True) -> DataFrame:
    """A row per ``window`` of ``context_length - 2`` ids, so that no part of a long text is left out.

    Windows are cut from the ids in place, so a long text is not repeated for each of its windows.
    """
    start, end = special_ids(vocabulary, CLASS_START, SEPARATOR)
    step = context_length - 2
    columns = [c for c in df.columns if keep_ids or c != "token_ids"]
    schema = T.StructType([*(df.schema[c] for c in columns), T.StructField("window", T.IntegerType()), T.StructField("input_ids", T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded_slices(whole, whole.column("token_ids"))):
            lists, flat = batch.column("token_ids"), batch.column("token_ids").flatten()
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            windows = np.maximum(1, -(-sizes // step))
            rows = np.repeat(np.arange(len(sizes)), windows)
            number = np.arange(len(rows)) - np.repeat(np.cumsum(windows) - windows, windows)
            held = np.minimum(sizes[rows] - number * step, step)
            starts = np.concatenate([[0], np.cumsum(held)])
            # Places in the ids with the start, the end and the padding behind them.
            at = np.full((len(rows), context_length), len(flat) + 2)
            at[:, 0] = len(flat)
            place = np.arange(step)
            at[:, 1:-1] = np.where(place < held[:, None], starts[:-1, None] + place, len(flat) + 2)
            at[np.arange(len(rows)), held + 1] = len(flat) + 1
            inputs = pa.concat_arrays([flat, pa.array([start, end, 0], flat.type)]).take(pa.array(at.ravel()))
            empty = lists.is_null().take(pa.array(rows))
            made = {
                "token_ids": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat, mask=empty),
                "window": pa.array(number, pa.int32()),
                "input_ids": pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * context_length, pa.int32()), inputs, mask=empty),
            }
            rest = {c: batch.column(c).take(pa.array(rows)) for c in columns if c != "token_ids"}
            yield pa.RecordBatch.from_arrays([(rest | made)[f.name] for f in schema], names=schema.names)

    return df.mapInArrow(cut, schema)


def ids_to_tokens(
    df: DataFrame,
    key: str,
    ids: str,
    vocabulary: DataFrame,
    name: str = "tokens",
    max_broadcast_tokens: int = MAX_BROADCAST_TOKENS,
) -> DataFrame:
    """Add the token of each id, in order; an id outside the vocabulary fails the job."""
    table = vocabulary.select("token", "id").limit(max_broadcast_tokens + 1).toArrow()
    if table.num_rows > max_broadcast_tokens or table.nbytes > MAX_BROADCAST_BYTES:
        return _ids_to_tokens_by_join(df, key, ids, vocabulary, name)
    shared = df.sparkSession.sparkContext.broadcast(table.sort_by("id").combine_chunks())
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.StringType()))])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value["id"].to_numpy()
        tokens = shared.value["token"].combine_chunks()
        for batch in (part for whole in batches for part in bounded_slices(whole, whole.column(ids))):
            lists = batch.column(ids)
            wanted = lists.flatten().to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
            if len(wanted) and not (len(known) and (known[place] == wanted).all()):
                raise ValueError("an id is outside the vocabulary")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            named = pa.ListArray.from_arrays(pa.array(ends), tokens.take(pa.array(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns, named], names=[*batch.schema.names, name])

    return df.mapInArrow(look_up, schema)


def _ids_to_tokens_by_join(
    df: DataFrame, key: str, ids: str, vocabulary: DataFrame, name: str
) -> DataFrame:
    df, key = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "ids"), "_row"
    long = df.select(key, F.posexplode(ids).alias("pos", "id"))
    absent = F.raise_error(F.lit("an id is outside the vocabulary")).cast("string")
    named = long.join(vocabulary.select("id", "token"), "id", "left").withColumn(
        "token", F.coalesce("token", absent)
    )
    gathered = named.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda p: p["token"]).alias(name)
    )
    joined = df.join(gathered, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return joined.drop(key)
