"""BERT-style basic tokenisation, detokenisation and prompt rewriting as column functions.

The single steps are JVM expressions, except ``fold_accents``: Spark has no Unicode decomposition.
``basic_tokens`` does all of them in one Arrow UDF instead. None of the steps looks beyond a word, and
words repeat, so a task works out each distinct word once; that is several times faster than a chain
of regular expressions over the text. Java and Python may carry different Unicode versions, so the
steps can class the newest characters differently; ``basic_tokens`` uses Python's.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code point ranges whose characters become tokens of their own.
CJK_RANGES = (
    (0x4E00, 0x9FFF),
    (0x3400, 0x4DBF),
    (0x20000, 0x2A6DF),
    (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F),
    (0x2B820, 0x2CEAF),
    (0xF900, 0xFAFF),
    (0x2F800, 0x2FA1F),
)
# What str.strip and str.split take as white space.
WHITESPACE = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# The replacements after joining tokens, applied in this order.
CLEAN_UP = (
    (" .", "."),
    (" ?", "?"),
    (" !", "!"),
    (" ,", ","),
    (" ' ", "'"),
    (" n't", "n't"),
    (" 'm", "'m"),
    (" 's", "'s"),
    (" 've", "'ve"),
    (" 're", "'re"),
)
# The sentence that several keywords are put into.
PROMPT_START = "一张照片同时包含了"
PROMPT_SEPARATOR = "、"
PROMPT_LAST = "和"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def clean_text(text: Column) -> Column:
    spaced = F.regexp_replace(text, r"[\t\n\r\p{Zs}]", " ")
    return F.regexp_replace(spaced, r"[\x00\x{FFFD}\p{Cc}\p{Cf}]", "")


def isolate_cjk(text: Column) -> Column:
    ranges = "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in CJK_RANGES)
    return F.regexp_replace(text, f"([{ranges}])", " $1 ")


def isolate_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"([!-/:-@\[-`{-~\p{P}])", " $1 ")


def split_whitespace(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WHITESPACE}]+"), lambda word: word != "")


def _ranges(codes: Iterable[int]) -> str:
    """The body of a character class."""
    spans: list[list[int]] = []
    for code in codes:
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(rf"\U{low:08x}-\U{high:08x}" for low, high in spans)


def _category_ranges() -> dict[str, str]:
    codes: dict[str, list[int]] = {"Mn": [], "C": [], "P": []}
    for code in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(code))
        if category == "Mn":
            codes["Mn"].append(code)
        elif category in ("Cc", "Cf"):
            codes["C"].append(code)
        elif category[0] == "P":
            codes["P"].append(code)
    return {name: _ranges(found) for name, found in codes.items()}


# Built once on the driver; tasks receive the patterns.
_CATEGORIES = _category_ranges()
_MARKS = re.compile(f"[{_CATEGORIES['Mn']}]+")
_REMOVED = re.compile(f"[{_CATEGORIES['C']}\uFFFD]+")
_CJK = re.compile("[" + "".join(rf"\U{low:08x}-\U{high:08x}" for low, high in CJK_RANGES) + "]")
_ASCII_MARKS = r"!-/:-@\[-`{-~"
_ASCII_TOKENS = re.compile(f"[{_ASCII_MARKS}]|[^{_ASCII_MARKS}]+")
_TOKENS = re.compile(f"[{_ASCII_MARKS}{_CATEGORIES['P']}]|[^{_ASCII_MARKS}{_CATEGORIES['P']}]+")
# Control characters that are removed although str.split would split at them.
_SPLITTING_CONTROLS = re.compile("[\x0b\x0c\x1c-\x1f\x85]")

_CACHED_WORDS = 500_000
# A task makes lists of Python values for so many bytes of input at a time, however large Spark's batches are.
SLICE_BYTES = 1 << 20


def bounded_slices(rows: pa.Array | pa.RecordBatch, column: pa.Array) -> Iterator[pa.Array | pa.RecordBatch]:
    """Slices of the rows with at most ``SLICE_BYTES`` of text, or of 8-byte list entries, in ``column``, or one row."""
    lists = pa.types.is_list(column.type)
    sizes = pc.fill_null(column.value_lengths() if lists else pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes.astype(np.int64) * (8 if lists else 1) + 64) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(piece, prepend=-1)).tolist() or [0]
    for lo, hi in zip(starts, [*starts[1:], len(column)]):
        yield rows.slice(lo, hi - lo)


def fold(text: str) -> str:
    """Lower-case, decompose and drop non-spacing marks."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFD", text.lower()))


@F.arrow_udf(T.StringType())
def fold_accents(texts: pa.Array) -> pa.Array:
    if pc.all(pc.string_is_ascii(texts)).as_py() is not False:
        return pc.ascii_lower(texts)
    return pa.array([None if t is None else fold(t) for t in texts.to_pylist()], pa.string())


def raw_words(text: str) -> list[str]:
    """Words as they stand between white space."""
    return _SPLITTING_CONTROLS.sub("", text).split()


def word_tokens(word: str, lower_case: bool = True) -> list[str]:
    """The basic tokens of one raw word."""
    if not word.isprintable() or "\ufffd" in word:
        word = _REMOVED.sub("", word)
    if word.isascii():
        return _ASCII_TOKENS.findall(word.lower() if lower_case else word)
    tokens: list[str] = []
    for part in _CJK.sub(r" \g<0> ", word).split() if _CJK.search(word) else (word,):
        part = fold(part) if lower_case else part
        if part.isalnum():
            tokens.append(part)
        else:
            tokens += _TOKENS.findall(part)
    return tokens


def token_places(texts: pa.Array, lower_case: bool, known: dict[str, list[int]], places: dict[str, int]) -> tuple[list[int], list[int]]:
    """The tokens of a batch as places among all tokens seen, and where each text's end; ``known`` maps raw words to places."""
    found: list[int] = []
    ends: list[int] = [0]
    for text in texts.to_pylist():
        for word in raw_words(text or ""):
            tokens = known.get(word)
            if tokens is None:
                tokens = [places.setdefault(t, len(places)) for t in word_tokens(word, lower_case)]
                known[word] = tokens
            found += tokens
        ends.append(len(found))
    return found, ends


def _token_lists(texts: pa.Array, lower_case: bool, known: dict[str, list[int]], places: dict[str, int]) -> pa.Array:
    found, ends = token_places(texts, lower_case, known, places)
    values = pa.array(list(places), pa.string()).take(pa.array(found, pa.int32()))
    nulls = texts.is_null() if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=nulls)


def _tokenizer(lower_case: bool):
    def tokenize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, list[int]] = {}
        places: dict[str, int] = {}
        for texts in (part for batch in batches for part in bounded_slices(batch, batch)):
            if len(known) > _CACHED_WORDS:
                known, places = {}, {}
            yield _token_lists(texts, lower_case, known, places)

    return F.arrow_udf(tokenize, T.ArrayType(T.StringType()))


def basic_tokens(text: Column, lower_case: bool = True) -> Column:
    return _tokenizer(lower_case)(text)


def tokens_to_string(tokens: Column, clean_up: bool = True) -> Column:
    text = strip(F.replace(F.array_join(tokens, " "), F.lit(" ##"), F.lit("")))
    if clean_up:
        for found, written in CLEAN_UP:
            text = F.replace(text, F.lit(found), F.lit(written))
    return text


def rewrite_prompt(text: Column, legacy: bool = False) -> Column:
    """Several keywords become one sentence naming them all; a single keyword is unchanged.

    ``legacy`` loses the keyword before the last one.
    """
    stripped = strip(text)
    words = F.split(stripped, f"[{WHITESPACE}|,]")
    lead = F.slice(words, F.lit(1), F.greatest(F.size(words) - (2 if legacy else 1), F.lit(0)))
    sentence = F.concat(
        F.lit(PROMPT_START), F.array_join(lead, PROMPT_SEPARATOR), F.lit(PROMPT_LAST), F.element_at(words, -1)
    )
    return F.when(F.size(words) > 1, sentence).otherwise(stripped)
