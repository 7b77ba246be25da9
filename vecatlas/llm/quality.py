"""Quality rules: counts with fixed limits, and distance from a language's usual histograms.

Two histograms of a document, of character classes and of the language's common words, are compared with those of
its language by Jensen-Shannon distance (base 2, so 0 to 1). A text too short for a steady histogram is not judged
by it. The references come from all documents: of each language with at least ``LANGUAGE_SHARE`` of the rows,
the class counts and the words that make up at least ``WORD_SHARE`` of its words. Other rows, and those without a
language, share one reference made from those rows.

Sizes: at most 1 / LANGUAGE_SHARE languages with 1 / WORD_SHARE words each, so the references have a bound that
does not grow with the data. A common word must reach a tenth of the share in some part of a scan, and nine
tenths of it in all such parts together; so a first scan finds all candidates, and a second counts them exactly.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecatlas.llm.tables import free_name, small_batches

LANGUAGE_SHARE = 1 / 1000
WORD_SHARE = 1 / 200
ALL = ""  # stands for the rows without such a language
CLASSES = ("lower", "upper", "other letter", "digit", "white space", "punctuation", "symbol", "other")
MIN_CHARS, MIN_WORDS = 300, 100
#: A distance's limit is floor + noise / sqrt(number of words): short texts stray from their language by chance.
CLASS_LIMIT, WORD_LIMIT = (0.13, 1.4), (0.16, 1.6)

SYMBOLS = b"#*$%&|<>"
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_CONTINUATION = bytes(range(0x80, 0xC0))


def class_table() -> np.ndarray:
    """The class of each code point of the basic plane."""
    def of(c: int) -> int:
        kind = unicodedata.category(chr(c))
        if chr(c).isspace():
            return 4
        return {"Ll": 0, "Lu": 1, "Nd": 3}.get(kind, {"L": 2, "M": 2, "N": 3, "P": 5, "S": 6}.get(kind[0], 7))

    return np.array([of(c) for c in range(1 << 16)], np.uint8)


def class_counts(text: bytes, table: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    return np.bincount(table[np.where(points < len(table), points, 0xE000)], minlength=len(CLASSES))


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words."""
    chars = len(text.translate(None, WHITE + _CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(seen)) < len(seen):
        often = {k for k, n in Counter(seen).items() if n > 1}
        covered = np.zeros(len(words), bool)
        at = np.fromiter((x in often for x in seen), bool, len(seen))
        for shift in range(3):
            covered[shift : shift + len(seen)] |= at
        repeated = int(covered.sum())
    return chars, symbols, len(lines) - len(set(lines)), repeated


def distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if either is empty."""
    if not counts.sum() or not reference.sum():
        return 0.0
    p, q = counts / counts.sum(), reference / reference.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def limit(of: tuple[float, float], n_words: int) -> float:
    return of[0] + of[1] / max(1, n_words) ** 0.5


def languages(docs: DataFrame, lang: str) -> list[str]:
    """Languages with enough rows; at most 1 / LANGUAGE_SHARE of them."""
    counts = docs.groupBy(F.col(lang).cast("string").alias("lang")).count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    common = counts.where(F.col("lang").isNotNull() & (F.col("lang") != ALL) & (F.col("count") >= LANGUAGE_SHARE * total))
    return sorted(r["lang"] for r in common.collect())


def _tally(pairs: DataFrame, wanted: dict[str, set[bytes]] | None, names: list[str], share: float) -> DataFrame:
    """Sums by language: words (only ``wanted`` ones, or those common in a part of the scan), classes, number of words."""
    common = frozenset(names)
    small_batches(pairs.sparkSession)

    def run(batches):
        table = class_table() if wanted is None else None

        def rows(words, classes, totals):
            out = []
            for lang, counter in words.items():
                least = share / 10 * totals[lang]
                out += [(lang, "word", w.decode(), n) for w, n in counter.items() if wanted is not None or n >= least]
            for lang, counts in classes.items():
                out += [(lang, "class", str(i), int(n)) for i, n in enumerate(counts)]
            if wanted is None:
                out += [(lang, "words", "", n) for lang, n in totals.items()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else ((),) * 4, (pa.string(),) * 3 + (pa.int64(),))],
                names=["lang", "kind", "key", "n"])

        fresh = lambda: (defaultdict(Counter), defaultdict(lambda: np.zeros(len(CLASSES), np.int64)), Counter())
        words, classes, totals = fresh()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = (text or b"").split()
                own = [lang if lang in common else ALL]
                for group in own:
                    if wanted is None:
                        words[group].update(found)
                        classes[group] += class_counts(text or b"", table)
                        totals[group] += len(found)
                    else:
                        words[group].update(compress(found, map(wanted.get(group, frozenset()).__contains__, found)))
            if sum(map(len, words.values())) > 150_000:
                yield rows(words, classes, totals)
                words, classes, totals = fresh()
        yield rows(words, classes, totals)

    sums = pairs.mapInArrow(run, "lang string, kind string, key string, n long")
    return sums.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def language_references(docs: DataFrame, lang: str = "lang", text: str = "text", share: float = WORD_SHARE) -> dict[str, dict]:
    """Per language {"classes": counts, "words": {word: count}, "total": number of words}; ALL for the rest."""
    pairs = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    names = languages(docs, lang)
    sums = _tally(pairs, None, names, share).persist()
    try:
        fixed = sums.where("kind <> 'word'").collect()
        totals = {r["lang"]: r["n"] for r in fixed if r["kind"] == "words"}
        least = F.lit(None).cast("double")
        for name, total in totals.items():
            least = F.when(F.col("lang") == name, F.lit(0.9 * share * total)).otherwise(least)
        near = sums.where("kind = 'word'").where(F.col("n") >= least).collect()  # at most 1 / (0.9 share) a language
    finally:
        sums.unpersist()
    wanted: dict[str, set[bytes]] = defaultdict(set)
    for r in near:
        wanted[r["lang"]].add(r["key"].encode())
    exact = _tally(pairs, dict(wanted), names, share).where("kind = 'word'").collect()
    out = {name: {"classes": np.zeros(len(CLASSES), np.int64), "words": {}, "total": total} for name, total in totals.items()}
    for r in fixed:
        if r["kind"] == "class":
            out[r["lang"]]["classes"][int(r["key"])] = r["n"]
    for r in exact:
        if r["n"] >= share * totals[r["lang"]]:
            out[r["lang"]]["words"][r["key"].encode()] = r["n"]
    return out


def word_counts(words: list[bytes], common: dict[bytes, int]) -> np.ndarray:
    """Counts of the common words, in their order, then of all others."""
    counts = Counter(compress(words, map(common.__contains__, words)))
    known = np.array([counts[w] for w in common], np.int64)
    return np.append(known, len(words) - known.sum())


ADDED = (("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
         ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("class_distance", T.DoubleType()),
         ("word_distance", T.DoubleType()), ("kept", T.BooleanType()))


def judge(docs: DataFrame, lang: str = "lang", text: str = "text", references: dict[str, dict] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """All rows with the columns of ``ADDED``, and the names they got (underscores in front where ``docs`` has them).

    A null text has no words. ``base_failed``: under 50 words, or over half of the words in repeated three-word
    windows. A distance is null where the text is under MIN_CHARS characters or MIN_WORDS words, or the reference
    is empty. ``kept`` is false for a failed base and for a distance over its ``limit``.
    """
    small_batches(docs.sparkSession)
    known = references if references is not None else language_references(docs, lang, text)
    names = {name: free_name(name, docs.columns) for name, _ in ADDED}

    def run(batches):
        table = class_table()
        ready = {k: (v["classes"], v["words"], np.append(np.array(list(v["words"].values()), np.int64), v["total"] - sum(v["words"].values())))
                 for k, v in known.items()}
        for batch in batches:
            rows = []
            langs = batch.column(batch.schema.get_field_index(lang)).cast(pa.string()).to_pylist()
            for language, whole in zip(langs, batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()):
                whole = whole or b""
                words = whole.split()
                chars, symbols, dup_lines, repeat = base_counts(whole, words)
                failed = len(words) < 50 or 100 * repeat > 50 * len(words)
                classes, common, reference = ready.get(language) or ready.get(ALL) or (np.zeros(len(CLASSES)), {}, np.zeros(1))
                by_class = by_word = None
                if len(whole) >= MIN_CHARS and classes.sum() and (counts := class_counts(whole, table)).sum() >= MIN_CHARS:
                    by_class = distance(counts, classes)
                if len(words) >= MIN_WORDS and common:
                    by_word = distance(word_counts(words, common), reference)
                far = (by_class or 0) > limit(CLASS_LIMIT, len(words)) or (by_word or 0) > limit(WORD_LIMIT, len(words))
                kept = not failed and not far
                rows.append((len(words), chars, symbols, dup_lines, repeat, failed, by_class, by_word, kept))
            kinds = (*(pa.int64(),) * 5, pa.bool_(), pa.float64(), pa.float64(), pa.bool_())
            new = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 9, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names.values()])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[n], k) for n, k in ADDED)])
    return docs.mapInArrow(run, schema), names
