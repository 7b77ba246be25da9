"""Benchmark decontamination by template canonicalisation.

Words lose the punctuation around them and become tokens: numbers, capitalised words (names) and units after a
number become typed placeholders, all else its lower-case form. A question whose numbers or names were replaced
so keeps its template. Windows of ``WINDOW`` tokens are hashed; a window with too few literal tokens to mean
anything is hashed by its literal words instead. Every window is also looked up by its lower-case words, so that
copies in another letter case are found. An item with fewer tokens is one window of its own length. Document windows meet benchmark windows in a hash join; hits on
one alignment of a document with an item are put together. Windows that are the item's word for word count; the slots
of windows with other values must agree: a value of the item stands for its most frequent value in the document, and
the other way round. An item is reported where at least ``SHARE``
of its tokens are covered.

All windows of all documents are looked up, but only those that a bit filter lets pass are shuffled. The filter has
2^26 bits whatever the size of the benchmark (a larger benchmark only lets more pass), and so can be broadcast.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.tables import column_bytes, free_name, small_batches
from vecatlas.session import materialize

WINDOW = 8
MIN_LITERAL = 4
SHARE = 0.5
ENOUGH = 25
FILTER_BITS = 26

LITERAL, NAME, NUMBER, UNIT = 0, 1, 2, 3
# Units of measure and currency that may follow a number.
UNITS = frozenset("""
    mm cm m km in inch inches ft feet yd yards mi mile miles mg g kg t lb lbs oz ton tons ml l litre litres liter liters
    s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years
    k c f v w kw mw j kj cal kcal hz khz mhz ghz b kb mb gb tb mph kmh percent % dollar dollars euro euros cent cents pound pounds
""".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
_EDGE = re.compile(r"^[^\w$€£%+-]+|[^\w%]+$")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
HITS = "doc_id long, doc_row long, pos int, hash long, words array<string>"


# The ASCII characters that _EDGE takes off the front and the end.
_FRONT, _BACK = (bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c) in kept)) for kept in ("_$%+-", "_%"))
_UNIT_BYTES = frozenset(u.encode() for u in UNITS)


def _marked(lower: bytes, kind: int) -> int:
    return (xxhash.xxh64_intdigest(lower) | 15) - 7 + kind + 4 * (lower in _UNIT_BYTES)


def token(word: bytes) -> int:
    """A hash of the lower-case word, with its kind in the two low bits and whether it is a unit in the third; 0 for
    a word of punctuation only."""
    if word.isascii():
        core = word.lstrip(_FRONT).rstrip(_BACK)
        if core.isalpha():  # most words: letters alone are no number
            return _marked(core.lower(), NAME if core.istitle() else LITERAL)
        text = core.decode()
    else:
        text = word.decode(errors="replace")
        if text.isalpha() and text.islower():
            return _marked(word, LITERAL)
        text = _EDGE.sub("", text)
    if not text:
        return 0
    lower = text.lower()
    if _NUMBER.fullmatch(text):
        kind = NUMBER
    elif text[0].isupper() and text[1:] == lower[1:]:
        kind = NAME
    else:
        kind = LITERAL
    return _marked(lower.encode(), kind)


class Tokens(dict):
    """Remembers the tokens of the last words seen: two generations, so that frequent words stay."""

    older: dict = {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            found = token(word)
        self[word] = found
        return found


def canonical(words: list[bytes], known: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Literal hashes and kinds of a text's tokens, and which words they are."""
    found = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    at = np.flatnonzero(found)
    found = found[at]
    kinds = (found & np.uint64(3)).astype(np.int8)
    unit = np.flatnonzero(found & np.uint64(4))
    if len(unit):
        unit = unit[unit > 0]
        kinds[unit[kinds[unit - 1] == NUMBER]] = UNIT
    return found | np.uint64(7), kinds, at


def window_hashes(literal: np.ndarray, kinds: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes per window of ``size`` tokens: of the template (of the words where too few are literal), and of the
    lower-case words, which are the same in any letter case."""
    n = len(literal) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_literal = kinds == LITERAL
    slots = np.where(is_literal, literal, (kinds.astype(np.uint64) + np.uint64(2)) * _PRIME)
    plain = np.concatenate([[0], np.cumsum(is_literal)])
    enough = plain[size:] - plain[:-size] >= MIN_LITERAL

    plainly = ~_rolled(literal, size)
    return _mixed(np.where(enough, _rolled(slots, size), plainly)), _mixed(plainly)


def _rolled(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all windows, by doubling; the windows of other sizes than powers of two are put together."""
    n, whole, at = len(values) - size + 1, None, 0
    width, power = 1, int(_PRIME)
    while width <= size:
        if size & width:
            part = values[at : at + n]
            whole = part if whole is None else whole * np.uint64(power) + part
            at += width
        if 2 * width <= size:
            values = values[:-width] * np.uint64(power) + values[width:]
        width, power = 2 * width, power * power % (1 << 64)
    return whole


def _mixed(x: np.ndarray) -> np.ndarray:
    return ((x ^ (x >> np.uint64(31))) * _PRIME).view(np.int64)


def short_hashes(literal: np.ndarray, size: int) -> np.ndarray:
    """A hash of the lower-case words of each window of ``size`` tokens, fewer than WINDOW."""
    if len(literal) < size:
        return np.zeros(0, np.int64)
    return _mixed(_rolled(literal, size) ^ np.uint64(size))


def _spot(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.uint64) >> np.uint64(64 - FILTER_BITS)


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, n_tokens, pos, hash, words) for the windows of all items."""
    def run(batches):
        known = Tokens()
        for batch in batches:
            rows = []
            for item, whole in zip(batch.column(0).to_pylist(), column_bytes(batch.column(1))):
                words = whole.split()
                literal, kinds, at = canonical(words, known)
                windows = zip(*(h.tolist() for h in window_hashes(literal, kinds)))
                if 0 < len(literal) < WINDOW:
                    windows = zip(short_hashes(literal, len(literal)).tolist())
                for pos, found in enumerate(windows):
                    for h in set(found):
                        rows.append((item, len(literal), pos, h, [words[i].decode(errors="replace") for i in at[pos : pos + WINDOW]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 5, (
                    pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))],
                names=["item_id", "n_tokens", "item_pos", "hash", "item_words"])

    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, n_tokens int, item_pos int, hash long, item_words array<string>")


def _filter(windows: DataFrame) -> bytes:
    """The bit filter of the windows' hashes: made of equal slices, whose number and size are fixed."""
    slices, per = 64, (1 << FILTER_BITS) // 64

    def pack(key, table):
        bits = np.zeros(per, np.uint8)
        bits[table.column("spot").to_numpy()] = 1
        return pa.Table.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": [np.packbits(bits).tobytes()]})

    spot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    spots = windows.select((spot / F.lit(per)).cast("int").alias("slice"), F.pmod(spot, F.lit(per)).cast("int").alias("spot")).distinct()
    made = spots.groupBy("slice").applyInArrow(pack, "slice int, bits binary").collect()
    out = {r["slice"]: bytes(r["bits"]) for r in made}
    return b"".join(out.get(k, bytes(per // 8)) for k in range(slices))


def _hits(docs: DataFrame, shared, short: list[int], doc_id: str, text: str) -> DataFrame:
    """Windows of the documents that pass the filter, of WINDOW tokens and of the lengths of shorter items."""
    def run(batches):
        bits, known = np.frombuffer(shared.value, np.uint8), Tokens()
        for batch in batches:
            out = {name: [] for name in ("doc_id", "doc_row", "pos", "hash", "words")}
            for doc, row, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column_bytes(batch.column(2))):
                words = whole.split()
                literal, kinds, at = canonical(words, known)
                template, plain = window_hashes(literal, kinds)
                for hashes, asked, size in ((template, True, WINDOW), (plain, plain != template, WINDOW),
                                            *((short_hashes(literal, size), True, size) for size in short)):
                    spots = _spot(hashes)
                    passed = bits[spots >> np.uint64(3)] >> (np.uint64(7) - (spots & np.uint64(7))).astype(np.uint8) & 1
                    for pos in np.flatnonzero((passed > 0) & asked).tolist():
                        for name, value in zip(out, (doc, row, pos, int(hashes[pos]), [words[i].decode(errors="replace") for i in at[pos : pos + size]])):
                            out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out.values(), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string())))],
                names=list(out))

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, HITS)


def _plain(word: str) -> str:
    return _EDGE.sub("", word).lower()


def judged(n_tokens: int, windows: list[dict], share: float, enough: int) -> tuple[list[int], int]:
    """The item's token positions that an alignment's windows cover, and how many of its words are changed there.

    Where an item's value stands for no value of the document in at least half of its places, its names and numbers
    contradict each other: then only passages word for word that are long enough by themselves count.
    """
    slots = {w["item_pos"]: [(_plain(i), _plain(d)) for i, d in zip(w["item_words"], w["words"])] for w in windows}
    own, other = defaultdict(Counter), defaultdict(Counter)
    for i, d in {pos + k: pair for pos, pairs in slots.items() for k, pair in enumerate(pairs)}.values():
        own[i][d] += 1
        other[d][i] += 1
    same = {pos for pos, pairs in slots.items() if all(i == d for i, d in pairs)}
    tokens = lambda at: sorted({pos + k for pos in at for k in range(len(slots[pos]))})
    if any(2 * max(c.values()) < sum(c.values()) for c in own.values()):
        runs = []
        for x in tokens(same):
            if runs and runs[-1][-1] == x - 1:
                runs[-1].append(x)
            else:
                runs.append([x])
        return [x for r in runs if len(r) >= share * n_tokens or len(r) >= enough for x in r], 0
    # Of equally frequent values the unchanged one counts.
    first = lambda table: {v: max(c, key=lambda x: (c[x], x == v, x)) for v, c in table.items()}
    ahead, back = first(own), first(other)
    good = same | {pos for pos, pairs in slots.items() if all(ahead[i] == d and back[d] == i for i, d in pairs)}
    return tokens(good), len({pair for pos in good for pair in slots[pos] if pair[0] != pair[1]})


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, enough: int = ENOUGH, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, doc_row, item_id, n_tokens, n_covered, n_changed): the items that each document holds.

    ``n_covered`` of the item's ``n_tokens`` tokens stand in the document; ``n_changed`` of the item's distinct words
    are other values there, in consistent slots. Items under WINDOW tokens are one window of their own length and
    must stand in the document word for word, in any letter case; null and empty texts hold nothing. Equal rows give one result; ``doc_row`` (a hash of the text) tells
    different rows with one id apart.
    """
    windows = materialize(_items(benchmark, item_id, item_text), "items")
    shared = docs.sparkSession.sparkContext.broadcast(_filter(windows))  # 8 MB, always
    short = sorted(r["n_tokens"] for r in windows.where(F.col("n_tokens") < WINDOW).select("n_tokens").distinct().collect())
    hits = _hits(docs, shared, short, doc_id, text).join(windows, "hash")
    hits = hits.where(F.size("words") == F.size("item_words"))
    side = ["doc_id", "doc_row", "item_id", "n_tokens"]
    hits = hits.select(*side, (F.col("pos") - F.col("item_pos")).alias("shift"), F.struct("item_pos", "item_words", "words").alias("window"))
    # An alignment has at most as many windows as its item, so its lists are bounded by the item.
    aligned = hits.groupBy(*side, "shift").agg(F.collect_set("window").alias("windows"))

    def run(batches):
        for batch in batches:
            found = [judged(n, w, share, enough) for n, w in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.int32())],
                names=[*side, "at", "changed"])

    agreed = aligned.select(*side, "windows").mapInArrow(
        run, "doc_id long, doc_row long, item_id long, n_tokens int, at array<int>, changed int").where(F.size("at") > 0)
    found = agreed.groupBy(*side).agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min("changed").cast("long").alias("n_changed"))
    covered = F.size("at")
    found = found.withColumn("n_covered", covered.cast("long")).withColumn("n_tokens", F.col("n_tokens").cast("long"))
    return found.where((F.col("n_covered") >= share * F.col("n_tokens")) | (F.col("n_covered") >= enough)).select(
        "doc_id", "doc_row", "item_id", "n_tokens", "n_covered", "n_changed")


def without_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that hold no item of the benchmark.

    Hits carry the id and a hash of the text; the rows' own ids and texts are compared with them in an anti join,
    which Spark broadcasts while the hits are few. Rows with equal id and text are judged alike, also without an id.
    """
    own_id, own_row = free_name("hit_doc", docs.columns), free_name("hit_row", docs.columns)
    hits = contaminated(docs, benchmark, doc_id=doc_id, text=text).select(F.col("doc_id").alias(own_id), F.col("doc_row").alias(own_row))
    found = materialize(hits.distinct(), "contaminated")
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_row))
    return docs.join(found, same, "left_anti")
