"""Benchmark decontamination by templates.

Numbers, names and units of measure become typed placeholders; what stood there are the slots. Names
are told by capital letters inside sentences and lines, so a second form, in which they are plain
lower-case words, stands beside the first, for copies in another letter case. A window of eight words
that in either form is also a window of a benchmark item is a hit, found by a hash join; windows of
items of under 24 words are shorter, so that one changed word does not break them all. Hits of one item along one diagonal (place in the text less place in the item) are one
occurrence, and it counts if its slots agree: wherever the item repeats a value, the text must
repeat its own. So a question with other names and numbers is caught, and a chance run of common
words around unrelated numbers is not.

A fixed-size bitmap of the benchmark's hashes goes to the workers, which drop windows that cannot
match; a benchmark of any size only fills it more. No text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrel.llm.batches import if_small, released, slices, text_key, texts, written

WINDOW = 8
SHORT_WINDOW = 5
LEAST_WORDS = 4
COVERAGE = 0.5
PASSAGE_WORDS = 13
AGREEMENT = 0.8
BITMAP_BITS = 24
WORDS_KEPT = 200_000
#: Texts whose words are looked up side by side.
TEXT_ROWS = 256

# Written units of measure and of money.
UNITS = frozenset(
    "% percent mm cm m km in inch inches ft feet foot yard yards mile miles mg g kg t ton tons tonne "
    "tonnes oz ounce ounces lb lbs pound pounds ml cl l liter liters litre litres gallon gallons s sec "
    "second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "k c f kelvin celsius fahrenheit degree degrees v volt volts w watt watts kw kwh j joule joules n "
    "newton newtons pa bar hz khz mhz ghz bit bits byte bytes kb mb gb tb dollar dollars euro euros "
    "cent cents usd eur gbp € $ £ meter meters metre metres kilometer kilometers kilometre kilometres "
    "kilogram kilograms gram grams stunden stunde tage tag jahre jahr meilen heures heure jours jour "
    "ans an horas hora días día años año".split()
)

_NUMBER = re.compile(r"[+-]?[0-9]+(?:[.,:/][0-9]+)*%?")
_EDGES = ".,;:!?\"'()[]{}«»“”‘’„…*_|#"
_ENDS = (".", "!", "?", ":", "…")

LITERAL, NUMBER, UNIT, NAME = range(4)
_SLOT = {NUMBER: "<number>", UNIT: "<unit>", NAME: "<name>"}
_SLOT_HASH = np.array([0] + [xxhash.xxh64_intdigest(_SLOT[k]) for k in (NUMBER, UNIT, NAME)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words seen so far, each with its plain form, hash, possible type and sentence end."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.plain: list[str] = []
        self.hashes, self.kinds, self.ends = [], [], []

    def number_of(self, word: str) -> int:
        plain = word.strip(_EDGES)
        kind = LITERAL
        if _NUMBER.fullmatch(plain):
            kind = NUMBER
        elif plain.lower() in UNITS:
            kind = UNIT
        elif plain[:1].isupper():
            kind = NAME
        self.known[word] = number = len(self.plain)
        self.plain.append(plain.lower())
        self.hashes.append(xxhash.xxh64_intdigest(plain.lower()))
        self.kinds.append(kind)
        self.ends.append(word.endswith(_ENDS))
        return number


_LINE = "\x00"


def templates(texts_in: list[str], words: Words):
    """Words, each text's first one, and of both forms slot types and template hashes of all words."""
    known, number_of, numbers, firsts = words.known, words.number_of, [], [0]
    line = known[_LINE] if _LINE in known else number_of(_LINE)
    for text in texts_in:
        own = text.replace(_LINE, " ").replace("\n", f" {_LINE} ").split()
        numbers.extend([known[w] if w in known else number_of(w) for w in own])
        firsts.append(len(numbers))
    numbers = np.array(numbers, np.int64)
    firsts = np.array(firsts, np.int64)
    # a line break begins a sentence, and is no word
    of_line = numbers == line
    ends = np.array(words.ends, bool)[numbers] | of_line
    begins = np.r_[True, ends[:-1]][: len(numbers)]
    begins[firsts[:-1][firsts[:-1] < len(numbers)]] = True
    firsts = np.r_[0, np.cumsum(~of_line)][firsts]
    numbers, begins = numbers[~of_line], begins[~of_line]
    kinds = np.array(words.kinds, np.int8)[numbers]
    after_number = np.r_[False, kinds[:-1] == NUMBER][: len(numbers)] & ~begins
    kinds[(kinds == NAME) & begins] = LITERAL
    kinds[(kinds == UNIT) & ~after_number] = LITERAL
    plain = np.array(words.hashes, np.uint64)[numbers]
    folded = np.where(kinds == NAME, LITERAL, kinds).astype(np.int8)
    forms = [(k, np.where(k == LITERAL, plain, _SLOT_HASH[k])) for k in (kinds, folded)]
    return numbers, firsts, forms


def window_of(words: int, window: int) -> int:
    """The window of an item of so many words: all of a very short one, a third of a short one."""
    return words if words <= window else max(min(SHORT_WINDOW, window), min(window, words // 3))


def window_hashes(template: np.ndarray, length: int) -> np.ndarray:
    n = max(0, len(template) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = (out ^ template[k : k + n]) * _STEP
        out ^= out >> np.uint64(29)
    return out


def _slots(words: Words, numbers: np.ndarray, kinds: np.ndarray, start: int, length: int) -> list[str]:
    window = range(start, start + length)
    return [f"{_SLOT[int(kinds[i])]}{words.plain[numbers[i]]}" for i in window if kinds[i] != LITERAL]


def longest_run(places: Column) -> Column:
    """The most consecutive numbers among distinct ones."""
    start = F.struct(F.lit(-2).cast("long").alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, place: Column) -> Column:
        now = F.when(place == acc["last"] + 1, acc["now"] + 1).otherwise(1)
        return F.struct(place.alias("last"), now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.array_sort(places), start, step, lambda acc: acc["most"])


_HIT = pa.list_(pa.string())


def _item_windows(window: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, rows = Words(), []
            numbers, firsts, forms = templates(batch["text"].to_pylist(), words)
            for item, start, end in zip(batch["doc_id"].to_pylist(), firsts.tolist(), firsts.tolist()[1:]):
                length = window_of(end - start, window)
                if length < least_words:
                    continue
                met = set()
                for kinds, template in forms:
                    hashes = window_hashes(template[start:end], length)
                    for place, value in enumerate(hashes.view(np.int64).tolist()):
                        at = start + place
                        plain = np.count_nonzero(kinds[at : at + length] == LITERAL)
                        # without names in it a window is the same in both forms
                        if plain >= least_words and (place, value) not in met:
                            met.add((place, value))
                            rows.append((item, place, length, value, _slots(words, numbers, kinds, at, length)))
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), _HIT)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["item_id", "place", "length", "window", "item_slots"],
            )

    return run


def _text_windows(lengths: list[int], bitmap: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, words = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").view(bool), Words()
        mask = np.uint64((1 << BITMAP_BITS) - 1)
        for batch in slices(batches, TEXT_ROWS):
            if len(words.plain) > WORDS_KEPT:
                words = Words()
            content = batch["text"].to_pylist()
            numbers, firsts, forms = templates(content, words)
            ids, rows, text_keys = batch["doc_id"].to_pylist(), [], {}
            for length in lengths:
                first = None
                for kinds, template in forms:
                    hashes = window_hashes(template, length)
                    hits = np.flatnonzero(present[hashes & mask])
                    if first is not None:
                        hits = hits[hashes[hits] != first[hits]]
                    first = hashes
                    of = np.searchsorted(firsts, hits, "right") - 1
                    inside = hits + length <= firsts[of + 1]
                    for at, d in zip(hits[inside].tolist(), of[inside].tolist()):
                        if d not in text_keys:
                            text_keys[d] = text_key(content[d])
                        value = int(hashes[at : at + 1].view(np.int64)[0])
                        slots = _slots(words, numbers, kinds, at, length)
                        rows.append((ids[d], text_keys[d], at - int(firsts[d]), length, value, slots))
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), _HIT)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "text_key", "at", "length", "window", "slots"],
            )

    return run


def benchmark_bitmap(items: DataFrame) -> bytes:
    """One bit per low ``BITMAP_BITS`` bits of a hash that occurs: 2 MB whatever the benchmark."""
    low = F.col("window").bitwiseAND((1 << BITMAP_BITS) - 1)
    bits = F.bit_or(F.expr("shiftleft(1, cast(window & 7 AS int))"))
    rows = items.groupBy(F.shiftright(low, 3).alias("byte")).agg(bits.alias("bits"))
    bitmap = bytearray(1 << (BITMAP_BITS - 3))
    for row in rows.toLocalIterator():
        bitmap[row.byte] = row.bits
    return bytes(bitmap)


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    coverage: float = COVERAGE,
    agreement: float = AGREEMENT,
    passage: int = PASSAGE_WORDS,
) -> DataFrame:
    """``doc_id, text_key, item_id, n_windows, n_item_windows, n_slots, n_changed``.

    One row per text (id and hash of the text) and benchmark item of which it holds at least
    ``coverage`` of the windows, or ``passage`` words in a row, in occurrences whose slots agree: of their distinct (type, item
    value, text value) at least ``agreement`` are the only one for their (type, item value).
    ``n_changed`` counts slots with another value than the item's. Items of up to ``window``
    words are one window, those of up to three windows have windows of a third of their words, five
    at least; items and windows of fewer than four plain words in both forms are not looked for. Null
    and empty texts have no windows. Rows with equal id and text are one; null ids stay apart by
    their text. Other columns of either table are left behind.
    """
    items = written(
        texts(benchmark, item_column, item_text_column)
        .withColumn("doc_id", F.col("doc_id").cast("long"))
        .mapInArrow(
            _item_windows(window, LEAST_WORDS),
            "item_id long, place long, length int, window long, item_slots array<string>",
        ),
        "benchmark-windows",
    )
    # at most ``window`` different ones
    lengths = sorted(r.length for r in items.select("length").distinct().collect())
    hits = texts(df, id_column, text_column).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        released(_text_windows(lengths, benchmark_bitmap(items))),
        "doc_id long, text_key long, at long, length int, window long, slots array<string>",
    )
    size = items.agg(
        F.coalesce(F.sum(64 + F.length(F.array_join("item_slots", ","))), F.lit(0)).alias("bytes")
    ).first()
    matched = hits.join(if_small(items, size.bytes), ["window", "length"])
    diagonals = (
        matched.where(F.size("slots") == F.size("item_slots"))
        .groupBy("doc_id", "text_key", "item_id", "length", (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(
            F.collect_set("place").alias("places"),
            F.array_distinct(
                F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("t"))))
            ).alias("pairs"),
        )
    )
    n_pairs, n_values = F.size("pairs"), F.size(F.array_distinct(F.col("pairs.i")))
    agreeing = diagonals.where(n_values >= agreement * n_pairs)
    found = agreeing.groupBy("doc_id", "text_key", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_windows"),
        F.max(longest_run(F.col("places")) + F.col("length") - 1).alias("in_a_row"),
        F.max(n_pairs).cast("long").alias("n_slots"),
        F.max(F.size(F.filter("pairs", lambda p: p["i"] != p["t"]))).cast("long").alias("n_changed"),
    )
    whole = items.groupBy(F.col("item_id").alias("whole_id")).agg(F.count_distinct("place").alias("n_item_windows"))
    named = found.join(if_small(whole, size.bytes), F.col("item_id").eqNullSafe(F.col("whole_id")))
    covered = F.col("n_windows") >= coverage * F.col("n_item_windows")
    return named.where(covered | (F.col("in_a_row") >= passage)).select(
        "doc_id", "text_key", "item_id", "n_windows", "n_item_windows", "n_slots", "n_changed"
    )
