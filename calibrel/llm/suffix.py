"""Removal of repeated byte strings by bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``least`` bytes around it starts anywhere else too. Every window of that
length has an anchor, the gram of least hash in it (the leftmost of equals), which depends on the
window alone; so equal windows have equal anchors. Neighbouring windows of one anchor make a piece,
and the pieces of a text hold each of its windows once.

1. Each text is read once and gives rows of anchor, place and content hash of its pieces, no bytes.
2. Anchors that occur once are done. Where all pieces of an anchor are equal, all are repeated.
3. Of the others each different piece is fetched once from one of the texts that have it, and the
   pieces of an anchor meet in one transform. Starting from all suffixes, backward extension by one
   byte at a time gives the intervals of longer and longer strings, breadth first, and each sets the
   common-prefix value at its end. It stops at ``least``: rows with no value yet share that much
   with the row before them, which is what is looked for.
4. An anchor with so many different pieces that they would not fit one transform has its windows
   dealt out one by one, by content, and counted.

All steps are exact but for equal 64-bit hashes within the pieces of one anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrel.llm.batches import texts, written

LEAST = 200
GRAM = 32
BLOCK = 1 << 22
TRANSFORM_BYTES = 1 << 20
MOST_FORMS = 2048

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 64, (2, 256), dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, as many as the longest block so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << n.bit_length()
            self.up, self.down = (
                np.multiply.accumulate(np.r_[_U(1), np.full(size - 1, step, np.uint64)])
                for step in (_BASE, pow(_BASE, -1, 1 << 64))
            )
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Running sums of which any substring's hash is a difference."""
    up, _ = _powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[which][data] * up[: len(data)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, starts, ends) -> np.ndarray:
    _, down = _powers.get(len(sums))
    return (sums[ends] - sums[starts]) * down[starts]


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def pieces(data: np.ndarray, least: int, gram: int):
    """Per piece: first window, number of windows, hash of the anchor, hash of the content."""
    sums = _sums(data)
    n = len(data) - gram + 1
    _, down = _powers.get(len(sums))
    grams = _mixed((sums[gram:] - sums[:n]) * down[:n])
    keyed = (grams & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    anchors = (_window_minima(keyed, least - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    counts = np.diff(np.r_[starts, len(anchors)])
    at = anchors[starts]
    content = _hashes(sums, starts, starts + counts + least - 1)
    # The same bytes around another place of the anchor are another piece.
    content = _mixed(content ^ ((counts << 20) + at - starts).astype(np.uint64) * _U(_BASE))
    return starts, counts, grams[at], content


def _scan(least: int, gram: int):
    names = ["doc_id", "text_key", "start", "windows", "anchor", "piece"]

    def rows(ids, keys, texts_in):
        ids, keys = ids.to_pylist(), keys.to_pylist()
        for doc_id, key, text in zip(ids, keys, texts_in.to_pylist()):
            data = np.frombuffer(text.encode(), np.uint8)
            for first in range(0, len(data) - least + 1, BLOCK):
                found = pieces(data[first : first + BLOCK + least - 1], least, gram)
                yield doc_id, key, found[0] + first, *found[1:]

    def batch_of(found) -> pa.RecordBatch:
        ids, keys, *columns = zip(*found)
        sizes = [len(c) for c in columns[0]]
        repeated = np.repeat(np.arange(len(sizes)), sizes)
        arrays = [pa.array(ids, pa.int64()).take(pa.array(repeated)), pa.array(np.array(keys, np.int64)[repeated])]
        arrays += [pa.array(np.concatenate(c).astype(np.int64)) for c in columns[:2]]
        arrays += [pa.array(np.concatenate(c).view(np.int64)) for c in columns[2:]]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for row in rows(batch["doc_id"], batch["text_key"], batch["text"]):
                held.append(row)
                if len(held) >= 512:
                    yield batch_of(held)
                    held = []
            if held:
                yield batch_of(held)

    return run


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by at least their first ``depth`` symbols, by prefix doubling."""
    n = len(symbols)
    width = int(symbols.max() + 2).bit_length()
    known = max(1, 62 // width)
    key = np.zeros(n, np.int64)
    padded = np.r_[symbols.astype(np.int64) + 1, np.zeros(known, np.int64)]
    for k in range(known):
        key = (key << width) | padded[k : k + n]
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        if known >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1) + np.r_[rank[known:] + 1, np.zeros(min(known, n), np.int64)][:n]
        known *= 2


def long_prefix_rows(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Per row of the order whether it shares ``least`` symbols or more with the row before.

    Breadth-first backward extension: an interval of rows that begin with some string becomes, for
    every symbol that stands before them, the interval of that symbol and the string. The row after
    a new interval's end has a common prefix as long as the string, if it has no value yet; only
    intervals that set one are extended further.
    """
    n = len(symbols)
    before = symbols[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    front = np.empty(n, np.int64)
    front[by_symbol] = np.arange(n)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    following, previous = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    valued = np.zeros(n + 1, bool)
    valued[[0, n]] = True
    first, last = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(least):
        sizes = last - first + 1
        rows = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        high = np.sort(front[rows[following[rows] > np.repeat(last, sizes)]])
        low = np.sort(front[rows[previous[rows] < np.repeat(first, sizes)]])
        new = ~valued[high + 1]
        valued[high + 1] = True
        first, last = low[new], high[new]
        if not len(first):
            break
    return ~valued[:n]


def repeated_windows(forms: list[bytes], least: int) -> list[np.ndarray]:
    """Per form whether each of its windows also starts elsewhere in the forms."""
    sizes = np.array([len(f) + 1 for f in forms])
    ends = np.cumsum(sizes) - 1
    symbols = np.empty(int(sizes.sum()), np.int32)
    within = np.ones(len(symbols), bool)
    within[ends] = False
    symbols[within] = np.frombuffer(b"".join(forms), np.uint8).astype(np.int32) + len(forms)
    symbols[ends] = np.arange(len(forms))
    order = suffix_order(symbols, least)
    shared = long_prefix_rows(symbols, order, least)
    repeated = np.zeros(len(symbols), bool)
    repeated[order[shared]] = True
    repeated[order[np.flatnonzero(shared) - 1]] = True
    return [repeated[e - s + 1 : e - least + 1] for e, s in zip(ends, sizes)]


def _ranges(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, marks, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


_SPAN_NAMES = ["doc_id", "text_key", "first", "last"]


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_SPAN_NAMES)


def _transforms(least: int):
    """Whole anchors at a time, as many as fit one transform, to window ranges of lone pieces."""

    def spans(held) -> pa.RecordBatch:
        rows = []
        marks = repeated_windows([h[-1] for h in held], least)
        for (doc_id, key, start, copies, _), marked in zip(held, marks):
            if copies == 1:
                rows.extend((doc_id, key, start + a, start + b) for a, b in _ranges(marked))
        return _span_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("anchor", "doc_id", "text_key", "start", "copies", "bytes")]
            for anchor, *row in zip(*columns):
                if anchor != now and size >= TRANSFORM_BYTES:
                    yield spans(held)
                    held, size = [], 0
                now = anchor
                held.append(row)
                size += len(row[-1])
        if held:
            yield spans(held)

    return run


def _cut(least: int):
    """The bytes of the pieces wanted of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, key, text, wanted in zip(*(batch[c].to_pylist() for c in ("doc_id", "text_key", "text", "wanted"))):
                data = text.encode()
                for w in wanted:
                    end = w["start"] + w["windows"] + least - 1
                    rows.append((w["anchor"], w["hot"], doc_id, key, w["start"], w["copies"], data[w["start"] : end]))
            columns = list(zip(*rows)) or [()] * 7
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["anchor", "hot", "doc_id", "text_key", "start", "copies", "bytes"],
            )

    return run


def _single_windows(least: int):
    """Two hashes of every window of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("doc_id", "text_key", "start", "copies", "bytes")]
            for doc_id, key, start, copies, content in zip(*columns):
                data = np.frombuffer(content, np.uint8)
                at = np.arange(len(data) - least + 1)
                one, two = (_mixed(_hashes(_sums(data, k), at, at + least)).view(np.int64) for k in (0, 1))
                n = len(at)
                arrays = [pa.array([v] * n, pa.int64()) for v in (doc_id, key, copies)]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(at + start), pa.array(one), pa.array(two)],
                    names=["doc_id", "text_key", "copies", "at", "one", "two"],
                )

    return run


def _by_text(rows: DataFrame, column: str, *fields: str) -> DataFrame:
    return rows.groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(
        F.collect_list(F.struct(*fields)).alias(column)
    )


def _same_text() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))


def repeated_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``doc_id, text_key, first, last``: ranges of windows that also start elsewhere.

    ``docs`` has ``doc_id``, ``text`` and ``text_key``, a hash of the text.
    """
    found = written(
        docs.mapInArrow(
            _scan(least, gram),
            "doc_id long, text_key long, start long, windows long, anchor long, piece long",
        ),
        "pieces",
    )
    anchors = (
        found.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("piece").alias("low"), F.max("piece").alias("high"))
        .where("n > 1")
        .select("anchor", (F.col("low") != F.col("high")).alias("mixed"))
    )
    hits = written(found.join(anchors, "anchor"), "repeated-anchors")
    whole = hits.where("NOT mixed")
    mixed = hits.where("mixed")
    place = F.struct("doc_id", "text_key", "start", "windows")
    forms = written(
        mixed.groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("place")),
        "forms",
    )
    crowded = forms.groupBy("anchor").agg((F.count(F.lit(1)) > MOST_FORMS).alias("hot"))
    wanted = forms.join(crowded, "anchor").select("anchor", "copies", "hot", "place.*")
    per_text = _by_text(wanted, "wanted", "anchor", "hot", "start", "windows", "copies")
    fetched = written(
        docs.join(per_text, _same_text())
        .select("doc_id", "text_key", "text", "wanted")
        .mapInArrow(
            _cut(least),
            "anchor long, hot boolean, doc_id long, text_key long, start long, copies long, bytes binary",
        ),
        "piece-bytes",
    )
    names = "doc_id long, text_key long, first long, last long"
    met = (
        fetched.where("NOT hot")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_transforms(least), names)
    )
    singles = fetched.where("hot").mapInArrow(
        _single_windows(least), "doc_id long, text_key long, copies long, at long, one long, two long"
    )
    shared = singles.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    dealt = singles.where("copies = 1").join(shared, ["one", "two"]).select(
        "doc_id", "text_key", F.col("at").alias("first"), (F.col("at") + 1).alias("last")
    )
    ends = ("doc_id", "text_key", F.col("start").alias("first"), (F.col("start") + F.col("windows")).alias("last"))
    several = mixed.join(forms.where("copies > 1").select("anchor", "piece"), ["anchor", "piece"])
    return whole.select(*ends).union(several.select(*ends)).union(met).union(dealt)


def _removed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, ranges in zip(batch["text"].to_pylist(), batch["ranges"].to_pylist()):
                data = text.encode()
                spans: list[list[int]] = []
                for r in sorted(ranges or (), key=lambda r: r["first"]):
                    first, end = r["first"], r["last"] + least - 1
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([first, end])
                edges = [0, *(x for span in spans for x in span), len(data)]
                sizes.append(len(data))
                removed.append([{"start": s, "end": e} for s, e in spans])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "removed", "kept"],
            )

    return run


def remove_repeats(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, gram: int = GRAM
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, removed, kept``.

    ``removed`` holds the maximal removed runs as (start, end) in bytes of UTF-8, ``kept`` the other
    bytes, which may cut a character. Strings are judged on the input, not on what is left, so all
    their places are removed. Null and empty texts, and those shorter than ``least`` bytes, lose
    nothing. Repeated rows are texts like any other, so they repeat each other; null ids are kept.
    Columns other than id and text are left behind.
    """
    docs = texts(df, id_column, text_column).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"
    )
    spans = written(repeated_spans(docs, least, gram), "spans")
    per_text = _by_text(spans, "ranges", "first", "last")
    joined = docs.join(per_text, _same_text(), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(
        _removed(least), "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    )
