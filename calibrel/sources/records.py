"""Concatenated JSON objects of any layout, cut where a scanner says that one ends.

Spark cuts files behind every closing brace, whatever lines there are, and gives the pieces of a
split in their order. Whether a brace ends an object depends on what stands before it: the depth of
braces and whether it is inside a string. That is the state of a small scanner, so a split is a
transfer function of states. Splits that do not begin a file are read once for their functions,
which are composed in the order of the file; then every split is cut with the state it begins in,
and what an object has in several splits is put together.

A line break ends a string, and a brace that begins a line begins an object unless a value is
due, so a broken object costs itself and not the rest of its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrel.session import checkpointed

#: Splits whose first states are sent along at once.
SPLITS_AT_ONCE = 100_000
_MARK = re.compile(r'["{]')
_STRING_END = re.compile(r'\\.|["\n]', re.S)
_BLANK = " \t\r\n"


@dataclass
class Effect:
    """What a piece does: whether it ends in a string, braces opened, and where objects begin anew."""

    in_string: bool
    opened: int
    begins: list[int]
    # braces opened before the first of ``begins``, and from the last of them on
    before: int
    since: int


def effect_of(piece: str, in_string: bool) -> Effect:
    if "\\" not in piece:
        parts = piece.split('"')
        inside = parts[not in_string :: 2]
        if not any("\n" in p for p in inside):
            outside = parts[in_string::2]
            opened = sum(p.count("{") for p in outside)
            ends_inside = bool(len(parts) % 2 == 0) != in_string
            lead = piece.find("{") if opened and not in_string else -1
            # the usual piece: one object whose brace is the first thing in it
            if opened == 1 and lead >= 0 and not piece[:lead].strip(_BLANK):
                return Effect(ends_inside, 1, [lead] if piece[lead - 1 : lead] == "\n" else [], 0, 1)
            if not any("\n{" in p for p in outside):
                return Effect(ends_inside, opened, [], 0, 0)
    opened, begins, first, since, at = 0, [], 0, 0, 0
    while True:
        if in_string:
            end = _STRING_END.search(piece, at)
            if end is None:
                return Effect(True, opened, begins, first, since)
            in_string, at = len(end[0]) == 2, end.end()
            continue
        mark = _MARK.search(piece, at)
        if mark is None:
            return Effect(False, opened, begins, first, since)
        at = mark.end()
        if mark[0] == '"':
            in_string = True
        elif mark[0] == "{":
            begin = mark.start()
            # no object begins where a value is due
            if piece[begin - 1 : begin] == "\n" and piece[:begin].rstrip(_BLANK)[-1:] not in (":", "[", ","):
                first = opened if not begins else first
                begins.append(begin)
                since = 0
            opened += 1
            since += 1


@dataclass
class Transfer:
    """Depth ``d`` at the start becomes ``max(d + more, least)``; an object ends for ``d`` up to ``most``."""

    in_string: bool
    more: float = 0
    least: float = 0
    most: float = -1
    # the depth before the first brace that begins an object whatever the depth, and whether there is one
    begun: bool = False
    begun_more: float = 0
    begun_least: float = 0

    def take(self, effect: Effect, closed: bool) -> None:
        if effect.begins:
            more, least = self.more + effect.before, self.least + effect.before
            if len(effect.begins) > 1 or (self.begun and least > 0):
                self.most = float("inf")
            if not self.begun:
                self.begun, self.begun_more, self.begun_least = True, more, least
            self.more, self.least = float("-inf"), effect.since
        else:
            self.more, self.least = self.more + effect.opened, self.least + effect.opened
        self.in_string = effect.in_string
        if closed and not self.in_string:
            # the brace takes depth 1, or less, to 0
            if self.least <= 1:
                self.most = max(self.most, 1 - self.more)
            self.more, self.least = self.more - 1, max(self.least - 1, 0)


class Cutter:
    """Cuts the pieces of one split, in order, into whole objects and what lacks a beginning or an end."""

    def __init__(self, in_string: bool, depth: int):
        self.in_string, self.depth, self.held = in_string, depth, []
        self.ended = False

    def take(self, piece: str, closed: bool) -> Iterator[tuple[str, bool]]:
        """(text, whether it was open when the split began)."""
        effect = effect_of(piece, self.in_string)
        at = 0
        for k, begin in enumerate(effect.begins):
            if k or self.depth + effect.before > 0:
                self.held.append(piece[at:begin])
                at = begin
                yield self._flush()
        self.depth = effect.since if effect.begins else self.depth + effect.opened
        self.in_string = effect.in_string
        self.held.append(piece[at:] + "}" * closed)
        if closed and not self.in_string:
            self.depth = max(self.depth - 1, 0)
            if self.depth == 0:
                yield self._flush()

    def _flush(self) -> tuple[str, bool]:
        text, first = "".join(self.held), not self.ended
        self.held, self.ended = [], True
        return text, first

    def rest(self) -> str:
        return "".join(self.held)


#: Blanks before the brace of a usual piece.
LEAD = 8


def _usual(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which pieces are one object whose brace is the first thing in it, and which of these begin it on a line.

    Their strings are closed and hold no line break, so outside of a string each leaves the depth as it was.
    """
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    first, starts = offsets[0], offsets[:-1] - offsets[0]
    ends = offsets[1:] - first
    if not ends[-1]:
        return np.zeros(len(values), bool), np.zeros(len(values), bool)
    data = np.frombuffer(values.buffers()[2], np.uint8)[first : offsets[-1]]

    def before(found: np.ndarray, kind: type = np.int32) -> np.ndarray:
        return np.concatenate((np.zeros(1, kind), np.cumsum(found, dtype=kind)))

    # parity is all that counts of quotes
    quotes = before(data == ord('"'), np.uint8) & 1
    inside = quotes[1:] != np.repeat(quotes[starts], ends - starts)
    bad = before((data == ord("\\")) | (inside & (data == ord("\n"))))
    braces = np.flatnonzero(data == ord("{"))
    upto = np.searchsorted(braces, starts)
    usual = (np.searchsorted(braces, ends) - upto == 1) & (quotes[starts] == quotes[ends]) & (bad[starts] == bad[ends])
    places = np.flatnonzero(usual)
    lead = braces[upto[places]] - starts[places]
    blank = np.zeros(256, bool)
    blank[[ord(c) for c in _BLANK]] = True
    fits = lead <= LEAD
    for k in range(min(LEAD, lead.max(initial=0))):
        fits &= (lead <= k) | blank[data[np.minimum(starts[places] + k, len(data) - 1)]]
    usual[places[~fits]] = False
    on_line = np.zeros(len(values), bool)
    on_line[places] = fits & (lead > 0) & (data[np.maximum(starts[places] + lead - 1, 0)] == ord("\n"))
    return usual, on_line


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, pa.Array, np.ndarray, np.ndarray]]:
    """Pieces of one split at a time: file and split, size of the file, values, and what ``_usual`` says."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch["value"].cast(pa.binary())
        usual, on_line = _usual(values)
        splits = batch["split"].to_numpy()
        files = pc.run_end_encode(batch["file"]).run_ends.to_numpy()
        bounds = np.unique(np.concatenate(([0], np.flatnonzero(np.diff(splits)) + 1, files))).tolist()
        for start, end in zip(bounds, bounds[1:]):
            now = batch["file"][start].as_py(), int(splits[start])
            some = slice(start, end)
            yield now, batch["size"][start].as_py(), values[some], usual[some], on_line[some]


def _usual_until(usual: np.ndarray) -> np.ndarray:
    """For each place the next one that is not usual."""
    odd = np.where(usual, len(usual), np.arange(len(usual)))
    return np.minimum.accumulate(odd[::-1])[::-1]


_LINE, _MIDST = Effect(False, 1, [1], 0, 1), Effect(False, 1, [], 0, 0)


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per split of several: what it makes of both string states, and its bytes."""
    now, found, out = None, [], []

    def row() -> tuple:
        file, split = now
        return (file, split, length, *((t.in_string, *_numbers(t)) for t in found))

    length = 0
    for place, size, values, usual, on_line in _splits(batches):
        if place != now:
            if now is not None:
                out.append(row())
            now, found, length = place, [Transfer(False), Transfer(True)], 0
        length += pc.sum(pc.binary_length(values)).as_py() + len(values)
        until, at = _usual_until(usual), 0
        while at < len(values):
            # the last piece of a file counts as closed here; nothing comes behind it
            if until[at] > at and not (found[0].in_string or found[1].in_string):
                # usual pieces repeat what the first of them does, or the first on a line
                for transfer in found:
                    transfer.take(_LINE if on_line[at : until[at]].any() else _MIDST, True)
                at = until[at]
                continue
            piece = values[at].as_py().decode("utf-8", "replace")
            plain = effect_of(piece, False) if not (found[0].in_string and found[1].in_string) else None
            quoted = effect_of(piece, True) if found[0].in_string or found[1].in_string else None
            for transfer in found:
                transfer.take(quoted if transfer.in_string else plain, True)
            at += 1
    if now is not None:
        out.append(row())
    if out:
        files, splits, lengths, outside, inside = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(files), pa.array(splits, pa.int64()), pa.array(lengths, pa.int64())]
            + [pa.array([[float(x) for x in t] for t in side], pa.list_(pa.float64())) for side in (outside, inside)],
            names=["file", "split", "length", "outside", "inside"],
        )


def _numbers(t: Transfer) -> tuple:
    return t.more, t.least, t.most, t.begun, t.begun_more, t.begun_least


def _composed(splits: DataFrame) -> DataFrame:
    """``file, split, in_string, depth, ends, base``: the state a split begins in, how many splits before it
    end an object, and the bytes before it. A file has as many splits as Spark cut it into."""
    of_file = splits.groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("split", "length", "outside", "inside"))).alias("splits")
    )
    kind = (
        "struct<in_string:boolean,depth:double,ends:bigint,base:bigint,"
        "out:array<struct<split:bigint,in_string:boolean,depth:double,ends:bigint,base:bigint>>>"
    )
    first = F.struct(
        F.lit(False).alias("in_string"), F.lit(0.0).alias("depth"), F.lit(0).cast("long").alias("ends"),
        F.lit(0).cast("long").alias("base"), F.array().alias("out"),
    ).cast(kind)

    def step(state: Column, split: Column) -> Column:
        t = F.when(state["in_string"], split["inside"]).otherwise(split["outside"])
        depth, get = state["depth"], lambda k: F.get(t, k)
        begun = (get(4) > 0) & (F.greatest(depth + get(5), get(6)) > 0)
        ends = (depth <= get(3)) | begun
        own = F.struct(split["split"].alias("split"), state["in_string"], depth.alias("depth"), state["ends"], state["base"])
        return F.struct(
            (get(0) > 0).alias("in_string"),
            F.greatest(depth + get(1), get(2)).alias("depth"),
            (state["ends"] + ends.cast("long")).alias("ends"),
            (state["base"] + split["length"]).alias("base"),
            F.concat(state["out"], F.array(own)).alias("out"),
        ).cast(kind)

    states = F.aggregate("splits", first, step)["out"]
    return of_file.select("file", F.inline(states))


def _objects(states, least: int, whole: bool, shared: bool):
    """Objects that stand in one split, and the pieces of ``shared`` ones: ``ends`` tells which pieces are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter, opened, ends, at, rows = None, None, False, 0, 0, []

        def add(text: str, head: bool) -> None:
            # only what was open before the split has a part elsewhere
            of = ends if head and opened else None
            if whole if of is None else shared:
                rows.append((*now, of, text))

        def rest() -> None:
            if shared and now is not None and cutter.rest().strip(_BLANK):
                rows.append((*now, ends + cutter.ended, cutter.rest()))

        for place, size, values, usual, _ in _splits(batches):
            if place != now:
                rest()
                now = place
                if now[1] and size > least and now not in states.value:
                    raise ValueError(f"{now} is not a split of the first scan")
                in_string, depth, ends, at = states.value.get(now, (False, 0, 0, 0))
                cutter, opened = Cutter(in_string, int(depth)), in_string or depth > 0
            sizes = np.cumsum(pc.binary_length(values).to_numpy() + 1) + at
            until, k = _usual_until(usual & (sizes <= size)), 0
            while k < len(values):
                if until[k] > k and not (cutter.in_string or cutter.depth or cutter.held):
                    if whole:
                        texts = _closed(values[k : until[k]])
                        yield _rows([now] * len(texts), texts)
                    cutter.ended = True
                    k = until[k]
                    continue
                for text, head in cutter.take(values[k].as_py().decode("utf-8", "replace"), bool(sizes[k] <= size)):
                    add(text, head)
                k += 1
            at = int(sizes[-1])
            if len(rows) >= 10_000:
                yield _rows(rows)
                rows = []
        rest()
        if rows:
            yield _rows(rows)

    return run


def _closed(values: pa.Array) -> pa.Array:
    try:
        return pc.binary_join_element_wise(values.cast(pa.string()), "}", "")
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") + "}" for v in values.to_pylist()])


def _rows(rows: list[tuple], texts: pa.Array | None = None) -> pa.RecordBatch:
    """``rows`` of file, split, ends and text; or all of one split, with ``texts``."""
    names = ["file", "split", "ends", "record_text"]
    if texts is not None:
        (file, split), n = rows[0], len(texts)
        arrays = [pa.repeat(pa.scalar(file), n), pa.repeat(pa.scalar(split, pa.int64()), n), pa.nulls(n, pa.int64()), texts]
        return pa.RecordBatch.from_arrays(arrays, names=names)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def _least_split(spark: SparkSession) -> int:
    """Files of no more bytes are never split."""
    sizes = []
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", str(spark.conf.get(name)).lower()).groups()
        sizes.append(int(number) * _UNITS[unit])
    return min(sizes)


def _not_pruned(condition: Column) -> Column:
    """A condition on files under which Spark still lists all of them: how they are split depends on the list."""
    return condition | F.col("value").isNull()


def read_objects(
    spark: SparkSession, path: str, only: Column | None = None, **of_file: Column
) -> DataFrame:
    """``file, record_text``: one row per object in the files of ``path``.

    Objects may hold braces in strings, stand on many lines or all on one, and be of any number in a
    file: no task holds more than its split, and an object that several splits share. Text that is
    no object stands with the object behind it, an unfinished one alone. ``only`` is a condition on
    ``of_file``, columns of the files' metadata; other files are not read.
    """
    meta = F.col("_metadata")
    pieces = (
        spark.read.option("lineSep", "}")
        .option("recursiveFileLookup", "true")
        .text(path)
        .withColumns({**of_file, "file": meta["file_path"], "split": meta["file_block_start"], "size": meta["file_size"]})
    )
    if only is not None:
        pieces = pieces.where(only)
    given = pieces.select("file", "split", "size", F.col("value").cast("binary").alias("value"))
    schema, least = "file string, split long, ends long, record_text string", _least_split(spark)
    states, many, across = None, 0, 0
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if (files.agg(F.max("length")).first()[0] or 0) > least:
        found = given.where(_not_pruned(F.col("size") > least)).mapInArrow(
            _transfers, "file string, split long, length long, outside array<double>, inside array<double>"
        )
        states = checkpointed(_composed(found).where("split > 0"))
        many, across = states.agg(F.count(F.lit(1)), F.count_if(F.expr("in_string OR depth > 0"))).first()
    groups, cut, parts = max(1, -(-many // SPLITS_AT_ONCE)), [], []
    for group in range(groups):
        own = F.pmod(F.xxhash64("file"), F.lit(groups)) == group
        rows = states.where(own).collect() if many else []
        begun = spark.sparkContext.broadcast(
            {(r.file, r.split): (r.in_string, r.depth, r.ends, r.base) for r in rows}
        )
        some = given.where(_not_pruned(own)) if groups > 1 else given
        cut.append(some.mapInArrow(_objects(begun, least, True, not across), schema).select("file", "record_text"))
        # with objects across splits: a split's rest, the splits without an end behind it, the next one's beginning
        parts.append(some.mapInArrow(_objects(begun, least, False, True), schema))
    # objects that stand in one split, as is usual, are cut in one scan and kept nowhere
    objects = reduce(DataFrame.union, cut)
    if across:
        shared_by = (
            reduce(DataFrame.union, parts)
            .groupBy("file", "ends")
            .agg(F.array_sort(F.collect_list(F.struct("split", "record_text"))).alias("parts"))
        )
        joined = F.array_join(F.col("parts")["record_text"], "").alias("record_text")
        objects = objects.union(shared_by.select("file", joined))
    text = F.btrim("record_text", F.lit(_BLANK))
    return objects.select("file", text.alias("record_text")).where("record_text <> ''")
