"""Flat turn rows to conversation arrays, in parts of bounded length."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrel.functions.chat import as_turns

PART_TURNS = 256
FAN_IN = 64
BROADCAST_BYTES = 32 << 20


def assemble(
    turns: DataFrame,
    shape: str | None = "sharegpt",
    key: str = "conv_id",
    turn: str = "turn",
    part_turns: int = PART_TURNS,
    element: Column | None = None,
) -> DataFrame:
    """Rows ``(key, part, start, conversations)`` from one row per turn.

    A conversation of up to ``part_turns`` turns becomes one row, part 0. A longer one
    becomes several, cut by turn position, so that no task ever gathers more than
    ``part_turns`` turns, however long a single conversation is. Positions count from 0
    without gaps and ``(key, turn)`` identifies a row; ``start`` is the position of a part's first
    turn. What is made of the rows later does not depend on ``part_turns``. ``element`` replaces the turn built from
    ``role`` and ``text``.
    """
    if not 0 < part_turns <= PART_TURNS:
        raise ValueError(f"part_turns must be between 1 and {PART_TURNS}, not {part_turns}")
    if element is None:
        element = as_turns(shape, F.col("role"), F.col("text"))
    # parts never cross a multiple of PART_TURNS, where the rows made of them later are cut
    per_block = -(-PART_TURNS // part_turns)
    block, place = F.floor(F.col(turn) / PART_TURNS), F.pmod(F.col(turn), F.lit(PART_TURNS))
    start = F.floor(F.col("part") / per_block) * PART_TURNS + F.pmod("part", F.lit(per_block)) * part_turns
    return (
        turns.select(
            key,
            (block * per_block + F.floor(place / part_turns)).alias("part"),
            F.struct(F.col(turn).alias("turn"), element.alias("element")).alias("placed"),
        )
        .groupBy(key, "part")
        .agg(F.array_sort(F.collect_list("placed")).alias("placed"))
        .select(
            key,
            "part",
            start.alias("start"),
            F.col("placed.element").alias("conversations"),
        )
    )


def split_arrays(rows: DataFrame, column: str = "conversations") -> DataFrame:
    """Array rows with ``part`` and ``start``: long arrays cut as ``assemble`` cuts conversations."""
    last = F.greatest(F.floor((F.size(column) - 1) / PART_TURNS), F.lit(0))
    numbers = F.when(F.col(column).isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), last)
    )
    cut = F.slice(column, (F.col("part") * PART_TURNS + 1).cast("int"), PART_TURNS)
    return (
        rows.withColumn("part", F.explode(numbers))
        .withColumn("start", F.col("part") * PART_TURNS)
        .withColumn(column, cut)
    )


def join_parts(parts: DataFrame, key: str, **glue: Callable[[Column], Column]) -> DataFrame:
    """``(key, part, ...)`` with one row per ``PART_TURNS`` turns, from parts of any size.

    For each named column ``glue`` makes one value of the array of its values in order. No more
    than ``PART_TURNS`` turns are gathered.
    """
    block = F.floor(F.col("start") / PART_TURNS)
    pieces = F.array_sort(F.collect_list(F.struct("start", *glue)))
    joined = [function(F.col("_pieces")[name]).alias(name) for name, function in glue.items()]
    return (
        parts.groupBy(key, block.alias("part")).agg(pieces.alias("_pieces")).select(key, "part", *joined)
    )


def long_conversations(parts: DataFrame, key: str = "conv_id") -> tuple[DataFrame, int]:
    """``(key, last)`` of the conversations of several parts, and their number.

    Found from the narrow columns, and marked for broadcast if it is small in bytes.
    """
    found = parts.filter(F.col("part") > 0).groupBy(key).agg(F.max("part").alias("last"))
    bytes_of = F.sum(24 + F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)))
    n, size = found.agg(F.count(F.lit(1)), F.coalesce(bytes_of, F.lit(0))).first()
    return (F.broadcast(found) if size <= BROADCAST_BYTES else found), n


def mark_last_part(parts: DataFrame, key: str = "conv_id") -> DataFrame:
    """Adds ``closes``: whether the part is the last of its conversation."""
    found, n = long_conversations(parts, key)
    if n == 0:
        return parts.withColumn("closes", F.lit(True))
    last = F.coalesce("last", F.lit(0))
    return parts.join(found, key, "left").withColumn("closes", F.col("part") == last).drop("last")


def truncate_parts(
    parts: DataFrame,
    ids: str,
    max_length: int,
    key: str = "conv_id",
    facts: Sequence[Column] = (),
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per conversation with the first ``max_length`` ids over all its parts.

    Cutting a concatenation of cut pieces gives the same as cutting the whole, so pieces are
    joined ``fan_in`` at a time, level by level. No task gathers more than ``fan_in`` pieces
    of ``max_length`` ids of one conversation, however many parts it has. ``facts`` are
    further aggregates that may be taken in steps, named like their columns.
    """
    cut = F.slice(ids, 1, max_length).alias(ids)
    level = parts.select(*[c for c in parts.columns if c != ids], cut)
    last = parts.agg(F.max("part")).first()[0] or 0
    pieces = F.array_sort(F.collect_list(F.struct("part", ids)))
    while True:
        level = level.groupBy(key, F.floor(F.col("part") / fan_in).alias("part")).agg(
            F.slice(F.flatten(pieces[ids]), 1, max_length).alias(ids), *facts
        )
        last //= fan_in
        if last == 0:
            return level.drop("part")
