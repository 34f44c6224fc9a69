"""Statistics over the dimensions of a vector column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrel.session import checkpointed

# Dimensions of a tile of the second moment, bytes of the sums of tiles that a task keeps, bytes of
# the rows it multiplies at once, and tasks whose tiles are added first.
BLOCK = 512
HELD_BYTES = 64 << 20
CHUNK_BYTES = 64 << 20
FAN_IN = 64


def channel_stats(df: DataFrame, vec: str) -> DataFrame:
    """``(pos, abs_max, mean, mean_sq, n, n_other)``, one row per dimension.

    Only finite values count; ``n_other`` is how many others there are. Values are summed per
    task before the shuffle, which carries one row per dimension and task.
    """
    infinite = F.lit(float("inf"))
    value = F.when(~F.isnan("value") & (F.abs("value") < infinite), F.col("value"))
    return (
        df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "value"))
        .groupBy("pos")
        .agg(
            F.coalesce(F.max(F.abs(value)), F.lit(0.0)).alias("abs_max"),
            F.avg(value).alias("mean"),
            F.avg(value * value).alias("mean_sq"),
            F.count(value).alias("n"),
            F.count_if(value.isNull()).alias("n_other"),
        )
    )


def channel_state(df: DataFrame, vec: str) -> DataFrame:
    """``(pos, n, mean, m2, abs_max, n_other)``: statistics that can be added to those of other rows.

    ``m2`` is the sum of squared distances from the mean. Keep one per input folder, and new data
    costs a scan of the new data alone; see ``merge_states`` and ``stats_of``.
    """
    infinite = F.lit(float("inf"))
    value = F.when(~F.isnan("value") & (F.abs("value") < infinite), F.col("value"))
    return (
        df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "value"))
        .groupBy("pos")
        .agg(
            F.count(value).alias("n"),
            F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
            F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("m2"),
            F.coalesce(F.max(F.abs(value)), F.lit(0.0)).alias("abs_max"),
            F.count_if(value.isNull()).alias("n_other"),
        )
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One state per dimension from the rows of several ``channel_state`` tables, in any order.

    Two states are added by their counts, means and ``m2``, never by differences of large squares.
    """
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def added(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        share = b["n"] / F.greatest(n, F.lit(1))
        apart = b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"),
            (a["mean"] + apart * share).alias("mean"),
            (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"),
        )

    # As many entries as there are states, of a few numbers each.
    own = F.array_sort(F.collect_list(F.struct("n", "mean", "m2")))
    return (
        states.groupBy("pos")
        .agg(F.aggregate(own, none, added).alias("all"), F.max("abs_max").alias("abs_max"), F.sum("n_other").alias("n_other"))
        .select("pos", "all.n", "all.mean", "all.m2", "abs_max", "n_other")
    )


def stats_of(state: DataFrame) -> DataFrame:
    """What ``channel_stats`` gives, from a state."""
    some = F.col("n") > 0
    return state.select(
        "pos",
        "abs_max",
        F.when(some, F.col("mean")).alias("mean"),
        F.when(some, F.col("m2") / F.col("n") + F.col("mean") * F.col("mean")).alias("mean_sq"),
        "n",
        "n_other",
    )


def with_channels(df: DataFrame, name: str, stats: DataFrame, value: Column | str) -> DataFrame:
    """Adds the values of a ``(pos, ...)`` table to every row, as one array by position.

    The array is a scalar subquery: one entry per dimension, sent along with the tasks in
    place of a join.
    """
    value = F.col(value) if isinstance(value, str) else value
    placed = F.array_sort(F.collect_list(F.struct(F.col("pos"), value.alias("value"))))
    array = stats.agg(placed.alias("placed")).select(F.col("placed.value")).scalar()
    return df.withColumn(name, array)


def importance(stats: DataFrame) -> DataFrame:
    """``(pos, rank)``: dimensions by mean square, largest first, ranks from 0.

    Works on one row per dimension. Equal mean squares go by position; a dimension without
    finite values comes last.
    """
    entry = F.struct((-F.coalesce("mean_sq", F.lit(-1.0))).alias("mean_sq"), F.col("pos").alias("pos"))
    return stats.agg(F.array_sort(F.collect_list(entry)).alias("ordered")).select(
        F.posexplode("ordered.pos").alias("rank", "pos")
    ).select("pos", "rank")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of finite vectors of one length as doubles, a bounded number at a time."""
    d = None
    for batch in batches:
        vectors = batch.column(0).drop_null()
        if len(vectors) == 0:
            continue
        lengths = np.unique(pc.list_value_length(vectors).to_numpy(zero_copy_only=False))
        if lengths.size > 1 or (d is not None and d != lengths[0]):
            raise ValueError("vectors differ in length")
        d = int(lengths[0])
        rows = max(1, CHUNK_BYTES // (8 * max(1, d)))
        for start in range(0, len(vectors), rows):
            some = vectors.slice(start, rows)
            x = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), d)
            yield x[np.isfinite(x).all(axis=1)]


def _partial_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tiles on and above the diagonal of the sum of ``x'x`` over one task.

    As many tiles as fit are kept and added up; the others leave as they are for each chunk of
    rows, so a task never holds the whole matrix.
    """
    sums: dict[tuple[int, int], np.ndarray] = {}
    held = n = 0
    for x in _chunks(batches):
        n += len(x)
        for top in range(0, x.shape[1], BLOCK):
            for left in range(top, x.shape[1], BLOCK):
                cells = x[:, top : top + BLOCK].T @ x[:, left : left + BLOCK]
                if (top, left) in sums:
                    sums[top, left] += cells
                elif held + cells.nbytes <= HELD_BYTES:
                    sums[top, left] = cells
                    held += cells.nbytes
                else:
                    yield _block(top, left, np.ascontiguousarray(cells), len(x))
    for (top, left), cells in sums.items():
        yield _block(top, left, np.ascontiguousarray(cells), n)


def _block(top: int, left: int, cells: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "top": pa.array([top], pa.int32()),
            "left": pa.array([left], pa.int32()),
            "width": pa.array([cells.shape[1]], pa.int32()),
            "cells": pa.array([cells.tobytes()], pa.binary()),
            "n": pa.array([n], pa.int64()),
        }
    )


def _summed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one place, which come one after the other, added up."""
    place, total, n = None, None, 0
    for batch in batches:
        for row in batch.to_pylist():
            cells = np.frombuffer(row["cells"]).reshape(-1, row["width"])
            if (row["top"], row["left"]) != place:
                if place is not None:
                    yield _block(*place, total, n)
                place, total, n = (row["top"], row["left"]), np.zeros(cells.shape), 0
            total, n = total + cells, n + row["n"]
    if place is not None:
        yield _block(*place, total, n)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            cells = np.frombuffer(row["cells"]).reshape(-1, row["width"])
            i, j = (c.ravel() for c in np.indices(cells.shape))
            i, j, s = i + row["top"], j + row["left"], cells.ravel()
            mirrored = j > i if row["top"] == row["left"] else np.ones(i.size, bool)
            kept = j >= i
            yield pa.RecordBatch.from_pydict(
                {
                    "i": pa.array(np.r_[i[kept], j[mirrored]], pa.int32()),
                    "j": pa.array(np.r_[j[kept], i[mirrored]], pa.int32()),
                    "h": pa.array(np.r_[s[kept], s[mirrored]] / max(1, row["n"])),
                }
            )


def second_moment(df: DataFrame, vec: str, damp: float = 0.01, fan_in: int = FAN_IN) -> DataFrame:
    """``(i, j, h)`` of ``H = X'X / n`` with ``damp * mean(diag H)`` added on the diagonal.

    Each task multiplies chunks of its rows tile by tile and sends its tiles on and above the diagonal,
    8 bytes a cell; no task holds the matrix, whatever the dimension. Where there are more than ``fan_in`` tasks tiles are
    added for so many at a time first, so that no task reads one tile from every other. Vectors with
    values that are not finite count nowhere.
    """
    kinds = "top int, left int, width int, cells binary, n long"
    blocks = df.select(vec).mapInArrow(_partial_products, kinds)
    levels = [["top", "left"]]
    if df.select(vec).rdd.getNumPartitions() > fan_in:
        blocks = blocks.withColumn("senders", F.floor(F.spark_partition_id() / fan_in))
        levels.insert(0, ["top", "left", "senders"])
    for keys in levels:
        dealt = blocks.repartition(*keys).sortWithinPartitions(*keys)
        blocks = dealt.mapInArrow(_summed_blocks, kinds)
    cells = checkpointed(blocks.mapInArrow(_cells, "i int, j int, h double"))
    mean = cells.filter("i = j").agg(F.avg("h").alias("mean")).scalar()
    damped = F.when(F.col("i") == F.col("j"), F.col("h") + damp * mean).otherwise(F.col("h"))
    return cells.withColumn("h", damped)
