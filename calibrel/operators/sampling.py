"""Repeatable samples: a seeded random order and its first n rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
# Sketches that one task merges.
FAN_IN = 64
BROADCAST_BYTES = 32 << 20


def shuffle_key(key: Column, seed: int = SEED) -> Column:
    """A random-looking key that depends on the seed and the row only, not on partitions."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _smallest(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[np.ndarray]:
    """The ``n`` smallest different keys of the batches in order, each as its two 64-bit halves."""
    held = np.zeros((0, 2), np.uint64)
    for batch in batches:
        keys = batch["digest"].drop_null()
        if not len(keys):
            continue
        keys = keys.cast(pa.binary(16))
        new = np.frombuffer(keys.buffers()[1], ">u8", 2 * len(keys), 16 * keys.offset).astype(np.uint64).reshape(-1, 2)
        if len(held) == n:
            new = new[new[:, 0] <= held[-1, 0]]
        both = np.concatenate((held, new))
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        different = np.ones(len(both), bool)
        different[1:] = (both[1:] != both[:-1]).any(axis=1)
        held = both[different][:n]
    yield held


def nth_smallest(keys: DataFrame, n: int) -> tuple[int, str | None]:
    """How many different values ``shuffle_key`` has, at most n, and the largest of the n smallest.

    One scan: every task keeps a sketch of its ``n`` smallest keys, and sketches are merged ``FAN_IN``
    at a time into one of the same size, so no task holds more than one and what is merged into it.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for held in _smallest(batches, n):
            digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(held), [None, pa.py_buffer(held.astype(">u8").tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(held), task), pa.int32()), digests.cast(pa.binary())], names=["task", "digest"]
            )

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _smallest(batches, n):
            bound = [held[-1].astype(">u8").tobytes().hex()] if len(held) else [None]
            yield pa.RecordBatch.from_arrays([pa.array([len(held)]), pa.array(bound, pa.string())], names=["n", "bound"])

    tasks, schema = keys.rdd.getNumPartitions(), "task int, digest binary"
    level = keys.select(F.unhex("shuffle_key").alias("digest")).mapInArrow(sketch, schema)
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        level = level.repartition(tasks, F.floor(F.col("task") / FAN_IN)).mapInArrow(sketch, schema)
    found = level.repartition(1).mapInArrow(last, "n long, bound string").first()
    return (found["n"], found["bound"]) if found else (0, None)


def sample_bound(df: DataFrame, key: str, n: int, seed: int = SEED, on_short: str = "error") -> str | None:
    """The n-th different shuffle key in order; null if there are fewer than n.

    Found in one scan of the key column, see ``nth_smallest``; a key counts once however many rows have it.
    """
    if on_short not in ("error", "truncate"):
        raise ValueError(f"unknown on_short {on_short!r}")
    if n < 0:
        raise ValueError(f"cannot take {n} rows")
    keyed = df.filter(F.col(key).isNotNull()).select(shuffle_key(F.col(key), seed).alias("shuffle_key"))
    found, bound = nth_smallest(keyed, n) if n else (0, "")
    if found < n:
        if on_short == "error":
            raise ValueError(f"{n} rows asked for, {found} found")
        return None
    return bound


def sample_n(df: DataFrame, key: str, n: int, seed: int = SEED, on_short: str = "error") -> DataFrame:
    """The first n rows of the shuffled order, in no order, with the column ``shuffle_key``.

    ``key`` identifies a row; rows without one are never taken, and rows that share a key are taken
    together and count once. Fewer than n are an error, or are all taken with ``on_short="truncate"``. The sample is a filter on the shuffle key, so
    no task gathers it and it can be read anew at no more than a scan.
    """
    return taken_by(df, key, sample_bound(df.select(key), key, n, seed, on_short), seed)


def taken_by(df: DataFrame, key: str, bound: str | None, seed: int = SEED) -> DataFrame:
    """The rows up to a bound, with the column ``shuffle_key``; all rows with a key without one."""
    keyed = df.filter(F.col(key).isNotNull()).withColumn("shuffle_key", shuffle_key(F.col(key), seed))
    return keyed if bound is None else keyed.filter(F.col("shuffle_key") <= bound)


def fetch_sampled(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is in a table of keys, sent along where it is small in bytes."""
    size = keys.agg(F.sum(16 + F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)))).first()[0]
    return df.join(F.broadcast(keys) if (size or 0) <= BROADCAST_BYTES else keys, key, "left_semi")


def sample_rows(
    df: DataFrame, key: str, n: int, seed: int = SEED, on_short: str = "error"
) -> DataFrame:
    """Samples n keys from the narrow key column, then reads the wide rows of those only."""
    return sample_n(df, key, n, seed, on_short).drop("shuffle_key")


def sample_conversations(
    turns: DataFrame, n: int, seed: int = SEED, on_short: str = "error", key: str = "conv_id"
) -> DataFrame:
    """All turn rows of n sampled conversations of a flat table."""
    bound = sample_bound(turns.select(key), key, n, seed, on_short)
    return taken_by(turns, key, bound, seed).drop("shuffle_key")


def peek(df: DataFrame, key: str, n: int = 1, turns: int | None = None) -> DataFrame:
    """The first n rows by key and part, with the first turns of each for inspection."""
    first = df.orderBy(key, *(["part"] if "part" in df.columns else [])).limit(n)
    if turns is None:
        return first
    return first.withColumn("conversations", F.slice("conversations", 1, turns))


def first_conversations(turns: DataFrame, n: int = 1, key: str = "conv_id") -> DataFrame:
    """All turn rows of the n smallest keys, found in the narrow key column."""
    if n == 1:
        first = turns.agg(F.min(key).alias("_first"))
        return turns.filter(F.col(key) == first.scalar())
    return fetch_sampled(turns, turns.select(key).distinct().orderBy(key).limit(n), key)
