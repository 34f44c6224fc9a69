"""What the operators share: bounded Arrow batches, scratch tables, checked broadcasts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrel.session import bounded_batches, scratch_path

BROADCAST_BYTES = 32 << 20

def texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id`` and ``text``, null read as empty; every other column is left behind."""
    bounded_batches(df.sparkSession)
    return df.select(
        df[id_column].alias("doc_id"), F.coalesce(df[text_column], F.lit("")).alias("text")
    )


def text_key(text: str) -> int:
    """What Spark's ``xxhash64`` gives for a text; tells rows with one id apart."""
    value = xxhash.xxh64_intdigest(text, 42)
    return value - (1 << 64) if value >> 63 else value


def without(df: DataFrame, keys: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df`` whose id and text are not among ``keys`` (``doc_id, text_key``).

    Null ids match null ids. The texts are only shuffled where the keys are too many to broadcast.
    """
    return _by_keys(df, keys, id_column, text_column, "left_anti")


def only(df: DataFrame, keys: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The other rows than ``without`` gives."""
    return _by_keys(df, keys, id_column, text_column, "left_semi")


def _by_keys(df: DataFrame, keys: DataFrame, id_column: str, text_column: str, how: str) -> DataFrame:
    keys = written(keys.select("doc_id", "text_key").distinct(), "keys")
    same = df[id_column].eqNullSafe(keys["doc_id"]) & (
        F.xxhash64(F.coalesce(df[text_column], F.lit(""))) == keys["text_key"]
    )
    return df.join(if_small(keys, keys.count() * 32), same, how)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, which outlives executors and is read again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which the worker gives back the memory it freed: Spark keeps workers, and allocators what is free."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return through


def if_small(df: DataFrame, size: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast where ``size`` measured bytes are at most ``most``."""
    return F.broadcast(df) if size <= most else df
