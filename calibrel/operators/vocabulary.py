"""Token ids through a vocabulary table ``(token, id)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from calibrel.session import bounded_batches, checkpointed, scratch_path

# A vocabulary within both bounds may be sent to every worker.
SHARED_ENTRIES = 1_000_000
SHARED_BYTES = 64 << 20
# Values (and rows) of a block of arrays that shares one dictionary while it is joined.
BLOCK_VALUES = 1 << 20
# Hex digits that name a bucket while ids are given out.
BUCKET_DIGITS = 3


def build_vocabulary(tokens: DataFrame) -> DataFrame:
    """``(token, id)`` of the distinct values of ``token``; ids from 0 without gaps.

    Ids follow the order of (leading md5 digits, token). The digits spread the distinct
    tokens evenly, so each bucket is numbered in its own task and only the bucket sizes,
    a fixed number of rows, are summed in one place. The distinct tokens are worked out once.
    """
    bucket = F.substring(F.md5("token"), 1, BUCKET_DIGITS)
    distinct = checkpointed(tokens.select("token").distinct()).withColumn("_bucket", bucket)
    sizes = distinct.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select(
        "_bucket",
        F.coalesce(
            F.sum("_size").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_start"),
    )
    place = F.row_number().over(W.partitionBy("_bucket").orderBy("token")) - 1
    return (
        distinct.withColumn("_place", place)
        .join(F.broadcast(starts), "_bucket")
        .select("token", (F.col("_start") + F.col("_place")).cast("int").alias("id"))
    )


def unique_entries(vocabulary: DataFrame, source: str, target: str) -> DataFrame:
    """One entry per value of ``source``, the smallest where there are several; none for null."""
    return (
        vocabulary.filter(F.col(source).isNotNull())
        .groupBy(source)
        .agg(F.min(target).alias(target))
    )


def fits_workers(vocabulary: DataFrame) -> bool:
    """Whether the vocabulary is small enough to share; counts no further than the bound."""
    size = (
        vocabulary.limit(SHARED_ENTRIES + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token")).alias("bytes"))
        .first()
    )
    return size["n"] <= SHARED_ENTRIES and (size["bytes"] or 0) <= SHARED_BYTES


def _lookup(vocabulary: DataFrame, source: str, target: str, otherwise: int | str):
    """Array to array through a shared vocabulary, whole Arrow batches at a time."""
    pairs = vocabulary.select(source, target).toArrow().combine_chunks()
    shared = vocabulary.sparkSession.sparkContext.broadcast(pairs)
    kind = "int" if target == "id" else "string"

    @arrow_udf(f"array<{kind}>")
    def translate(arrays: pa.Array) -> pa.Array:
        table = shared.value
        places = pc.index_in(arrays.flatten(), value_set=table[source])
        values = pc.fill_null(table[target].take(places), otherwise).combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(arrays), 0)
        ends = pc.cumulative_sum(lengths)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
        return pa.ListArray.from_arrays(offsets, values, mask=pc.is_null(arrays))

    return translate


def _blocks(column: str, key: list[str], kind: pa.DataType):
    """Arrow rows to blocks: keys, lengths, the values as places in a dictionary, and that dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            arrays = rows[column].combine_chunks()
            coded = pc.dictionary_encode(arrays.flatten(), null_encoding="encode")
            keys = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in key], names=key)
            width = np.uint16 if len(coded.dictionary) <= 1 << 16 else np.uint32
            places = pa.compress(coded.indices.to_numpy().astype(width).tobytes(), "zstd", asbytes=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + number]),
                    _one_list(keys),
                    _one_list(pc.list_value_length(arrays)),
                    pa.array([places], pa.binary()),
                    _one_list(coded.dictionary.cast(kind)),
                ],
                names=["_block", "_keys", "_lengths", "_places", "_values"],
            )

        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch[column]), 0).to_numpy()
            # rows are counted too, so that empty ones do not gather without end
            sizes = np.cumsum(lengths + 1)
            cuts = np.searchsorted(sizes, np.arange(BLOCK_VALUES, sizes[-1] if len(sizes) else 0, BLOCK_VALUES))
            bounds = np.unique(np.concatenate(([0], cuts + 1, [batch.num_rows]))).tolist()
            for start, end in zip(bounds, bounds[1:]):
                if start == end:
                    continue
                held.append(batch.select([column, *key]).slice(start, end - start))
                size += int(sizes[end - 1] - (sizes[start - 1] if start else 0))
                if size >= BLOCK_VALUES:
                    yield block()
                    number, held, size = number + 1, [], 0
        if held:
            yield block()

    return run


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _unpacked(column: str, key: list[str], kind: pa.DataType, otherwise: int | str):
    """Blocks and what their dictionaries became back to rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = {name: batch[name].slice(row, 1).flatten() for name in ("_keys", "_lengths", "_found")}
                lengths = block["_lengths"]
                ends = np.concatenate(([0], np.cumsum(pc.fill_null(lengths, 0).to_numpy()))).astype(np.int32)
                n = batch["_n"][row].as_py()
                width = np.uint16 if n <= 1 << 16 else np.uint32
                raw = pa.decompress(batch["_places"][row].as_py(), int(ends[-1]) * np.dtype(width).itemsize, "zstd", asbytes=True)
                places = np.full(n, -1, np.int64)
                found = block["_found"]
                places[found.field("place").to_numpy()] = np.arange(len(found))
                at = pa.array(places, mask=places < 0).take(pa.array(np.frombuffer(raw, width)))
                values = pc.fill_null(found.field("target").take(at), otherwise).cast(kind)
                arrays = pa.ListArray.from_arrays(pa.array(ends), values, mask=pc.is_null(lengths))
                fields = [block["_keys"].field(c) for c in range(len(key))]
                yield pa.RecordBatch.from_arrays([*fields, arrays], names=[*key, column])

    return run


def _join(
    df: DataFrame, column: str, source: str, target: str, vocabulary: DataFrame, key: list[str], otherwise: int | str
) -> DataFrame:
    """Array to array through a vocabulary of any size.

    Rows are packed into blocks of about ``BLOCK_VALUES`` values with one dictionary each. Only the
    dictionaries meet the vocabulary, so a value that all rows have comes once per block, and the
    arrays are compressed places in a dictionary, translated block by block in Arrow. Rows of equal key stay apart.
    """
    rows = df.select(*key, column)
    kinds = {f.name: f.dataType.simpleString() for f in (*rows.schema, *vocabulary.schema)}
    fields = ",".join(f"`{c}`:{kinds[c]}" for c in key)
    schema = (
        f"_block long, _keys array<struct<{fields}>>, _lengths array<int>, _places binary, "
        f"_values array<{kinds[source]}>"
    )
    given, made = (to_arrow_type(vocabulary.schema[c].dataType) for c in (source, target))
    bounded_batches(df.sparkSession)
    # compressed, which checkpoints are not
    path = scratch_path(df.sparkSession, "blocks")
    rows.mapInArrow(_blocks(column, key, given), schema).write.option("compression", "zstd").parquet(path)
    blocks = df.sparkSession.read.schema(schema).parquet(path)
    entries = blocks.select("_block", F.posexplode("_values").alias("place", source))
    found = (
        entries.join(vocabulary.hint("merge"), source)
        .groupBy("_block")
        .agg(F.collect_list(F.struct("place", F.col(target).alias("target"))).alias("_found"))
    )
    none = F.array().cast(f"array<struct<place:int,target:{kinds[target]}>>")
    joined = blocks.select("_block", "_keys", "_lengths", "_places", F.size("_values").alias("_n")).join(
        found, "_block", "left"
    )
    packed = joined.withColumn("_found", F.coalesce("_found", none)).drop("_block")
    names = ", ".join(f"`{c}` {kinds[c]}" for c in key)
    return packed.mapInArrow(
        _unpacked(column, key, made, otherwise), f"{names}, `{column}` array<{kinds[target]}>"
    )


def _translate(
    df: DataFrame,
    column: str,
    source: str,
    target: str,
    vocabulary: DataFrame,
    key: list[str],
    otherwise: int | str,
    shared: bool | None,
) -> DataFrame:
    entries = unique_entries(vocabulary, source, target)
    if shared is not False:
        fits = fits_workers(vocabulary)
        if shared and not fits:
            raise ValueError(f"a vocabulary over {SHARED_ENTRIES} entries or {SHARED_BYTES} bytes is not shared")
        if fits:
            lookup = _lookup(entries, source, target, otherwise)
            return df.select(*key, lookup(F.col(column)).alias(column))
    return _join(df, column, source, target, entries, key, otherwise)


def encode(
    df: DataFrame,
    tokens: str,
    vocabulary: DataFrame,
    key: list[str],
    unknown_id: int = -1,
    shared: bool | None = None,
) -> DataFrame:
    """``(key, tokens)`` with each token replaced by its id.

    A vocabulary of checked size goes to the workers and nothing is shuffled; a larger one is
    joined, as is any with ``shared=False``. Of several entries of a token the smallest id
    counts, and rows of equal key stay apart, either way.
    """
    return _translate(df, tokens, "token", "id", vocabulary, key, unknown_id, shared)


def decode(
    df: DataFrame,
    ids: str,
    vocabulary: DataFrame,
    key: list[str],
    unknown_token: str = "",
    shared: bool | None = None,
) -> DataFrame:
    """``(key, ids)`` with each id replaced by its token."""
    return _translate(df, ids, "id", "token", vocabulary, key, unknown_token, shared)


def detokenize(
    df: DataFrame, ids: str, vocabulary: DataFrame, key: list[str], glue: str = " "
) -> DataFrame:
    """``(key, text)``: the tokens of the ids, joined."""
    return decode(df, ids, vocabulary, key).select(*key, F.array_join(ids, glue).alias("text"))
