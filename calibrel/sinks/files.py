"""Calibration sets and compressed vectors as files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrel.operators.assemble import long_conversations
from calibrel.operators.filters import count_rows
from calibrel.operators.packing import PACKINGS
from calibrel.session import checkpointed

#: Rows of up to this part of a file's bound fill files together.
SMALL_SHARE = 20


def _joined_lines(parts: DataFrame, key: str) -> DataFrame:
    """Rows of several parts as rows that end where a line does.

    Each row of a text file gets a newline, but a conversation's parts follow each other without
    one. What stands after a part's last newline therefore goes before the first of the next; only
    such pieces of one line are gathered, and they must be one row in any case.
    """
    counted = parts.withColumn("_lines", F.size(F.split("text", "\n", -1)) - 1)
    # narrow: one row per part of the few conversations that have several
    before = W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    breaks = counted.select(key, "part", (F.col("_lines") > 0).cast("int").alias("_breaks"))
    placed = breaks.select(
        key, "part", F.coalesce(F.sum("_breaks").over(before), F.lit(0)).cast("bigint").alias("_line")
    )
    pieces = counted.join(placed, [key, "part"]).select(
        key,
        F.inline(
            F.when(
                F.col("_lines") == 0,
                F.array(F.struct(F.col("_line"), F.lit(1).alias("_at"), "part", "text")),
            ).otherwise(
                F.array(
                    F.struct("_line", F.lit(1).alias("_at"), "part", F.substring_index("text", "\n", 1).alias("text")),
                    F.struct(
                        "_line",
                        F.lit(2).alias("_at"),
                        "part",
                        # the whole lines between the first and the last newline
                        F.regexp_extract("text", r"(?s)^[^\n]*\n(.*)\n[^\n]*$", 1).alias("text"),
                    ),
                    F.struct(
                        (F.col("_line") + 1).alias("_line"),
                        F.lit(1).alias("_at"),
                        "part",
                        F.substring_index("text", "\n", -1).alias("text"),
                    ),
                )
            )
        ),
        "_lines",
    )
    border = (
        pieces.filter("_at = 1")
        .groupBy(key, "_line")
        .agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("_pieces"))
        .select(key, "_line", F.lit(1).alias("_at"), F.array_join("_pieces.text", "").alias("text"))
    )
    return border.unionByName(pieces.filter("_at = 2 AND _lines > 1").select(key, "_line", "_at", "text"))


def write_text(
    df: DataFrame,
    path: str,
    order_by: tuple[Column | str, ...] = (),
    single_file: bool = False,
    key: str = "conv_id",
) -> None:
    """Each text followed by a newline, UTF-8. A text may hold newlines itself.

    Rows with a column ``part`` are pieces of one text and give the same bytes as the whole.
    They need ``order_by``, expressions on ``key`` alone, if they are to follow each other.
    ``order_by`` sorts over all files, which then follow each other by name. ``single_file``
    writes through one task; ask for it only for a sample.
    """
    order = list(order_by)
    if "part" in df.columns:
        several, n = long_conversations(df.select(key, "part"), key)
        if n:
            whole = df.join(several, key, "left_anti").select(
                key, F.lit(0).cast("bigint").alias("_line"), F.lit(1).alias("_at"), "text"
            )
            # read several times below
            parts = checkpointed(df.join(several, key, "left_semi").select(key, "part", "text"))
            df = whole.unionByName(_joined_lines(parts, key))
            order = [*order, "_line", "_at"] if order else []
    if order:
        df = df.orderBy(*order)
    if single_file:
        df = df.coalesce(1)
    df.select("text").write.text(path)


def write_calibration(df: DataFrame, path: str, required: bool = False) -> None:
    """Token ids or texts for the consumer.

    If ``required``, a set without rows is an error; it is written, empty, and counted on the way.
    """
    df, seen = count_rows(df)
    df.write.parquet(path)
    if required and not seen.get["n"]:
        raise ValueError("no valid calibration rows")


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values before compression."""

    def size(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return F.coalesce(F.octet_length(value).cast("bigint"), F.lit(0))
        if isinstance(kind, T.BinaryType):
            return F.coalesce(F.octet_length(value).cast("bigint"), F.lit(0))
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.ByteType, T.BooleanType)):
                return F.coalesce(F.size(value).cast("bigint"), F.lit(0))
            if isinstance(kind.elementType, (T.StringType, T.ArrayType, T.StructType)):
                return F.coalesce(
                    F.aggregate(
                        value,
                        F.lit(0).cast("bigint"),
                        lambda total, v: total + size(v, kind.elementType),
                    ),
                    F.lit(0),
                )
            width = 4 if isinstance(kind.elementType, (T.IntegerType, T.FloatType)) else 8
            return F.coalesce(F.size(value).cast("bigint") * width, F.lit(0))
        if isinstance(kind, T.StructType):
            return sum((size(value[f.name], f.dataType) for f in kind.fields), F.lit(0))
        if isinstance(kind, T.MapType):
            return size(F.map_entries(value), T.ArrayType(
                T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
            ))
        return F.lit(8).cast("bigint")

    return sum((size(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(0).cast("bigint"))


def _size_class(max_bytes: int) -> Column:
    """0 for rows of up to a share of the bound, else the power of two that a row's size is within."""
    power = F.ceil(F.log2(F.greatest(F.col("_bytes"), F.lit(1)))).cast("int")
    return F.when(F.col("_bytes") <= max_bytes // SMALL_SHARE, 0).otherwise(power + 1)


def _numbered(bases: dict[tuple[int, int], int], firsts: dict[int, tuple[int, int]]):
    """Rows to shards: where a row begins in the running sum of its class, in units of the class's target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sums = TaskContext.get().partitionId(), {}
        for batch in batches:
            sizes, classes = (batch[c].to_numpy() for c in ("_bytes", "_class"))
            shards = np.zeros(len(sizes), np.int64)
            for k in np.unique(classes).tolist():
                own = np.flatnonzero(classes == k)
                ends = np.cumsum(sizes[own]) + sums.get(k, bases.get((task, k), 0))
                first, target = firsts[k]
                shards[own] = first + (ends - sizes[own]) // target
                sums[k] = int(ends[-1])
            columns = [*batch.columns[:-2], pa.array(shards, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-2], "_shard"])

    return run


def write_sharded(df: DataFrame, path: str, max_bytes: int) -> None:
    """Writes files of at most ``max_bytes`` of values each; a larger row has its own file.

    A running sum of the rows' bytes over all tasks tells where each row stands, and so its shard; every
    shard is one task of one write. Rows of at most a twentieth of the bound fill their files to nine
    tenths or more; larger ones are dealt out by classes of similar size. The input is worked out once,
    into a staging folder beside ``path``, which must not exist and appears when all its files are complete.
    """
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        df.withColumn("_bytes", F.greatest(row_bytes(df), F.lit(1))).withColumn(
            "_class", _size_class(max_bytes)
        ).write.parquet(f"{staging}/in")
        added = [T.StructField("_bytes", T.LongType()), T.StructField("_class", T.IntegerType())]
        staged = spark.read.schema(T.StructType([*df.schema.fields, *added])).parquet(f"{staging}/in")
        # One row per task and class.
        sums = (
            staged.groupBy(F.spark_partition_id().alias("task"), "_class")
            .agg(F.sum("_bytes").alias("bytes"), F.max("_bytes").alias("top"))
            .orderBy("_class", "task")
            .collect()
        )
        bases, firsts, n_shards = {}, {}, 0
        for k, of_class in groupby(sums, key=lambda r: r["_class"]):
            rows, total = list(of_class), 0
            for r in rows:
                bases[r["task"], k] = total
                total += r["bytes"]
            # a shard begins anywhere below its target, and its last row may reach over it
            fill = max(1, max_bytes - max(r["top"] for r in rows))
            firsts[k] = n_shards, fill
            n_shards += -(-total // fill)
        if not sums:
            df.write.parquet(f"{staging}/out")
        else:
            names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
            numbered = staged.mapInArrow(_numbered(bases, firsts), f"{names}, _shard int")
            numbered.repartitionById(n_shards, "_shard").drop("_shard").write.parquet(f"{staging}/out")
        if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{staging}/out"), target):
            raise OSError(f"cannot move the files to {path}")
    finally:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(staging), True)


def write_codes(
    df: DataFrame, path: str, vec: str, shared: dict[str, DataFrame] | None = None, packing: str | None = None
) -> None:
    """Codes and scales without the floats they stand for.

    ``shared`` tables, such as per-channel scales or ranks, are written once beside the rows. With
    ``packing`` (``int4`` or ``e4m3``) codes take half a byte or one, in the column ``codes_`` and its
    name; ``read_codes`` gives them back.
    """
    rows = df.drop(vec)
    if packing is not None:
        pack, _ = PACKINGS[packing]
        rows = rows.withColumn("codes", pack(F.col("codes"))).withColumnRenamed("codes", f"codes_{packing}")
    rows.write.parquet(f"{path}/rows")
    for name, table in (shared or {}).items():
        table.write.parquet(f"{path}/{name}")


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_codes`` was given, however their codes were packed."""
    rows = spark.read.parquet(f"{path}/rows")
    for name, (_, unpack) in PACKINGS.items():
        if f"codes_{name}" in rows.columns:
            column = f"codes_{name}"
            return rows.withColumn(column, unpack(F.col(column))).withColumnRenamed(column, "codes")
    return rows
