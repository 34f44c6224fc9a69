"""Conversation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrel.functions.chat import MIXED_TURNS


def read_conversations(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    schema: str | None = None,
    format: str = "parquet",
) -> DataFrame:
    """A table of conversations and, of it, one split.

    With the table partitioned by ``split`` only the folders of that split are read. JSON
    needs a schema; fields a record lacks are null.
    """
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    elif format == "json":
        raise ValueError("JSON conversations need a schema")
    df = reader.load(path)
    return df if split is None else df.filter(F.col("split") == split)


def parse_conversations(raw: Column) -> Column:
    """A mixed turn array from JSON text; null where the text cannot be parsed."""
    return F.from_json(raw, MIXED_TURNS)
