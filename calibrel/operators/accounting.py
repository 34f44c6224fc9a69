"""Why rows are kept or skipped, and counts of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

REASONS = ("missing", "error", "few_turns", "short", "ok")


def merged_facts() -> list[Column]:
    """Aggregates that make the facts of parts into facts of their whole.

    They can be taken in steps. Digests are an exclusive or over turns, so that of a whole is the
    one of its parts.
    """
    return [
        F.bool_or("missing").alias("missing"),
        F.bool_or("failed").alias("failed"),
        F.sum("n_turns").alias("n_turns"),
        F.sum("dropped").alias("dropped"),
        F.sum("n_tokens").alias("n_tokens"),
        F.bit_xor("digest").alias("digest"),
    ]


def merge_parts(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Facts of whole conversations from rows that may each hold a part of one."""
    return rows.groupBy(key).agg(*merged_facts())


def classify(
    df: DataFrame, least_turns: int = 2, least_tokens: int = 10, max_length: int | None = None
) -> DataFrame:
    """Adds ``reason``: missing, error, few_turns, short or ok, tested in this order.

    The length test counts the tokens left after truncation to ``max_length``.
    """
    length = F.col("n_tokens")
    if max_length is not None:
        length = F.least(length, F.lit(max_length))
    reason = (
        F.when(F.col("missing"), "missing")
        .when(F.col("failed"), "error")
        .when(F.col("n_turns") < least_turns, "few_turns")
        .when(length < least_tokens, "short")
        .otherwise("ok")
    )
    return df.withColumn("reason", reason)


def account(classified: DataFrame) -> DataFrame:
    """Rows per reason."""
    return classified.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def observe_reasons(classified: DataFrame, name: str = "reasons") -> tuple[DataFrame, Observation]:
    """Counts the reasons while another action runs, without a pass of its own."""
    seen = Observation(name)
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    return classified.observe(seen, *counts), seen


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, whole numbers first in numeric order, then the other names."""
    number = F.col(column).try_cast("int")
    return (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(number.isNull(), number, F.col(column))
    )


def any_in(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row ``found``: whether any row has one of the values.

    The filter reaches the scan and each task stops at its first hit.
    """
    hit: Column = F.count(F.lit(1)) > 0
    return df.filter(F.col(column).isin(values)).limit(1).agg(hit.alias("found"))
