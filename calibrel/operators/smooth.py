"""Moving the spread of one vector table into another that shares its dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrel.operators.stats import channel_stats, with_channels


def smooth_scales(x_stats: DataFrame, w_stats: DataFrame, strength: float = 0.8) -> DataFrame:
    """``(pos, s)`` with ``s = max|x|^a / max|w|^(1-a)`` per dimension.

    A dimension that is all zero on either side keeps the scale 1.
    """
    x, w = F.col("x_max"), F.col("w_max")
    s = F.pow(x, F.lit(strength)) / F.pow(w, F.lit(1.0 - strength))
    return (
        x_stats.select("pos", F.col("abs_max").alias("x_max"))
        .join(w_stats.select("pos", F.col("abs_max").alias("w_max")), "pos")
        .select("pos", F.when((x > 0) & (w > 0), s).otherwise(F.lit(1.0)).alias("s"))
    )


def divide_by(df: DataFrame, vec: str, scales: DataFrame) -> DataFrame:
    divided = F.zip_with(F.col(vec).cast("array<double>"), "_s", lambda a, s: a / s)
    return with_channels(df, "_s", scales, "s").withColumn(vec, divided).drop("_s")


def multiply_by(df: DataFrame, vec: str, scales: DataFrame) -> DataFrame:
    product = F.zip_with(F.col(vec).cast("array<double>"), "_s", lambda a, s: a * s)
    return with_channels(df, "_s", scales, "s").withColumn(vec, product).drop("_s")


def smooth(
    x: DataFrame, w: DataFrame, x_vec: str, w_vec: str, strength: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """``x / s`` and ``w * s``: every dot product of a row of x with a row of w stays."""
    scales = smooth_scales(channel_stats(x, x_vec), channel_stats(w, w_vec), strength)
    return divide_by(x, x_vec, scales), multiply_by(w, w_vec, scales)
