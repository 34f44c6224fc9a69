"""Codes and scales in place of floats, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrel.operators.stats import channel_stats, importance, with_channels

# The E4M3 format.
FP8_MAX = 448.0
FP8_MIN_EXPONENT = -6
FP8_MANTISSA_BITS = 3


def largest_code(bits: int) -> int:
    if not 2 <= bits <= 8:
        raise ValueError(f"bits must be between 2 and 8, not {bits}")
    return 2 ** (bits - 1) - 1


def _abs_max(values: Column) -> Column:
    return F.greatest(F.array_max(values), -F.array_min(values))


def finite(values: Column) -> Column:
    """The vector as doubles; null if it or one of its values is null, NaN or infinite."""
    infinite = F.lit(float("inf"))
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return F.when(sound, values.cast("array<double>"))


def _divisors(scales: Column | str) -> Column:
    """The scales, with 1 for 0: an all-zero group gets codes 0."""
    return F.transform(scales, lambda s: F.when(s == 0, F.lit(1.0)).otherwise(s))


def split_groups(values: Column, group_size: int | None) -> Column:
    """Consecutive slices of ``group_size``; the last one may be short."""
    if group_size is None:
        return F.array(values)
    starts = F.sequence(F.lit(1), F.size(values), F.lit(group_size))
    return F.when(
        F.size(values) > 0, F.transform(starts, lambda s: F.slice(values, s, F.lit(group_size)))
    ).otherwise(F.array(values))


def _gather(values: Column | str, places: Column | str) -> Column:
    """The values at the given places.

    Both go in as arguments: a column used inside a lambda would be worked out again for
    every element once the optimizer merges the projections.
    """
    picked = F.zip_with(
        F.array(values), F.array(places), lambda v, at: F.transform(at, lambda p: F.get(v, p))
    )
    return F.get(picked, F.lit(0))


def by_rank(ranks: DataFrame) -> DataFrame:
    """``(pos, at)``: for each rank the dimension that has it."""
    return ranks.select(F.col("rank").alias("pos"), F.col("pos").alias("at"))


def channel_scales(stats: DataFrame, largest: float) -> DataFrame:
    """``(pos, scale)`` of per-channel quantization."""
    return stats.select("pos", (F.col("abs_max") / largest).alias("scale"))


def int_codes(
    df: DataFrame,
    vec: str,
    bits: int = 8,
    per: str = "row",
    group_size: int | None = None,
    order: str = "natural",
    stats: DataFrame | None = None,
) -> DataFrame:
    """Adds ``codes`` and, unless per channel, ``scales``.

    Codes are rounded half to even and lie in ``[-qmax, qmax]``, ``qmax = 2 ** (bits - 1) - 1``.
    A vector that holds a null, a NaN or an infinite value has null codes and scales.
    ``row``: one scale per vector. ``group``: one per ``group_size`` dimensions, taken in
    their natural order or in order of importance; codes always stand at their own
    dimension. Both need no shuffle. ``channel``: one scale per dimension for the whole
    table, from ``stats`` (``channel_stats`` of the column where not given); read them with
    ``channel_scales``.
    """
    qmax = largest_code(bits)
    if order not in ("natural", "importance"):
        raise ValueError(f"unknown order {order!r}")
    if (per == "group") != (group_size is not None):
        raise ValueError("group_size belongs to per='group'")

    # given statistics may be smaller than the values, and a tiny scale may lose digits
    def code(x: Column, d: Column) -> Column:
        near = F.rint(x / d)
        return F.greatest(F.least(near, F.lit(float(qmax))), F.lit(float(-qmax))).cast("tinyint")

    wide = df.withColumn("_x", finite(F.col(vec)))
    if per == "channel" or order == "importance":
        stats = channel_stats(df, vec) if stats is None else stats
    if per == "channel":
        wide = with_channels(wide, "_scales", channel_scales(stats, qmax), "scale")
        codes = F.zip_with("_x", _divisors("_scales"), code)
        return wide.withColumn("codes", codes).drop("_x", "_scales")
    if per not in ("row", "group"):
        raise ValueError(f"unknown per {per!r}")
    if order == "importance":
        ranks = importance(stats)
        wide = with_channels(wide, "_order", by_rank(ranks), "at").withColumn(
            "_x", _gather("_x", "_order")
        )
    wide = (
        wide.withColumn("_groups", split_groups(F.col("_x"), group_size))
        .withColumn(
            "scales", F.when(F.col("_x").isNotNull(), F.transform("_groups", lambda g: _abs_max(g) / qmax))
        )
        .withColumn(
            "codes",
            F.flatten(
                F.zip_with(
                    "_groups",
                    _divisors("scales"),
                    lambda g, d: F.transform(g, lambda x: code(x, d)),
                )
            ),
        )
    )
    if order == "importance":
        wide = with_channels(wide, "_ranks", ranks, "rank").withColumn(
            "codes", _gather("codes", "_ranks")
        )
    columns = [c for c in df.columns if c not in ("codes", "scales")]
    return wide.select(*columns, "codes", "scales")


def dequantize(
    df: DataFrame,
    name: str = "decoded",
    group_size: int | None = None,
    ranks: DataFrame | None = None,
    scales: DataFrame | None = None,
) -> DataFrame:
    """Adds the floats that codes and scales stand for.

    Give ``group_size`` for groups, ``ranks`` (``importance`` of the statistics) as well for
    groups in order of importance, and ``scales`` (``channel_scales``) for per-channel codes.
    """
    codes = F.col("codes")
    if scales is not None:
        df = with_channels(df, "_channels", scales, "scale")
        decoded = F.zip_with(codes, "_channels", lambda c, s: c * s)
    elif ranks is not None:
        if group_size is None:
            raise ValueError("ranks need a group_size")
        group = F.floor(F.col("rank") / group_size).cast("int")
        df = with_channels(df, "_channels", ranks, group)
        decoded = F.zip_with(codes, _gather("scales", "_channels"), lambda c, s: c * s)
    else:
        decoded = F.flatten(
            F.zip_with(
                split_groups(codes, group_size), "scales", lambda g, s: F.transform(g, lambda c: c * s)
            )
        )
    return df.withColumn(name, decoded).drop("_channels")


def _fp8_step(y: Column) -> Column:
    """Distance of the E4M3 values around y; below the smallest normal it stays the same."""
    exponent = F.greatest(F.floor(F.log2(F.abs(y))), F.lit(FP8_MIN_EXPONENT))
    return F.pow(F.lit(2.0), exponent - FP8_MANTISSA_BITS)


def _to_fp8(y: Column, step: Column) -> Column:
    """The E4M3 value next to y, half to even."""
    near = F.rint(y / step) * step
    clipped = F.greatest(F.least(near, F.lit(FP8_MAX)), F.lit(-FP8_MAX))
    return F.when(y == 0, F.lit(0.0)).otherwise(clipped)


def fp8_codes(
    df: DataFrame, vec: str, per: str = "row", stats: DataFrame | None = None
) -> DataFrame:
    """Adds ``codes``, the E4M3 values as doubles, and per row their ``scales``.

    A vector that holds a null, a NaN or an infinite value has null codes and scales.
    ``channel`` takes one scale per dimension from ``stats``; read them with
    ``channel_scales(stats, FP8_MAX)``. ``dequantize`` turns either back.
    """

    wide = df.withColumn("_x", finite(F.col(vec)))
    if per == "channel":
        stats = channel_stats(df, vec) if stats is None else stats
        wide = with_channels(wide, "_scales", channel_scales(stats, FP8_MAX), "scale")
        wide = wide.withColumn("_y", F.zip_with("_x", _divisors("_scales"), lambda x, d: x / d)).drop("_scales")
    elif per == "row":
        of_row = F.zip_with(
            F.array("_x"), _divisors("scales"), lambda g, d: F.transform(g, lambda x: x / d)
        )
        scale = F.when(F.col("_x").isNotNull(), F.array(_abs_max(F.col("_x")) / FP8_MAX))
        wide = wide.withColumn("scales", scale).withColumn(
            "_y", F.flatten(of_row)
        )
    else:
        raise ValueError(f"unknown per {per!r}")
    return (
        wide.withColumn("_steps", F.transform("_y", _fp8_step))
        .withColumn("codes", F.zip_with("_y", "_steps", _to_fp8))
        .drop("_x", "_y", "_steps")
    )
