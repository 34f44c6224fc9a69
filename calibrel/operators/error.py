"""What a compressed vector column loses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrel.operators.codes import split_groups
from calibrel.operators.stats import with_channels


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def recon_error(
    df: DataFrame,
    original: str,
    decoded: str = "decoded",
    by: str = "total",
    key: str | None = None,
    group_size: int | None = None,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Mean squared error of the decoded vectors, per ``row``, per ``group`` or in ``total``.

    Vectors without codes count in no mean; a mean over nothing, or over weights that are all
    zero, is null.
    ``weights`` (``channel_stats``) weighs each dimension by its mean square.
    """
    errors = F.zip_with(
        F.col(original).cast("array<double>"), decoded, lambda a, b: (a - b) * (a - b)
    )
    if weights is None:
        weighed = df.withColumn("_shares", F.transform(decoded, lambda _: F.lit(1.0)))
    else:
        weighed = with_channels(df, "_shares", weights, F.coalesce("mean_sq", F.lit(0.0)))
        weighed = weighed.withColumn("_shares", F.when(F.col(decoded).isNotNull(), F.col("_shares")))
    measured = weighed.withColumn("_errors", F.zip_with(errors, "_shares", lambda e, w: e * w))
    if by == "row":
        mse = F.try_divide(_total(F.col("_errors")), _total(F.col("_shares")))
        return measured.select(*([key] if key else []), mse.alias("mse"))
    if by == "group":
        pairs = F.zip_with(
            split_groups(F.col("_errors"), group_size),
            split_groups(F.col("_shares"), group_size),
            lambda e, w: F.struct(_total(e).alias("e"), _total(w).alias("w")),
        )
        return (
            measured.select(F.posexplode(pairs).alias("grp", "pair"))
            .groupBy("grp")
            .agg(F.try_divide(F.sum("pair.e"), F.sum("pair.w")).alias("mse"))
        )
    if by != "total":
        raise ValueError(f"unknown by {by!r}")
    return measured.agg(
        F.try_divide(F.sum(_total(F.col("_errors"))), F.sum(_total(F.col("_shares")))).alias("mse")
    )
