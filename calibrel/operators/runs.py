"""Summaries and comparison of compression runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Modules that share one forward pass.
STAGES = {
    "k_proj": "kvq",
    "v_proj": "kvq",
    "q_proj": "kvq",
    "o_proj": "o",
    "up_proj": "up_gate",
    "gate_proj": "up_gate",
    "down_proj": "down",
}


def stage_of(module: Column) -> Column:
    """The forward pass a module belongs to; an unlisted module has its own."""
    last = F.substring_index(module, ".", -1)
    stage = last
    for name, group in STAGES.items():
        stage = F.when(last == name, F.lit(group)).otherwise(stage)
    return stage


def run_summary(logs: DataFrame) -> DataFrame:
    """Per run, start and layer: modules, time, forward time, largest loss and damping.

    Modules of one stage repeat the forward time of their shared pass, so it counts once
    per stage. Records that could not be parsed are left out; runs of one name are told apart
    by their start.
    """
    stages = logs.filter(F.col("bad_record").isNull()).groupBy("run", "started", "layer", stage_of(F.col("module")).alias("stage")).agg(
        F.count(F.lit(1)).alias("modules"),
        F.sum("time").alias("time"),
        F.max("fwd_time").alias("fwd_time"),
        F.max("loss").alias("max_loss"),
        F.max("damp").alias("max_damp"),
    )
    return stages.groupBy("run", "started", "layer").agg(
        F.sum("modules").alias("modules"),
        F.sum("time").alias("time"),
        F.sum("fwd_time").alias("fwd_time"),
        F.max("max_loss").alias("max_loss"),
        F.max("max_damp").alias("max_damp"),
    )


def run_compare(logs: DataFrame, left: str, right: str) -> DataFrame:
    """Loss and time of two runs side by side per layer and module, null where a run has none.

    The same rows as a full outer join of the runs, in one scan and one aggregation, which
    also holds where a run repeats a module: its largest loss and its summed time count.
    """

    def of(run: str, value: str) -> Column:
        return F.when(F.col("run") == run, F.col(value))

    return (
        logs.filter(F.col("run").isin(left, right) & F.col("bad_record").isNull())
        .groupBy("layer", "module")
        .agg(
            F.max(of(left, "loss")).alias("left_loss"),
            F.max(of(right, "loss")).alias("right_loss"),
            F.sum(of(left, "time")).alias("left_time"),
            F.sum(of(right, "time")).alias("right_time"),
        )
        .withColumn("loss_change", F.col("right_loss") - F.col("left_loss"))
    )
