"""Logs of compression runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrel.sources.records import read_objects

# Log names, and the fields of a record.
RUN_NAME = r"(?<=_log_)[^/]+(?=_time_\d{2}_\d{2}_\d{4}_\d{2}h_\d{2}m_\d{2}s\.log)"
RUN_STAMP = r"(?<=_time_)\d{2}_\d{2}_\d{4}_\d{2}h_\d{2}m_\d{2}s(?=\.log)"
RUN_TIME = "MM_dd_yyyy_HH'h'_mm'm'_ss's'"
STAGE_STAMP = r"\d{2}-\d{2}-\d{4}_\d{2}\.\d{2}\.\d{2}(?=\.log)"
STAGE_TIME = "dd-MM-yyyy_HH.mm.ss"
STAGE_LINE = r"^\s*manager stage:\s*(.*?)\s*$"
#: Names of files that are sent to all executors.
FILES_SENT = 100_000
RECORD = (
    "process string, layer int, module string, loss string, samples string, damp string, "
    "time string, fwd_time string"
)


def _from_path(pattern: str, path: str = "_metadata.file_path") -> Column:
    """A piece of the log's name, which is its file or a folder of part files."""
    return F.regexp_substr(path, F.lit(pattern))


def _run(path: str = "_metadata.file_path") -> dict[str, Column]:
    started = F.to_timestamp_ntz(_from_path(RUN_STAMP, path), F.lit(RUN_TIME))
    return {"run": _from_path(RUN_NAME, path), "started": started}


def _with_runs(texts: DataFrame, path: str) -> DataFrame:
    """Adds ``run`` and ``started``, read from the name once per file where the files are few enough to send along."""
    files = texts.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = files.select(F.col("_metadata.file_path").alias("file")).withColumns(_run("file"))
    if names.limit(FILES_SENT + 1).count() > FILES_SENT:
        return texts.withColumns(_run("file"))
    return texts.join(F.broadcast(names), "file", "left")


def read_run_logs(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    """Records of run logs: JSON objects one after the other, in any layout.

    ``only`` is a condition on ``run`` and ``started``; the files of other runs are not read. A record
    that cannot be parsed is kept in ``bad_record``, a number that cannot be read is null. See
    ``records.read_objects`` for how files are cut.
    """
    texts = read_objects(spark, path, only, **_run())
    parsed = _with_runs(texts, path).withColumn("record", F.from_json("record_text", RECORD))
    record = F.col("record")
    return parsed.select(
        "run",
        "started",
        record["process"].alias("process"),
        record["layer"].alias("layer"),
        record["module"].alias("module"),
        record["loss"].try_cast("double").alias("loss"),
        record["samples"].try_cast("int").alias("samples"),
        record["damp"].try_cast("double").alias("damp"),
        record["time"].try_cast("double").alias("time"),
        record["fwd_time"].try_cast("double").alias("fwd_time"),
        F.when(record["module"].isNull(), F.col("record_text")).alias("bad_record"),
    )


def read_stage_logs(spark: SparkSession, path: str) -> DataFrame:
    """``(started, stage)`` of the stage lines; the file name holds a day-first time."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.to_timestamp_ntz(_from_path(STAGE_STAMP), F.lit(STAGE_TIME)).alias("started"),
            F.nullif(F.regexp_extract("value", STAGE_LINE, 1), F.lit("")).alias("stage"),
        )
        .filter(F.col("stage").isNotNull())
    )
