import glob
import os

import pytest
from pyspark.sql import functions as F

from calibrel.operators.codes import int_codes
from calibrel.operators.stats import channel_stats
from calibrel.session import scratch_path
from calibrel.sinks import write_calibration, write_codes, write_sharded, write_text
from calibrel.sources import read_conversations


def test_text_is_followed_by_a_newline_each(spark, tmp_path):
    texts = ["a\nb", "", "é", "x" * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    write_text(df, str(tmp_path / "one"), order_by=("i",), single_file=True)
    files = glob.glob(str(tmp_path / "one" / "part-*"))
    assert len(files) == 1
    assert open(files[0], encoding="utf-8").read() == "".join(t + "\n" for t in texts)
    write_text(df, str(tmp_path / "many"), order_by=("i",))
    files = sorted(glob.glob(str(tmp_path / "many" / "part-*")))
    assert "".join(open(f, encoding="utf-8").read() for f in files) == "".join(t + "\n" for t in texts)


def test_calibration_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [3, 4])], "conv_id long, input_ids array<int>")
    write_calibration(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).collect() == df.collect()
    write_calibration(df, str(tmp_path / "d"), required=True)
    with pytest.raises(ValueError, match="no valid"):
        write_calibration(df.limit(0), str(tmp_path / "e"), required=True)


@pytest.mark.parametrize("large", [0, 3])
def test_no_shard_exceeds_the_bound(spark, tmp_path, large):
    size = F.when(F.col("id") < large, 40_000).otherwise(100 + F.col("id") % 50)
    df = spark.range(3000).coalesce(2).select("id", F.repeat(F.lit("x"), size.cast("int")).alias("t"))
    path = str(tmp_path / "s")
    limit = 50_000
    write_sharded(df, path, limit)
    back = spark.read.parquet(path)
    assert back.count() == 3000 and back.agg(F.sum(F.length("t"))).first() == df.agg(F.sum(F.length("t"))).first()
    files = back.groupBy(F.col("_metadata.file_path").alias("f")).agg(
        F.sum(F.length("t") + 8).alias("bytes"), F.count("*").alias("n")
    )
    rows = files.collect()
    assert len(rows) > 5 and max(r["bytes"] for r in rows) <= limit
    small = sorted(r["bytes"] for r in rows if r["n"] > 1)
    # all but the last one are full
    assert all(size > 0.9 * limit for size in small[1:])


def test_a_row_over_the_bound_has_its_own_file(spark, tmp_path):
    rows = [("x" * n,) for n in [10] * 50 + [900, 2000]]
    path = str(tmp_path / "s")
    write_sharded(spark.createDataFrame(rows, "t string").coalesce(1), path, 1000)
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(
        F.sum(F.length("t")).alias("bytes"), F.count("*").alias("n")
    ).collect()
    assert sum(r["n"] for r in files) == 52
    assert [r["n"] for r in files if r["bytes"] > 1000] == [1]
    write_sharded(spark.createDataFrame([], "t string"), str(tmp_path / "empty"), 50)
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0


def test_a_path_is_written_once(spark, tmp_path):
    path = str(tmp_path / "s")
    write_sharded(spark.range(10), path, 40)
    with pytest.raises(FileExistsError):
        write_sharded(spark.range(10), path, 40)
    assert spark.read.parquet(path).count() == 10 and os.listdir(tmp_path) == ["s"]


def test_sharding_works_the_input_out_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(n):
        calls.add(1)
        return "x" * n

    sizes = [(10,)] * 40 + [(900,), (5000,)]
    df = spark.createDataFrame(sizes, "n int").select(text("n").alias("t"))
    write_sharded(df, str(tmp_path / "s"), 1000)
    assert calls.value == 42


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(5).select(F.raise_error(F.lit("stop")).cast("string").alias("t"))
    with pytest.raises(Exception, match="stop"):
        write_sharded(df, str(tmp_path / "s"), 100)
    assert not os.path.exists(tmp_path / "s")


def test_nested_rows_are_measured(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, [("ab", "cde")], [1, 2], {"k": "vv"}, None)],
        "i int, c array<struct<role:string,content:string>>, ids array<int>, m map<string,string>, n string",
    )
    from calibrel.sinks.files import row_bytes

    assert df.select(row_bytes(df)).first()[0] == 8 + 5 + 8 + 3


def test_written_codes_have_no_floats(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, -1.0]), (2, [0.25, 3.0])], "id int, v array<float>")
    stats = channel_stats(df, "v")
    path = str(tmp_path / "q")
    write_codes(int_codes(df, "v", per="channel", stats=stats), path, "v", {"stats": stats})
    rows = spark.read.parquet(f"{path}/rows")
    assert dict(rows.dtypes) == {"id": "int", "codes": "array<tinyint>"}
    assert spark.read.parquet(f"{path}/stats").count() == 2


def test_splits_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).withColumn("split", F.when(F.col("id") < 3, "test").otherwise("train")).write.partitionBy("split").parquet(path)
    found = read_conversations(spark, path, "test")
    assert found.count() == 3 and len(found.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(split" in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="schema"):
        read_conversations(spark, path, format="json")


class Stub:
    """What scratch_path looks at in a session."""

    def __init__(self, folder, master):
        settings = {"spark.checkpoint.dir": folder}
        self.conf = type("Conf", (), {"get": staticmethod(lambda n, d: settings.get(n) or d)})
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "a"})


def test_scratch_folder_is_the_configured_one():
    cluster = Stub("hdfs://shared/tmp/", "spark://host:7077")
    first, second = scratch_path(cluster, "x"), scratch_path(cluster, "x")
    assert first.startswith("hdfs://shared/tmp/x-") and first != second
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(Stub(None, "spark://host:7077"), "x")
    local = Stub(None, "local[2]")
    assert os.path.dirname(scratch_path(local, "x")) == os.path.dirname(scratch_path(local, "y"))
