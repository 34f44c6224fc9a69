import hashlib

import pytest
from pyspark.sql import functions as F

from calibrel.operators import sampling
from calibrel.operators.assemble import assemble, mark_last_part, truncate_parts
from calibrel.operators.sampling import first_conversations, peek, sample_conversations, sample_n, sample_rows


def brute(keys, n, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))[:n]


@pytest.mark.parametrize("partitions", [1, 7, 23])
def test_sample_does_not_depend_on_partitions(spark, partitions):
    df = spark.range(1000).repartition(partitions)
    found = [r["id"] for r in sample_n(df, "id", 30).collect()]
    assert sorted(found) == sorted(brute(range(1000), 30))


@pytest.mark.parametrize("n", [0, 1, 99, 4000, 20000, 30000])
def test_sketches_take_the_same_rows_as_sorting(spark, monkeypatch, n):
    monkeypatch.setattr(sampling, "FAN_IN", 3)
    df = spark.range(20000).repartition(11)
    found = sorted(r["id"] for r in sample_n(df, "id", n, on_short="truncate").collect())
    assert found == sorted(brute(range(20000), n))


def test_rows_without_a_key_are_never_taken(spark, monkeypatch):
    df = spark.createDataFrame([(i if i % 3 else None, i) for i in range(90)], "k long, i long")
    for fan_in in (2, 64):
        monkeypatch.setattr(sampling, "FAN_IN", fan_in)
        assert sorted(r["k"] for r in sample_n(df, "k", 20).collect()) == sorted(
            brute([i for i in range(90) if i % 3], 20)
        )
        assert sample_n(df, "k", 70, on_short="truncate").count() == 60
        with pytest.raises(ValueError, match="61 rows asked for, 60 found"):
            sample_n(df, "k", 61)


def test_a_sample_gathers_nothing(spark):
    plan = sample_n(spark.range(5000), "id", 30)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_rows_of_one_key_are_taken_together(spark):
    rows = [(k, copy) for k in range(300) for copy in range(1 + 40 * (k % 50 == 0))]
    df = spark.createDataFrame(rows, "k long, copy long").repartition(9)
    taken = set(brute(range(300), 25))
    found = [(r["k"], r["copy"]) for r in sample_n(df, "k", 25).collect()]
    assert sorted(found) == sorted(r for r in rows if r[0] in taken)


def test_a_bound_is_found_in_one_scan(spark, tmp_path):
    spark.range(500).write.parquet(str(tmp_path / "keys"))
    df = spark.read.parquet(str(tmp_path / "keys"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("bound", "one scan")
    sampling.sample_bound(df, "id", 40)
    jobs = tracker.getJobIdsForGroup("bound")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2


def test_short_table(spark):
    with pytest.raises(ValueError, match="10 rows asked for, 5 found"):
        sample_n(spark.range(5), "id", 10)
    assert sample_n(spark.range(5), "id", 10, on_short="truncate").count() == 5
    with pytest.raises(ValueError):
        sample_n(spark.range(5), "id", 1, on_short="other")


def test_filter_after_sample_does_not_refill(spark):
    taken = set(brute(range(100), 20))
    found = {r["id"] for r in sample_n(spark.range(100), "id", 20).filter("id % 2 = 0").collect()}
    assert found == {i for i in taken if i % 2 == 0}


def turns_of(spark, lengths):
    rows = [(c, t, "user", f"{c}.{t}") for c, n in lengths.items() for t in range(n)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_sampled_conversations_are_whole(spark):
    turns = turns_of(spark, {c: 1 + c % 5 for c in range(50)})
    found = sample_conversations(turns, 10).groupBy("conv_id").count().collect()
    assert sorted(r["conv_id"] for r in found) == sorted(brute(range(50), 10))
    assert all(r["count"] == 1 + r["conv_id"] % 5 for r in found)
    arrays = assemble(turns, "chat")
    assert {r["conv_id"] for r in sample_rows(arrays, "conv_id", 10).collect()} == set(
        brute(range(50), 10)
    )


def test_assemble_splits_a_long_conversation(spark):
    turns = turns_of(spark, {1: 1000, 2: 3}).repartition(5)
    parts = assemble(turns, "chat", part_turns=64).orderBy("conv_id", "part").collect()
    assert max(len(p["conversations"]) for p in parts) == 64
    texts = [t["content"] for p in parts if p["conv_id"] == 1 for t in p["conversations"]]
    assert texts == [f"1.{t}" for t in range(1000)]
    assert [t["content"] for t in parts[-1]["conversations"]] == ["2.0", "2.1", "2.2"]


def test_assemble_shapes(spark):
    turns = turns_of(spark, {1: 1})
    share = assemble(turns).first()["conversations"][0]
    chat = assemble(turns, "chat").first()["conversations"][0]
    assert (share["from"], share["value"], share["role"]) == ("user", "1.0", None)
    assert (chat["role"], chat["content"], chat["from"]) == ("user", "1.0", None)


def test_last_part(spark):
    parts = mark_last_part(assemble(turns_of(spark, {1: 7, 2: 2}), part_turns=3))
    closing = {(r["conv_id"], r["part"]) for r in parts.collect() if r["closes"]}
    assert closing == {(1, 2), (2, 0)}


@pytest.mark.parametrize("cut", [1, 5, 17, 1000])
def test_truncation_runs_through_parts(spark, cut):
    parts = {"a": [[1, 2, 3], [], [4], [5, 6, 7, 8]], "b": [[9] * 40], "c": [[], [1]], "d": [[]]}
    parts["hot"] = [[i, i] for i in range(300)]
    rows = [(k, i, ids, len(ids)) for k, ps in parts.items() for i, ids in enumerate(ps)]
    df = spark.createDataFrame(rows, "conv_id string, part long, ids array<int>, n long").repartition(5)
    for fan_in in (2, 7, 64):
        found = truncate_parts(df, "ids", cut, facts=[F.sum("n").alias("n")], fan_in=fan_in).collect()
        assert {r["conv_id"]: r["ids"] for r in found} == {k: sum(ps, [])[:cut] for k, ps in parts.items()}
        assert {r["conv_id"]: r["n"] for r in found} == {k: len(sum(ps, [])) for k, ps in parts.items()}


def test_peek(spark):
    first = peek(assemble(turns_of(spark, {5: 4, 3: 4})), "conv_id", turns=2).collect()
    assert len(first) == 1 and first[0]["conv_id"] == 3
    assert [t["value"] for t in first[0]["conversations"]] == ["3.0", "3.1"]
    assert peek(spark.range(9), "id", 3).count() == 3
    parts = assemble(turns_of(spark, {5: 4, 3: 9}), "chat", part_turns=2).repartition(7)
    assert [r["part"] for r in peek(parts, "conv_id", 3).collect()] == [0, 1, 2]
    assert {r["conv_id"] for r in first_conversations(turns_of(spark, {5: 4, 3: 4}), 1).collect()} == {3}
