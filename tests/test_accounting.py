import pytest
from pyspark.sql import functions as F

from calibrel.operators.accounting import (
    account,
    any_in,
    classify,
    frequency,
    merge_parts,
    observe_reasons,
)
from calibrel.operators.filters import (
    min_tokens,
    min_turns,
    name_contains,
    require_rows,
    select_targets,
)

FACTS = (
    "conv_id int, part int, missing boolean, failed boolean, n_turns int, dropped int, "
    "n_tokens int, digest bigint"
)


@pytest.fixture()
def facts(spark):
    rows = [
        (1, 0, True, True, None, None, None, None),
        (2, 0, False, True, 2, 0, None, None),
        (3, 0, False, False, 1, 1, 50, 1),
        (4, 0, False, False, 2, 0, 9, 2),
        (5, 0, False, False, 2, 0, 10, 3),
        # two parts that only together have two turns and ten tokens
        (6, 0, False, False, 1, 0, 6, 4),
        (6, 1, False, False, 1, 2, 6, 5),
        # one failed part spoils the conversation
        (7, 0, False, False, 4, 0, 60, 6),
        (7, 1, False, True, 4, 0, None, None),
    ]
    return spark.createDataFrame(rows, FACTS)


def test_reasons_in_order(facts):
    found = {r["conv_id"]: r["reason"] for r in classify(merge_parts(facts)).collect()}
    assert found == {1: "missing", 2: "error", 3: "few_turns", 4: "short", 5: "ok", 6: "ok", 7: "error"}


def test_length_is_tested_after_truncation(facts):
    found = classify(merge_parts(facts), least_tokens=10, max_length=8)
    assert {r["reason"] for r in found.collect()} == {"missing", "error", "few_turns", "short"}


def test_counts_add_up_and_can_be_observed(facts):
    classified = classify(merge_parts(facts))
    counts = {r["reason"]: r["n"] for r in account(classified).collect()}
    assert counts == {"missing": 1, "error": 2, "few_turns": 1, "short": 1, "ok": 2}
    observed, seen = observe_reasons(classified)
    observed.write.format("noop").mode("overwrite").save()
    assert seen.get == counts


def test_frequency_sorts_numbers_first(spark):
    devices = ["10", "cpu", "2", "disk", "cpu", "0", "2", None]
    df = spark.createDataFrame([(d,) for d in devices], "device string")
    found = [(r["device"], r["n"]) for r in frequency(df, "device").collect()]
    assert [f for f in found if f[0]] == [("0", 1), ("2", 2), ("10", 1), ("cpu", 2), ("disk", 1)]
    assert (None, 1) in found


def test_any_in(spark):
    df = spark.createDataFrame([("0",), (None,), ("cpu",)], "device string")
    assert any_in(df, "device", ["cpu", "disk"]).first()["found"] is True
    assert any_in(df, "device", ["disk"]).first()["found"] is False
    assert any_in(df.limit(0), "device", ["cpu"]).first()["found"] is False


def test_filters(spark):
    df = spark.createDataFrame([(1, [1] * 9), (2, [1] * 10), (3, None)], "k int, input_ids array<int>")
    assert [r["k"] for r in min_tokens(df).collect()] == [2]
    chats = df.withColumnRenamed("input_ids", "chat")
    assert [r["k"] for r in min_turns(chats, 10).collect()] == [2]
    names = spark.createDataFrame([("Tokenizer.JSON",), ("model",)], "name string")
    assert [r[0] for r in name_contains(names, "name", "TOKEN").collect()] == ["Tokenizer.JSON"]


def test_targets(spark):
    df = spark.createDataFrame(
        [("Linear", "lm_head"), ("Linear", "q"), ("Norm", "n"), ("Linear", None)], "kind string, name string"
    )
    found = {r["name"] for r in select_targets(df, "kind", "name", "Linear", ["lm_head"]).collect()}
    assert found == {"q", None}
    ignored = spark.createDataFrame([("lm_head",)], "name string")
    assert {r["name"] for r in select_targets(df, "kind", "name", "Linear", ignored).collect()} == found
    assert select_targets(df, "kind", "name", ["Linear", "Norm"]).count() == 4


def test_guard(spark):
    df = spark.range(3)
    assert require_rows(df) is df
    with pytest.raises(ValueError, match="no valid"):
        require_rows(df.filter(F.col("id") > 9))


def test_tested_columns_are_worked_out_once(spark):
    df = spark.createDataFrame([("a b c",)], "text string").select(
        F.split("text", " ").alias("input_ids")
    )
    plan = min_tokens(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1
    assert min_tokens(df, 2).count() == 1 and min_tokens(df, 4).count() == 0
