import pytest
from pyspark.sql import functions as F

from calibrel.functions import (
    CHATML,
    ROLE_HEADERS,
    artifact_name,
    convert,
    dropped_turns,
    map_role,
    pad_fallback,
    render,
)
from calibrel.functions.chat import MIXED_TURNS
from calibrel.sources import parse_conversations


def mixed(spark, turns):
    rows = [([{**dict.fromkeys(("from", "value", "role", "content")), **t} for t in turns],)]
    return spark.createDataFrame(rows, f"conversations {MIXED_TURNS}")


def chat(spark, turns, mode="lenient"):
    found = mixed(spark, turns).select(convert(F.col("conversations"), mode).alias("chat")).first()
    return [tuple(t) for t in found["chat"]]


def test_lenient_takes_each_branch(spark):
    turns = [
        {"from": "human", "value": "a"},
        {"from": "narrator", "value": "b"},
        {"role": "tool", "content": "c"},
        {"from": "gpt", "value": "d", "role": "user", "content": "ignored"},
        {"from": "gpt", "role": "user", "content": "e"},
        {"from": "gpt"},
        {},
    ]
    assert chat(spark, turns) == [
        ("user", "a"), ("narrator", "b"), ("tool", "c"), ("assistant", "d"), ("user", "e"),
    ]
    dropped = mixed(spark, turns).select(dropped_turns(F.col("conversations"))).first()[0]
    assert dropped == 2


def test_strict_maps_three_roles(spark):
    turns = [{"from": f, "value": f} for f in ("system", "human", "gpt")]
    assert [r for r, _ in chat(spark, turns, "strict")] == ["system", "user", "assistant"]


@pytest.mark.parametrize("turn", [{"from": "user", "value": "x"}, {"role": "user"}, {"from": "gpt"}])
def test_strict_fails_on_other_turns(spark, turn):
    with pytest.raises(Exception, match="unknown role|without value"):
        chat(spark, [turn], "strict")


def test_lenient_role_passes_through(spark):
    df = spark.createDataFrame([("human",), ("user",), ("tool",)], "r string")
    assert [r[0] for r in df.select(map_role(F.col("r"))).collect()] == ["user", "user", "tool"]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        convert(F.lit(None), "other")


def test_broken_json_is_null(spark):
    df = spark.createDataFrame([("{bad",), ('[{"from":"gpt","value":"x"}]',)], "raw string")
    found = [r[0] for r in df.select(parse_conversations(F.col("raw"))).collect()]
    assert found[0] is None and found[1][0]["value"] == "x" and found[1][0]["role"] is None


def text(spark, turns, layout, **options):
    df = spark.createDataFrame([(turns,)], "chat array<struct<role:string,content:string>>")
    return df.select(render(F.col("chat"), layout, **options)).first()[0]


def test_layouts(spark):
    turns = [("user", " hi　\n"), ("assistant", "yo")]
    assert text(spark, turns, ROLE_HEADERS) == (
        "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|>"
        "<|start_header_id|>assistant<|end_header_id|>\n\nyo<|eot_id|>"
    )
    assert text(spark, turns, CHATML, add_generation_prompt=True) == (
        "<|im_start|>user\n hi　\n<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
        "<|im_start|>assistant\n"
    )


def test_strip_removes_what_python_removes(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    for layout_text in ("".join(spaces) + "a b" + "".join(spaces),):
        found = text(spark, [("user", layout_text)], ROLE_HEADERS)
        assert found.split("\n\n", 1)[1] == layout_text.strip() + "<|eot_id|>"


def test_null_content_gives_null_text(spark):
    assert text(spark, [("user", "a"), ("assistant", None)], CHATML) is None
    assert text(spark, None, CHATML) is None
    assert text(spark, [], ROLE_HEADERS) == "<|begin_of_text|>"


def test_parts_open_and_close_once(spark):
    turns = [("user", "a")]
    inner = text(spark, turns, ROLE_HEADERS, add_generation_prompt=True,
                 opens=F.lit(False), closes=F.lit(False))
    assert inner == "<|start_header_id|>user<|end_header_id|>\n\na<|eot_id|>"


def test_names(spark):
    df = spark.createDataFrame([("org/model",), ("model",), ("a/b/c",)], "id string")
    found = [r[0] for r in df.select(artifact_name(F.col("id"), "-W8A8")).collect()]
    assert found == ["model-W8A8", None, "b-W8A8"]
    pads = spark.createDataFrame([(None, "e"), ("p", "e")], "pad string, eos string")
    assert [r[0] for r in pads.select(pad_fallback(F.col("pad"), F.col("eos"))).collect()] == ["e", "p"]
