from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from calibrel.functions import CHATML, LABELS, as_turns
from calibrel.functions.chat import MIXED_TURNS
from calibrel.operators.assemble import assemble
from calibrel.operators.vocabulary import build_vocabulary
from calibrel.plans.calibration import (
    PRESETS,
    Calibration,
    calibration_ids,
    calibration_texts,
    calibration_tokens,
    conversation_facts,
    take_sample,
    with_facts,
    with_text,
)
from calibrel.sinks import write_text

CHAT = Calibration(mode="as_is", layout=CHATML)


@pytest.fixture(scope="module")
def turns(spark):
    lengths = {1: 9, 2: 1, 3: 2, 4: 30, 5: 5}
    rows = [
        (c, t, "user" if t % 2 == 0 else "assistant", f"word{t} of {c}, and more!")
        for c, n in lengths.items()
        for t in range(n)
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").cache()


def collected(df, column):
    return {r["conv_id"]: r[column] for r in df.collect()}


@pytest.mark.parametrize("size", [1, 2, 7])
def test_parts_and_whole_rows_agree(turns, size):
    whole = assemble(turns, "chat").drop("part", "start")
    parts = assemble(turns, "chat", part_turns=size)
    for cut in (1, 10, 64, 10_000):
        options = replace(CHAT, max_length=cut)
        assert collected(calibration_tokens(parts, options), "tokens") == collected(
            calibration_tokens(whole, options), "tokens"
        )
    texts = {}
    for r in sorted(calibration_texts(parts, CHAT).collect(), key=lambda r: r["part"]):
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["text"]
    assert texts == collected(calibration_texts(whole, CHAT), "text")


@pytest.mark.parametrize("size", [1, 3, 100])
def test_filters_look_at_whole_conversations(turns, size):
    # ten tokens a turn and the begin token: the limit is just what five turns have
    options = replace(CHAT, least_turns=2, least_tokens=51, on_error="skip", extra_bos="<s>")
    whole = assemble(turns, "chat").drop("part", "start")
    parts = assemble(turns, "chat", part_turns=size)
    reasons = collected(conversation_facts(whole, options), "reason")
    assert reasons == {1: "ok", 2: "few_turns", 3: "short", 4: "ok", 5: "ok"}
    assert collected(conversation_facts(parts, options), "reason") == reasons
    assert collected(conversation_facts(parts, options), "n_tokens") == collected(
        conversation_facts(whole, options), "n_tokens"
    )
    kept = {r["conv_id"] for r in calibration_texts(parts, options).collect()}
    assert kept == {r["conv_id"] for r in calibration_texts(whole, options).collect()} == {1, 4, 5}


def letters(text):
    return F.transform(F.split(F.regexp_replace(text, r"\s", ""), ""), lambda c: F.ascii(c))


@pytest.mark.parametrize("size", [2, 100])
def test_ids_of_both_tokenizers(spark, turns, size):
    parts = assemble(turns, "chat", part_turns=size)
    options = replace(CHAT, max_length=50)
    tokens = with_facts(parts, options).select(F.explode("tokens").alias("token"))
    ids = calibration_ids(parts, options, build_vocabulary(tokens))
    assert ids.columns == ["conv_id", "input_ids", "attention_mask"]
    for r in ids.collect():
        assert len(r["input_ids"]) == len(r["attention_mask"]) <= 50
        assert min(r["input_ids"]) >= 0 and set(r["attention_mask"]) == {1}
    whole = assemble(turns, "chat").drop("part", "start")
    texts = collected(with_text(whole, CHAT), "text")
    own = replace(options, tokenizer=letters)
    found = collected(calibration_ids(parts, own), "input_ids")
    assert found == {k: [ord(c) for c in "".join(t.split())][:50] for k, t in texts.items()}
    assert collected(calibration_ids(whole, own), "input_ids") == found
    with pytest.raises(ValueError):
        calibration_ids(parts, options)


@pytest.mark.parametrize("size", [2, 100])
def test_the_length_is_that_of_the_tokenizer_in_use(turns, size):
    whole = assemble(turns, "chat").drop("part", "start")
    lengths = {k: len("".join(t.split())) for k, t in collected(with_text(whole, CHAT), "text").items()}
    limit = sorted(lengths.values())[2]
    options = replace(CHAT, max_length=None, least_tokens=limit, on_error="skip", tokenizer=letters)
    for rows in (whole, assemble(turns, "chat", part_turns=size)):
        kept = calibration_ids(rows, options).collect()
        assert {r["conv_id"] for r in kept} == {k for k, n in lengths.items() if n >= limit}


@pytest.fixture(scope="module")
def long_turns(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"w{t}\nof {c}") for c, n in {1: 600, 2: 4}.items() for t in range(n)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").cache()


def forms(turns, column="conversations"):
    """One table as parts of several sizes and as arrays."""
    for size in (7, 256):
        yield assemble(turns, "chat", part_turns=size)
    yield arrays(turns)


def arrays(turns):
    turn = F.struct("turn", as_turns("chat", F.col("role"), F.col("text")).alias("element"))
    placed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("placed"))
    return placed.select("conv_id", F.col("placed.element").alias("conversations"))


@pytest.mark.parametrize("layout,least", [(CHATML, 0), (LABELS, 5)])
def test_one_result_whatever_the_length(long_turns, tmp_path, layout, least):
    options = replace(CHAT, layout=layout, max_length=None, least_turns=least, on_error="skip")
    results, files = [], []
    for k, rows in enumerate(forms(long_turns)):
        texts = calibration_texts(rows, options)
        ids = calibration_ids(rows, replace(options, tokenizer=letters), begin=-1, end=-2)
        facts = conversation_facts(rows, options).select("conv_id", "n_turns", "n_tokens", "digest", "reason")
        results.append([sorted(map(tuple, t.collect())) for t in (texts, ids.drop("attention_mask"), facts)])
        write_text(texts, str(tmp_path / str(k)), order_by=("conv_id",), single_file=True)
        (file,) = (tmp_path / str(k)).glob("part-*")
        files.append(file.read_bytes())
    assert all(r == results[0] for r in results) and len(results[0][0]) == (3 if least else 3 + 1)
    assert set(files) == {files[0]}
    whole = collected(with_text(arrays(long_turns), options), "text")
    kept = [whole[k] for k in sorted(whole) if k == 1 or not least]
    assert files[0].decode() == "".join(t + "\n" for t in kept)
    (ids,) = (r[1] for r in results[0][1] if r[0] == 1)
    assert len(results[0][1]) == (1 if least else 2)
    assert ids == [-1, *(ord(c) for c in "".join(whole[1].split())), -2]
    assert ids[0] == -1 and ids[-1] == -2 and ids.count(-1) == ids.count(-2) == 1


@pytest.mark.parametrize("size", [1, 3])
def test_lines_run_over_the_borders_of_parts(spark, tmp_path, size):
    texts = ["a", "", "b\nc", "\n", "d\n", "\n\ne", "f", "\ng\nh\ni"]
    rows = [(c, p, t) for c in (1, 2) for p, t in enumerate(texts[: 8 if c == 1 else size])]
    parts = spark.createDataFrame(rows, "conv_id long, part long, text string").repartition(4)
    write_text(parts, str(tmp_path / "t"), order_by=("conv_id",), single_file=True)
    (file,) = (tmp_path / "t").glob("part-*")
    assert file.read_text() == "".join(texts) + "\n" + "".join(texts[:size]) + "\n"


def test_a_conversation_that_cannot_be_rendered(spark):
    rows = [(1, [(None, None, "user", None), (None, None, "user", "x")]), (2, None)]
    df = spark.createDataFrame(rows, f"conv_id long, conversations {MIXED_TURNS}")
    skip = replace(CHAT, on_error="skip")
    assert collected(conversation_facts(df, skip), "reason") == {1: "error", 2: "missing"}
    with pytest.raises(Exception, match="cannot be rendered"):
        calibration_texts(df, CHAT).collect()


def test_every_sampled_row_is_accounted_for(turns):
    options = replace(PRESETS["gptq_text"], n=4, mode="as_is")
    rows = take_sample(turns, options, shape="chat")
    assert conversation_facts(rows, options).count() == 4
    with pytest.raises(ValueError, match="9 rows asked for, 5 found"):
        take_sample(turns, replace(options, n=9))


def test_other_columns_stay_with_the_text(turns):
    rows = assemble(turns, "chat").withColumn("source", F.lit("s"))
    assert {"source", "text", "conversations"} <= set(with_text(rows, CHAT).columns)


def test_only_sampled_rows_are_rendered(turns):
    rows = take_sample(turns, replace(CHAT, n=2), shape="chat")
    plan = calibration_texts(rows, CHAT)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    render = next(i for i, line in enumerate(lines) if "im_start" in line)
    fetch = max(i for i, line in enumerate(lines) if "<= " in line and "md5" in line)
    assert render < fetch and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_row_functions_work_on_a_stream(spark, turns, tmp_path):
    path = str(tmp_path / "in")
    nested = assemble(turns, "chat").drop("part", "start")
    nested.write.parquet(path)
    stream = spark.readStream.schema(nested.schema).parquet(path)
    texts = calibration_texts(stream, replace(CHAT, least_turns=2, on_error="skip"))
    query = (
        texts.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    options = replace(CHAT, least_turns=2, on_error="skip")
    assert collected(spark.read.parquet(str(tmp_path / "out")), "text") == collected(
        calibration_texts(nested, options), "text"
    )
