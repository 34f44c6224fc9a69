"""Tokens of texts in pieces against one call on the whole text."""

import re
from dataclasses import replace

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StructType

from calibrel.functions import Layout, as_turns, tokenize
from calibrel.functions.tokens import batch_tokenizer, outcomes
from calibrel.operators.assemble import assemble
from calibrel.operators.long_texts import join_tokens, tokens_of_parts
from calibrel.plans.calibration import Calibration, calibration_ids, calibration_texts, conversation_facts

PAIRS = re.compile(r"[a-z ]{1,3}|[^a-z ]")


def pairs(text):
    return [hash_of(m[0]) for m in PAIRS.finditer(text)]


def hash_of(token):
    return sum((k + 1) * ord(c) for k, c in enumerate(token))


@arrow_udf(ArrayType(StructType().add("id", IntegerType()).add("end", IntegerType())))
def pair_ends(texts: pa.Array) -> pa.Array:
    import re

    pattern = re.compile(r"[a-z ]{1,3}|[^a-z ]")
    weigh = lambda token: sum((k + 1) * ord(c) for k, c in enumerate(token))
    kind = pa.list_(pa.struct([("id", pa.int32()), ("end", pa.int32())]))
    found = [
        None if t is None else [{"id": weigh(m[0]), "end": m.end()} for m in pattern.finditer(t)]
        for t in texts.to_pylist()
    ]
    return pa.array(found, kind)


def pair_ids(text):
    return F.transform(pair_ends(text), lambda s: s["id"])


def joined(tokens):
    return {r.k: r.tokens for r in join_tokens(tokens, "k", "tokens").collect()}


texts = st.lists(st.text(alphabet="abc .\n\té<|>", max_size=30), min_size=1, max_size=7)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(texts, min_size=1, max_size=12), st.sampled_from([4, 8, 16]))
def test_any_pieces_give_the_tokens_of_the_whole(spark, rows, overlap):
    parts = spark.createDataFrame(
        [(k, p, t) for k, pieces in enumerate(rows) for p, t in enumerate(pieces)], "k long, part long, text string"
    )
    want = {k: pairs("".join(pieces)) for k, pieces in enumerate(rows)}
    assert joined(tokens_of_parts(parts, "k", pair_ids)) == want
    assert joined(tokens_of_parts(parts, "k", pair_ids, pair_ends, overlap=overlap)) == want
    whole = spark.createDataFrame([(k, "".join(pieces)) for k, pieces in enumerate(rows)], "k long, text string")
    words = {r.k: r.tokens for r in whole.select("k", tokenize(F.col("text")).alias("tokens")).collect()}
    assert joined(tokens_of_parts(parts, "k", tokenize, blanks=True)) == words


def test_long_pieces_are_not_put_together(spark):
    # long enough pieces whose borders run through tokens; the windows alone must settle them
    whole = "".join(f"word number {k} and more. " for k in range(400))
    cuts = [0, 1001, 2503, 4444, 6002, len(whole)]
    pieces = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
    parts = spark.createDataFrame([(1, p, t) for p, t in enumerate(pieces)], "k long, part long, text string")
    refuse = lambda text: F.raise_error(F.lit("whole text")).cast("array<int>")
    assert joined(tokens_of_parts(parts, "k", refuse, pair_ends)) == {1: pairs(whole)}
    # a text without any border that both sides could agree on is one call
    flat = "ab" * 2000 + "a"
    parts = spark.createDataFrame([(1, p, flat[p * 901 : p * 901 + 901]) for p in range(5)], "k long, part long, text string")
    assert joined(tokens_of_parts(parts, "k", pair_ids, pair_ends)) == {1: pairs(flat)}


BARE = Layout("", "", "", "", "", writes_role=False)


@pytest.fixture(scope="module")
def turns(spark):
    rows = [
        (c, t, "user", f"turn{t % 7}word" + (". " if t % 5 == 0 else ""))
        for c, n in {1: 600, 2: 4, 3: 257}.items()
        for t in range(n)
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").cache()


@pytest.mark.parametrize("ends, length", [(None, None), (pair_ends, 300)])
def test_ids_of_a_conversation_are_those_of_one_call(spark, turns, ends, length):
    whole = {}
    for r in sorted(turns.collect(), key=lambda r: r.turn):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.text
    options = Calibration(mode="as_is", layout=BARE, max_length=length, tokenizer=pair_ids, token_ends=ends)
    turn = F.struct("turn", as_turns("chat", F.col("role"), F.col("text")).alias("element"))
    placed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("placed"))
    arrays = placed.select("conv_id", F.col("placed.element").alias("conversations"))
    for rows in (assemble(turns, "chat", part_turns=3), arrays):
        found = calibration_ids(rows, options)
        assert found.columns == ["conv_id", "input_ids", "attention_mask"]
        assert {r.conv_id: r.input_ids for r in found.collect()} == {k: pairs(t)[:length] for k, t in whole.items()}
        counted = conversation_facts(rows, replace(options, least_tokens=len(pairs(whole[3])), max_length=None))
        assert {r.conv_id: (r.n_tokens, r.reason) for r in counted.collect()} == {
            k: (len(pairs(t)), "short" if k == 2 else "ok") for k, t in whole.items()
        }


def fails_on_sevens():
    def picky(texts):
        for t in texts:
            if "7" in t:
                raise RuntimeError("no sevens")
        return [[len(t), ord(t[0])] for t in texts]

    return picky


def test_failures_are_isolated(spark):
    rows = [(k, None if k % 10 == 3 else f"text {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "k int, text string").coalesce(1)
    want = {k: None if t is None or "7" in t else [len(t), ord("t")] for k, t in rows}
    got = df.select("k", batch_tokenizer(fails_on_sevens(), isolate=True)(F.col("text")).alias("ids")).collect()
    assert {r.k: r.ids for r in got} == want
    why = {r.k: r.o for r in df.select("k", outcomes(fails_on_sevens())(F.col("text")).alias("o")).collect()}
    assert {k: o.error for k, o in why.items() if o.error} == {
        k: "RuntimeError: no sevens" for k, t in rows if t and "7" in t
    }
    fine = df.where("text NOT LIKE '%7%'")
    got = fine.select("k", batch_tokenizer(fails_on_sevens())(F.col("text")).alias("ids")).collect()
    assert {r.k: r.ids for r in got} == {k: want[k] for k, t in rows if t and "7" not in t}
    with pytest.raises(Exception, match="no sevens"):
        df.select(batch_tokenizer(fails_on_sevens())(F.col("text"))).collect()


@pytest.mark.parametrize("size", [1, 256])
def test_a_tokenizer_that_raises_costs_its_conversations_only(spark, size):
    rows = [(c, t, "user", f"{t} of {c}.") for c in range(1, 12) for t in range(3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    options = Calibration(mode="as_is", layout=BARE, on_error="skip", tokenizer=batch_tokenizer(fails_on_sevens(), isolate=True))
    parts = assemble(turns, "chat", part_turns=size)
    reasons = {r.conv_id: r.reason for r in conversation_facts(parts, options).collect()}
    assert reasons == {c: "error" if c == 7 else "ok" for c in range(1, 12)}
    assert {r.conv_id for r in calibration_ids(parts, options).collect()} == set(range(1, 12)) - {7}
    assert {r.conv_id for r in calibration_texts(parts, options).collect()} == set(range(1, 12)) - {7}
    with pytest.raises(Exception, match="cannot be tokenized"):
        calibration_ids(parts, replace(options, on_error="fail")).collect()
