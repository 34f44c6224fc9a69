import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from calibrel.functions import CHATML, attention_mask, tokenize, truncate
from calibrel.functions.tokens import batch_tokenizer
from calibrel.operators.vocabulary import _blocks, build_vocabulary, decode, detokenize, encode, fits_workers
from calibrel.plans.calibration import Calibration, calibration_ids


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


def test_tokenize(spark):
    found = one(spark, "<|im_start|>user\nHéllo, wörld2!", "string", tokenize)
    assert found == ["<|im_start|>", "user", "Héllo", ",", "wörld2", "!"]
    assert one(spark, "", "string", tokenize) == []
    assert one(spark, None, "string", tokenize) is None
    assert one(spark, "a", "string", lambda c: tokenize(c, bos="<s>")) == ["<s>", "a"]


def test_truncate_and_mask(spark):
    assert one(spark, [1, 2, 3], "array<int>", lambda c: truncate(c, 2)) == [1, 2]
    assert one(spark, [5, 6, 7], "array<int>", attention_mask) == [1, 1, 1]
    assert one(spark, [], "array<int>", attention_mask) == []


@pytest.fixture(scope="module")
def vocabulary(spark):
    tokens = spark.createDataFrame([(t,) for t in "a b c a b <|x|> é".split()], "token string")
    return build_vocabulary(tokens).cache()


def test_vocabulary_has_ids_without_gaps(spark, vocabulary):
    assert sorted(r["id"] for r in vocabulary.collect()) == list(range(5))
    assert fits_workers(vocabulary)
    words = spark.range(5000).select(F.concat(F.lit("w"), F.col("id") % 1700).alias("token"))
    ids = [r["id"] for r in build_vocabulary(words).collect()]
    assert sorted(ids) == list(range(1700))


@pytest.mark.parametrize("shared", [True, False])
def test_encode_and_decode(spark, vocabulary, shared):
    rows = [(1, ["a", "é", "a"]), (2, []), (3, None), (4, ["zzz", "b"]), (5, ["c"] * 500)]
    df = spark.createDataFrame(rows, "k int, x array<string>").repartition(3)
    ids = encode(df, "x", vocabulary, ["k"], unknown_id=-1, shared=shared)
    back = {r["k"]: r["x"] for r in decode(ids, "x", vocabulary, ["k"], "?", shared).collect()}
    assert back == {1: ["a", "é", "a"], 2: [], 3: None, 4: ["?", "b"], 5: ["c"] * 500}
    assert {r["k"]: r["x"] for r in ids.collect()}[4][0] == -1


def test_detokenize(spark, vocabulary):
    df = spark.createDataFrame([(1, ["b", "a"])], "k int, x array<string>")
    ids = encode(df, "x", vocabulary, ["k"])
    assert detokenize(ids, "x", vocabulary, ["k"]).first()["text"] == "b a"


@pytest.mark.parametrize("shared", [True, False])
def test_doubtful_entries_mean_one_thing(spark, shared):
    entries = [("a", 7), ("a", 3), (None, 1), ("b", None), ("c", 9)]
    vocabulary = spark.createDataFrame(entries, "token string, id int")
    # two rows of one key, and one row twice
    rows = [(1, ["a", "c"]), (1, ["c"]), (2, ["b", None, "a"]), (2, ["b", None, "a"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "k int, x array<string>")
    found = sorted((str(r["k"]), r["x"]) for r in encode(df, "x", vocabulary, ["k"], shared=shared).collect())
    assert [f for f in found if f[0] != "2"] == [("1", [3, 9]), ("1", [9]), ("None", [3])]
    assert [f[1] for f in found if f[0] == "2"] == [[-1, -1, 3]] * 2


def test_sharing_is_checked(spark, vocabulary, monkeypatch):
    monkeypatch.setattr("calibrel.operators.vocabulary.SHARED_ENTRIES", 3)
    df = spark.createDataFrame([(1, ["b"])], "k int, x array<string>")
    with pytest.raises(ValueError, match="not shared"):
        encode(df, "x", vocabulary, ["k"], shared=True)
    plan = encode(df, "x", vocabulary, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_a_corpus_is_tokenized_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        calls.add(1)
        return text

    words = spark.range(100).select(seen(F.concat(F.lit("w"), F.col("id"))).alias("token"))
    assert build_vocabulary(words).count() == 100 and calls.value == 100


def test_a_tokenizer_of_the_caller_gets_bounded_batches(spark):
    def sizes(texts):
        return [[sum(map(len, texts))]] * len(texts)

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    options = Calibration(mode="as_is", layout=CHATML, max_length=None, tokenizer=batch_tokenizer(sizes))
    message = F.struct(F.lit("user").alias("role"), F.repeat(F.lit("word "), 2_000).alias("content"))
    rows = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("conv_id"), F.array(message).alias("conversations"))
    found = calibration_ids(rows, options).select(F.get("input_ids", 0).alias("n")).agg(F.max("n"), F.count("n"))
    most, n = found.first()
    assert n == 2_000 and most <= 3 << 20


def test_blocks_gather_small_batches_and_are_compressed(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"k": [1, 2, 3], "x": [["a", "b", None] * 100, None, []]})
    monkeypatch.setattr("calibrel.operators.vocabulary.TaskContext.get", lambda: Task())
    blocks = list(_blocks("x", ["k"], pa.string())(iter([batch] * 50)))
    assert len(blocks) == 1 and blocks[0]["_values"].to_pylist() == [["a", "b", None]]
    assert len(blocks[0]["_places"][0].as_py()) < 300 * 50 // 4


class Task:
    def partitionId(self):
        return 0
