"""Tokens and token ids of a text column."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

_IDS = ArrayType(IntegerType())
_OUTCOME = StructType().add("ids", _IDS).add("error", StringType())

# Fixed value: special tokens, runs of letters and digits, single other characters.
TOKEN_PATTERN = r"<\|[a-z_]+\|>|[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def tokenize(text: Column, bos: str | None = None) -> Column:
    """Tokens of the whole text. ``bos`` is put in front (``add_special_tokens``)."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    if bos is None:
        return tokens
    return F.concat(F.array(F.lit(bos)), tokens)


def truncate(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def attention_mask(ids: Column) -> Column:
    """Ones, as many as there are ids: nothing is padded."""
    return F.transform(ids, lambda _: F.lit(1))


def batch_tokenizer(
    function: Callable[[list[str]], list[list[int]]], isolate: bool = False
) -> Callable[[Column], Column]:
    """A tokenizer for ``Calibration`` from a function of a list of texts; null texts give null.

    With ``isolate`` an exception costs the row that raises it, not the job: a batch that fails is
    halved until the row stands alone, which then has null ids. ``outcomes`` tells why.
    """
    if isolate:
        outcome = outcomes(function)
        return lambda text: outcome(text)["ids"]

    @arrow_udf(_IDS)
    def ids(texts: pa.Array) -> pa.Array:
        whole = texts.drop_null().to_pylist()
        found = iter(_checked(function, whole))
        return pa.array([next(found) if t else None for t in texts.is_valid().to_pylist()], pa.list_(pa.int32()))

    return ids


def outcomes(function: Callable[[list[str]], list[list[int]]]) -> Callable[[Column], Column]:
    """Texts to ``struct<ids:array<int>, error:string>``: one of the two, or neither for a null text."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("error", pa.string())])

    def settle(texts: list[str]) -> list[tuple[list[int] | None, str | None]]:
        if not texts:
            return []
        try:
            return [(ids, None) for ids in _checked(function, texts)]
        except Exception as raised:  # whatever the caller's function raises
            if len(texts) == 1:
                return [(None, f"{type(raised).__name__}: {raised}")]
        middle = len(texts) // 2
        return settle(texts[:middle]) + settle(texts[middle:])

    @arrow_udf(_OUTCOME)
    def run(texts: pa.Array) -> pa.Array:
        found = iter(settle(texts.drop_null().to_pylist()))
        rows = [next(found) if t else (None, None) for t in texts.is_valid().to_pylist()]
        return pa.array([{"ids": ids, "error": error} for ids, error in rows], kind)

    return run


def _checked(function: Callable, texts: list[str]) -> list[list[int]]:
    found = [pa.array(ids, pa.int32()).to_pylist() for ids in function(texts)]
    if len(found) != len(texts):
        raise ValueError(f"the tokenizer gave {len(found)} results for {len(texts)} texts")
    return found
