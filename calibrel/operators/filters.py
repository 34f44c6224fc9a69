"""Filters and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from calibrel.functions.names import contains_ignoring_case


def settle(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with the columns worked out below any later filter.

    The optimizer moves a filter through a projection by copying the expressions it tests,
    which then run twice for every row. It does not copy them through a generator.
    """
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(F.array(F.struct(*columns)))).select(*df.columns)


def min_turns(df: DataFrame, least: int = 2, chat: str = "chat") -> DataFrame:
    """Keeps conversations with enough turns, counted after the conversion."""
    return settle(df, chat).filter(F.size(chat) >= least)


def min_tokens(df: DataFrame, least: int = 10, ids: str = "input_ids") -> DataFrame:
    return settle(df, ids).filter(F.size(ids) >= least)


def name_contains(df: DataFrame, column: str, needle: str) -> DataFrame:
    return df.filter(contains_ignoring_case(F.col(column), needle))


def select_targets(
    df: DataFrame,
    kind: str,
    name: str,
    targets: str | Sequence[str],
    ignore: Sequence[str] | DataFrame = (),
) -> DataFrame:
    """Rows of the target kinds whose name is not ignored.

    ``ignore`` is a list, or a table with the column ``name`` for a list too long for one.
    """
    wanted = [targets] if isinstance(targets, str) else list(targets)
    chosen = df.filter(F.col(kind).isin(wanted))
    if isinstance(ignore, DataFrame):
        return chosen.join(ignore.select(name), name, "left_anti")
    if not ignore:
        return chosen
    return chosen.filter(F.col(name).isNull() | ~F.col(name).isin(list(ignore)))


def require_rows(df: DataFrame, message: str = "no valid calibration rows") -> DataFrame:
    """Fails if nothing survived; reads until the first row only.

    Before a write ``count_rows`` asks the same without a second run of the plan.
    """
    if df.isEmpty():
        raise ValueError(message)
    return df


def count_rows(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows, and an observation whose ``n`` is their number once an action has run."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen
