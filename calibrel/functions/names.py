"""Small string functions on identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def artifact_name(model_id: Column, suffix: str) -> Column:
    """The piece after the first ``/`` plus a suffix; null for an id without one."""
    return F.concat(F.get(F.split(model_id, "/"), F.lit(1)), F.lit(suffix))


def contains_ignoring_case(name: Column, needle: str) -> Column:
    return F.lower(name).contains(needle.lower())


def pad_fallback(pad: Column, eos: Column) -> Column:
    """The padding token, or the end token where there is none."""
    return F.coalesce(pad, eos)
