"""An ordered list of compression steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from calibrel.operators.codes import fp8_codes, int_codes
from calibrel.operators.smooth import smooth

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Smooth:
    weights: DataFrame
    vec: str
    weights_vec: str
    strength: float = 0.8

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.both(df)[0]

    def both(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The smoothed rows and the weights that take up what they lost."""
        return smooth(df, self.weights, self.vec, self.weights_vec, self.strength)


@dataclass(frozen=True)
class IntCodes:
    vec: str
    bits: int = 8
    per: str = "row"
    group_size: int | None = None
    order: str = "natural"

    def __call__(self, df: DataFrame) -> DataFrame:
        return int_codes(df, self.vec, self.bits, self.per, self.group_size, self.order)


@dataclass(frozen=True)
class Fp8Codes:
    vec: str
    per: str = "row"

    def __call__(self, df: DataFrame) -> DataFrame:
        return fp8_codes(df, self.vec, self.per)


def run_recipe(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Each step once, in order."""
    return reduce(lambda done, step: done.transform(step), steps, df)


def run_recipe_on_both(
    df: DataFrame, smoothing: Smooth, steps: Sequence[Step], weight_steps: Sequence[Step]
) -> tuple[DataFrame, DataFrame]:
    """Smooths rows and weights, then takes each side through its own steps."""
    rows, weights = smoothing.both(df)
    return run_recipe(rows, steps), run_recipe(weights, weight_steps)
