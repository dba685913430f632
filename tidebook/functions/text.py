"""Formula pieces as SQL text.

Long per-ticker formulas are written as SQL expressions: one parse in the JVM
instead of a call per operator, and easier to read beside their definition.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.scalars import SPLIT_FACTORS


def clip(x: str, low: float = 0.0, high: float = 100.0) -> str:
    """x held within bounds; null stays null, though least and greatest skip nulls."""
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({low}D, least({high}D, {x})) END)"


def held(x: str, low: float = 0.0, high: float = 100.0) -> str:
    """``clip`` for a value that is known not to be null: half as long a text."""
    return f"greatest({low}D, least({high}D, {x}))"


def known(x: str) -> str:
    return f"(({x}) IS NOT NULL AND NOT isnan({x}) AND abs({x}) < double('Infinity'))"


def score(x: str) -> str:
    """0..100, 50 for a value that is no finite number."""
    return f"CASE WHEN {known(x)} THEN {held(x)} ELSE 50D END"


def sigmoid(x: str, scale: float) -> str:
    """Logistic score 0..100 with the argument held within +-12."""
    return f"CASE WHEN {known(x)} THEN 100D / (1D + exp(-{held(f'({x}) / {scale}D', -12.0, 12.0)})) ELSE 50D END"


def zero_default(x: str, default: float) -> str:
    """A missing value and a plain zero both become ``default``."""
    return f"(CASE WHEN {x} IS NULL OR {x} = 0 THEN {default}D ELSE {x} END)"


def rounded(x: str, digits: int) -> str:
    """Round half to even on the scaled value."""
    return f"(rint(({x}) * {10**digits}D) / {10**digits}D)"


def fixed(x: str, digits: int) -> str:
    return f"format_string('%.{digits}f', {rounded(x, digits)})"


def nearest_split_factor(r: str) -> str:
    """The factor closest to ``r`` by plain distance; the smaller one on a tie."""
    steps = " ".join(
        f"WHEN {r} <= {(low + high) / 2.0!r}D THEN {low!r}D" for low, high in zip(SPLIT_FACTORS, SPLIT_FACTORS[1:])
    )
    return f"CASE {steps} ELSE {SPLIT_FACTORS[-1]!r}D END"


def with_texts(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def agg_texts(columns: Mapping[str, str]) -> list:
    return [F.expr(text).alias(name) for name, text in columns.items()]
