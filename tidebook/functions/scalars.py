"""Column expressions. All stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price ratios of common splits and reverse splits.
SPLIT_FACTORS = (0.1, 0.2, 0.25, 1.0 / 3.0, 0.5, 2.0, 3.0, 4.0, 5.0, 10.0)
# Texts that count as true.
TRUE_TEXTS = ("1", "true", "yes", "y", "verified")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_null(x: Column) -> Column:
    return F.when(finite(x), x)


def between(x: Column, low: float, high: float) -> Column:
    """x held within bounds; null stays null, though least and greatest skip nulls."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))



def zero_default(x: Column, default: float) -> Column:
    """A missing value and a plain zero both become ``default``."""
    return F.when(x.isNull() | (x == 0), F.lit(default)).otherwise(x)


def sum0(x: Column) -> Column:
    """Sum in which no rows, or nulls only, count as zero."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is null or zero."""
    return F.try_divide(x, y)


def rint_to(x: Column, digits: int) -> Column:
    """Round half to even on the scaled value."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)



def canonical_ticker(x: Column) -> Column:
    """Trimmed, upper case, one trailing exchange suffix removed."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(x.cast("string"), F.lit("")))), r"[.]JK$", "")


def lenient_bool(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin(*TRUE_TEXTS), F.lit(False))


def number(x: Column) -> Column:
    """Cast that yields null for text that is no number, and for NaN."""
    return F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))


def day(x: Column) -> Column:
    """Calendar day of a date, timestamp or text; null for bad text."""
    return x.try_cast("timestamp").cast("date")


def moment(x: Column) -> Column:
    """A point in time, as UTC wall-clock time, from text in ISO form; text without a zone means
    UTC, and bad text is null."""
    has_zone = F.trim(x).rlike(r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$")
    whole = F.when(has_zone, F.trim(x)).otherwise(F.concat(F.trim(x), F.lit("Z")))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), whole.try_cast("timestamp").cast("timestamp_ntz"))


def pick(x: Column, table: Mapping[str, float], default: float) -> Column:
    """Literal lookup."""
    out = None
    for key, value in table.items():
        out = F.when(x == key, F.lit(value)) if out is None else out.when(x == key, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def least_relative_split_error(r: Column) -> Column:
    return F.least(*[F.abs(r - F.lit(f)) / F.lit(f) for f in SPLIT_FACTORS])
