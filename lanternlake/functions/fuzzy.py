"""Evidence in [0, 1]: or is the largest, and the smallest, not the rest to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def cap(x: Column) -> Column:
    """Within 0 and 1; null, NaN and what isn't a number is 0."""
    v = F.nanvl(F.coalesce(x.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def f_or(*xs: Column) -> Column:
    return F.greatest(*xs, F.lit(0.0))


def f_and(*xs: Column) -> Column:
    return F.least(*xs, F.lit(1.0)) if xs else F.lit(0.0)


def f_not(x: Column) -> Column:
    return 1.0 - x


def active(x: Column, at: float = fixed.SOFT_ACTIVE) -> Column:
    return F.when(x >= at, x).otherwise(F.lit(0.0))
