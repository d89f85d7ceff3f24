"""Bands of stars and activity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exclusive upper bounds of the bands; the last band is open.
STAR_BANDS = (10, 50, 200, 1000, 5000, 25000)
ACTIVITY_BANDS = (30, 180, 730)


def band_of(value: Column, bounds: tuple[float, ...]) -> Column:
    """The number of the right-open band that ``value`` lies in; null stays null."""
    return F.when(value.isNotNull(), sum((F.when(value >= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0)))


def days_before(column: str | Column, now: str) -> Column:
    """Days, with fraction, from a timestamp to ``now``."""
    when = F.col(column) if isinstance(column, str) else column
    micros = F.expr(f"unix_micros(timestamp '{now}')") - F.unix_micros(when.cast("timestamp"))
    return micros / F.lit(86_400_000_000.0)
