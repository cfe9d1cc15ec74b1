"""Calendar expressions (all pure Catalyst expressions)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season names by (month % 12) div 3.
SEASONS = ["winter", "spring", "summer", "autumn"]
SUMMER_MONTHS = [6, 7, 8]


def weekday_mon0(d: Column) -> Column:
    """Day of week with Monday = 0 … Sunday = 6."""
    return F.weekday(d)


def week_ending_sunday(d: Column) -> Column:
    """Label of the Monday–Sunday week that contains ``d``: its Sunday."""
    return F.next_day(F.date_sub(d, 1), "Sun")


def cyclic_day(d: Column, fn=F.sin) -> Column:
    return fn(2 * math.pi * F.dayofyear(d) / 365.25)


def season(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), F.floor((month % 12) / 3).cast("int") + 1)


def is_summer(month: Column) -> Column:
    return month.isin(SUMMER_MONTHS).cast("int")


def calendar_columns(d: Column) -> list[Column]:
    m = F.month(d)
    return [
        m.alias("month"),
        weekday_mon0(d).alias("dayofweek"),
        cyclic_day(d, F.sin).alias("doy_sin"),
        cyclic_day(d, F.cos).alias("doy_cos"),
        season(m).alias("season"),
        is_summer(m).alias("is_summer"),
    ]
