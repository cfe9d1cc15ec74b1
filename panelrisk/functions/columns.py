"""Row-level feature expressions.

Comparisons are wrapped in ``coalesce(…, false)`` so a missing value gives a
0 flag (pandas semantics for NaN), and divisions use an additive epsilon guard
rather than NULLIF, so a zero denominator gives a large value, not NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def ratio(num: Column, den: Column) -> Column:
    return num.cast("double") / (den.cast("double") + EPS)


def thermal_columns(temp: Column, humidity: Column) -> list[Column]:
    return [
        F.pow(temp, 2).alias("temp_sq"),
        flag(temp >= 30).alias("is_hot"),
        flag(temp <= 0).alias("is_cold"),
        (temp * humidity).alias("temp_x_humidity"),
    ]


def weather_code_flags(code: Column) -> list[Column]:
    return [
        flag(code >= 51).alias("is_precip"),
        flag(code.between(61, 69)).alias("is_rain"),
        flag(code.between(71, 79)).alias("is_snow"),
    ]


def recency_columns(counter: Column) -> list[Column]:
    return [
        F.log1p(counter).alias("log_days_since_event"),
        flag(counter <= 30).alias("recent_event_30d"),
        flag(counter <= 90).alias("recent_event_90d"),
    ]


def clip_nonnegative(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def alarm(score: Column, threshold: Column) -> Column:
    """Alarm when score >= threshold; ties are all flagged; NULL threshold → 0."""
    return flag(score >= threshold)


def verdict(beats_a: Column, beats_b: Column, both: str, one: str, none: str) -> Column:
    return F.when(beats_a & beats_b, both).when(beats_a | beats_b, one).otherwise(none)
