"""Per-entity history windows.

All per-entity features share ``partitionBy(entity).orderBy(date)`` so the
plan needs one exchange and one sort for all of them. Integer windows are
*row* windows (observations), not calendar windows. ``shift(1)`` followed by a
rolling window of ``n`` is the frame ``rowsBetween(-n, -1)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.spec import PanelSpec


def by_entity(spec: PanelSpec):
    return Window.partitionBy(spec.entity).orderBy(spec.date)


def _last_rows(total: Column, spec: PanelSpec, n: int) -> Column:
    """A sum or count over the ``n`` previous rows, as the difference of two running ones.

    A sliding frame is summed up anew for every row; a running one takes each row
    in once. Exact for whole numbers and decimals only.
    """
    upto = by_entity(spec).rowsBetween(Window.unboundedPreceding, -1)
    before = by_entity(spec).rowsBetween(Window.unboundedPreceding, -n - 1)
    return F.coalesce(total.over(upto), F.lit(0)) - F.coalesce(total.over(before), F.lit(0))


def rolling_std_before(x: str, spec: PanelSpec, n: int = 30, min_periods: int = 5, whole: bool = False) -> Column:
    """Sample std of the ``n`` previous observations, NULL under ``min_periods``.

    With ``whole`` (``x`` holds whole numbers of at most 15 digits) it comes from exact running sums.
    """
    if whole:
        v = F.col(x).cast("decimal(15,0)")
        count, s, sq = (_last_rows(a, spec, n) for a in (F.count(x), F.sum(v), F.sum(v * v)))
        spread = count * sq - s * s  # exact, so never negative
        return F.when(count >= min_periods, F.sqrt(spread.cast("double") / (count * (count - 1))))
    w = by_entity(spec).rowsBetween(-n, -1)
    return F.when(F.count(x).over(w) >= min_periods, F.stddev_samp(x).over(w))


def past_sum(x: str, spec: PanelSpec, n: int | None = None) -> Column:
    """Sum of the whole numbers ``x`` strictly before today (all history, or the last ``n`` rows)."""
    if n is not None:
        return _last_rows(F.sum(x), spec, n)
    return F.coalesce(F.sum(x).over(by_entity(spec).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def past_observations(spec: PanelSpec) -> Column:
    return F.row_number().over(by_entity(spec)) - 1


def past_rate(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def rolling_over_days(daily: DataFrame, ds: str, x: str) -> DataFrame:
    """Rolling statistics of a per-date series (E07, E08): same day included.

    The input has one row per calendar day, so this unpartitioned window is
    bounded by the date span, not by the data volume.
    """
    w = Window.orderBy(ds)
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    hot = F.coalesce(F.col(x) >= 30, F.lit(False)).cast("int")
    cold = F.coalesce(F.col(x) <= 0, F.lit(False)).cast("int")
    return daily.select(
        ds,
        F.avg(x).over(last(7)).alias("temp_7d_mean"),
        F.max(x).over(last(7)).alias("temp_7d_max"),
        F.max(x).over(last(30)).alias("temp_30d_max"),
        F.sum(hot).over(last(7)).cast("double").alias("hot_days_7d"),
        F.sum(hot).over(last(14)).cast("double").alias("hot_days_14d"),
        F.sum(cold).over(last(7)).cast("double").alias("cold_days_7d"),
    )
