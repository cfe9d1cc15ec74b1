"""Lookups and small-side joins.

Broadcast is used only for sides with a proven bound: one row per calendar
day, per month, per fold, per cutoff or per threshold-grid point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.spec import PanelSpec


def first_entity_value_per_date(df: DataFrame, spec: PanelSpec, col: str) -> DataFrame:
    """Value of ``col`` on the smallest entity id of each date.

    A fleet-wide series such as temperature is read off one entity per day.
    """
    return df.groupBy(spec.date).agg(F.min_by(col, spec.entity).alias(col))


def deviation_from_group_mean(df: DataFrame, col: str, group: str, out: str) -> DataFrame:
    """``col - mean(col) over group`` via a group aggregate joined back.

    The aggregate has one row per group value (12 months), so it is broadcast
    instead of running a window whose partitions would be the whole month.
    """
    means = df.groupBy(group).agg(F.avg(col).alias("_grp_mean"))
    return df.join(F.broadcast(means), group, "left").withColumn(out, F.col(col) - F.col("_grp_mean")).drop("_grp_mean")


def join_by_date(df: DataFrame, daily: DataFrame, on: str) -> DataFrame:
    """Left join of a per-date table (bounded by the date span)."""
    return df.join(F.broadcast(daily), on, "left")


def month_mean_fill(future: DataFrame, known: DataFrame, ds: str, cols: list[str], by=()) -> DataFrame:
    """Known value by date, else the mean of that calendar month, in the same series."""
    by = list(by)
    by_month = known.groupBy(*by, F.month(ds).alias("_m")).agg(*[F.avg(c).alias(f"_mm_{c}") for c in cols])
    out = future.join(known.select(*by, ds, *cols), [*by, ds], "left").withColumn("_m", F.month(ds))
    out = out.join(by_month if by else F.broadcast(by_month), [*by, "_m"], "left")  # 12 rows a series
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_mm_{c}")))
    return out.drop("_m", *[f"_mm_{c}" for c in cols])
