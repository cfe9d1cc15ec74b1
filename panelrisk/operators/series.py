"""Fleet-level count series: daily sums, gap-free calendars, weekly bins.

The heavy step is the first aggregation (panel rows → one row per day, with
partial aggregation before the shuffle). Everything after it is bounded by
the number of calendar days in the data, independent of the row volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.functions.calendar import week_ending_sunday
from panelrisk.session import cut_lineage


def daily_sum(df: DataFrame, date_col: str, value_col: str, out: str = "y") -> DataFrame:
    """Sum of ``value_col`` per date."""
    return df.groupBy(F.col(date_col).alias("ds")).agg(F.sum(value_col).cast("bigint").alias(out))


def daily_mean(df: DataFrame, date_col: str, cols: list[str]) -> DataFrame:
    """Mean of each column per date."""
    return df.groupBy(F.col(date_col).alias("ds")).agg(*[F.avg(c).alias(c) for c in cols])


def calendar(df: DataFrame, ds: str = "ds", step_days: int = 1, by=()) -> DataFrame:
    """Every day (or every ``step_days``) from min to max of ``ds`` (per ``by`` group)."""
    bounds = df.groupBy(*by).agg(F.min(ds).alias("lo"), F.max(ds).alias("hi"))
    return bounds.select(
        *by, F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step_days} DAYS"))).alias(ds)
    )


def densify(series: DataFrame, fill: dict | None = None, ds: str = "ds", by=()) -> DataFrame:
    """Reindex a date-keyed series to a gap-free daily calendar.

    Missing values of the columns named in ``fill`` become the given constant;
    other columns stay NULL (to be interpolated).
    """
    series = cut_lineage(series)  # one row per day, read by the calendar's bounds and by the join
    cal = calendar(series, ds, by=by)
    out = cal.join(series, [*by, ds], "left")
    for c, v in (fill or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)).cast(series.schema[c].dataType))
    return out


def interpolate_linear(series: DataFrame, cols: list[str], ds: str = "ds", by=()) -> DataFrame:
    """Linear interpolation over the day axis, then forward fill, then back fill.

    Positions are day numbers of a gap-free calendar, so interpolation by
    position equals interpolation by index.
    """
    pos = F.datediff(F.col(ds), F.lit("1970-01-01").cast("date"))
    w_back = Window.partitionBy(*by).orderBy(ds).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_fwd = Window.partitionBy(*by).orderBy(F.col(ds).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = series.withColumn("_pos", pos)
    for c in cols:
        prev_v = F.last(F.col(c), ignorenulls=True).over(w_back)
        prev_p = F.last(F.when(F.col(c).isNotNull(), F.col("_pos")), ignorenulls=True).over(w_back)
        next_v = F.last(F.col(c), ignorenulls=True).over(w_fwd)
        next_p = F.last(F.when(F.col(c).isNotNull(), F.col("_pos")), ignorenulls=True).over(w_fwd)
        blended = prev_v + (next_v - prev_v) * (F.col("_pos") - prev_p) / (next_p - prev_p)
        out = out.withColumn(
            c,
            F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
            .when(prev_v.isNotNull() & next_v.isNotNull(), blended)
            .when(prev_v.isNotNull(), prev_v.cast("double"))
            .otherwise(next_v.cast("double")),
        )
    return out.drop("_pos")


def weekly(series: DataFrame, sum_cols: list[str], mean_cols: list[str] = (), ds: str = "ds") -> DataFrame:
    """Monday–Sunday bins labelled by their Sunday."""
    aggs = [F.sum(c).alias(c) for c in sum_cols] + [F.avg(c).alias(c) for c in mean_cols]
    return series.groupBy(week_ending_sunday(F.col(ds)).alias(ds)).agg(*aggs)
