"""Profiles and summaries (D06–D14): single-pass conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.functions.calendar import week_ending_sunday
from panelrisk.spec import PanelSpec


def class_balance(df: DataFrame, label: str, by=()) -> DataFrame:
    """Positives, negatives, neg/max(pos,1) weight and base rate."""
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    neg = F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    return df.groupBy(*by).agg(
        pos.cast("bigint").alias("positives"),
        neg.cast("bigint").alias("negatives"),
        (neg / F.greatest(pos, F.lit(1))).cast("double").alias("scale_pos_weight"),
        F.avg(F.col(label).cast("double")).alias("base_rate"),
    )


def split_diagnosis(df: DataFrame, spec: PanelSpec, label: str, by=("split",)) -> DataFrame:
    """Per split: rows, date range, positive rate, share of summer rows."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(spec.date).alias("min_date"),
        F.max(spec.date).alias("max_date"),
        F.avg(F.col(label).cast("double")).alias("pos_rate"),
        F.avg(F.month(spec.date).isin(6, 7, 8).cast("double")).alias("summer_share"),
    )


def series_profile(series: DataFrame, ds: str = "ds", y: str = "y") -> DataFrame:
    """Total, periods, date range, mean/min/max of a count series."""
    return series.agg(
        F.sum(y).cast("double").alias("total"),
        F.count(F.lit(1)).alias("periods"),
        F.min(ds).alias("min_ds"),
        F.max(ds).alias("max_ds"),
        F.avg(y).alias("mean_y"),
        F.min(y).cast("double").alias("min_y"),
        F.max(y).cast("double").alias("max_y"),
    )


def event_totals_by_season_month(df: DataFrame, spec: PanelSpec, event: str) -> DataFrame:
    """Events and event rate by season, by month and in total — one grouping-sets pass."""
    from panelrisk.functions.calendar import season

    d = df.select(F.month(spec.date).alias("month"), season(F.month(spec.date)).alias("season"), event)
    g = d.groupingSets([["season"], ["month"], []], "season", "month").agg(
        F.sum(event).cast("bigint").alias("events"),
        F.count(F.lit(1)).alias("rows"),
        F.grouping_id().alias("_gid"),
    )
    level = F.when(F.col("_gid") == 1, "season").when(F.col("_gid") == 2, "month").otherwise("total")
    return g.withColumn("level", level).drop("_gid")


def entity_event_profile(df: DataFrame, spec: PanelSpec, event: str) -> DataFrame:
    """Events per entity (mean, median, max) and mean share of zero-event weeks.

    Zero weeks need no densified entity × week grid: weeks in the entity's span
    minus weeks with an event.
    """
    wk = week_ending_sunday(F.col(spec.date))
    per = df.groupBy(spec.entity).agg(
        F.sum(event).alias("events"),
        F.min(wk).alias("w0"),
        F.max(wk).alias("w1"),
        F.count_distinct(F.when(F.col(event) > 0, wk)).alias("event_weeks"),
    )
    weeks = F.datediff("w1", "w0") / 7 + 1
    per = per.withColumn("zero_week_share", 1 - F.col("event_weeks") / weeks)
    return per.agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("events").alias("mean_events"),
        F.percentile("events", 0.5).alias("median_events"),
        F.max("events").cast("double").alias("max_events"),
        F.avg("zero_week_share").alias("mean_zero_week_share"),
    )


def dataset_profile(variants: DataFrame, spec: PanelSpec, label: str) -> DataFrame:
    """Per dataset variant: period, distinct entities, rows, label rate."""
    return variants.groupBy("dataset").agg(
        F.min(spec.date).alias("min_date"),
        F.max(spec.date).alias("max_date"),
        F.count_distinct(spec.entity).alias("entities"),
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col(label).cast("double")).alias("label_rate"),
    )


def rule_lift(df: DataFrame, rules: dict[str, Column], label: str) -> DataFrame:
    """For each named rule: rows matched, label rate inside, lift vs base rate.

    One scan with conditional sums; the per-rule columns are unpivoted after.
    """
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(F.col(label)).alias("_p")]
    for i, cond in enumerate(rules.values()):
        hit = F.coalesce(cond, F.lit(False))
        aggs += [F.sum(hit.cast("int")).alias(f"_n{i}"), F.sum(F.when(hit, F.col(label)).otherwise(0)).alias(f"_p{i}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{name}', _n{i}, _p{i}" for i, name in enumerate(rules))
    long = wide.selectExpr("_n", "_p", f"stack({len(rules)}, {stack}) AS (rule, n, p)")
    rate = F.try_divide("p", "n")  # NULL where a rule matches nothing
    base = F.try_divide("_p", "_n")
    return long.select(
        "rule", F.col("n").cast("bigint").alias("n"), rate.cast("double").alias("rate"),
        F.try_divide(rate, base).cast("double").alias("lift"),
    )


def mean_std(df: DataFrame, cols: list[str], by=()) -> DataFrame:
    """Mean and population std per column."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*aggs)
