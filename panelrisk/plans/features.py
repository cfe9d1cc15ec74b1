"""Leakage-free feature table (N01): 12 raw + 31 derived features.

Every derived value uses only the entity's past (shifted windows) or same-day
observations. Fleet-wide weather is reduced to one row per date, rolled on
that small series, and joined back (aggregate before join). All per-entity
windows share one window spec: one exchange on the entity key, one sort.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from panelrisk.functions.calendar import calendar_columns
from panelrisk.functions.columns import EPS, flag, ratio, recency_columns, thermal_columns, weather_code_flags
from panelrisk.operators import events, joins, windows
from panelrisk.session import cut_lineage
from panelrisk.spec import PanelSpec

DERIVED = [
    "month", "dayofweek", "doy_sin", "doy_cos", "season", "is_summer",
    "temp_sq", "is_hot", "is_cold", "temp_x_humidity", "temp_dev_from_month",
    "use_7d_30d_ratio", "use_roll30_std",
    "past_event_rate", "events_last_90",
    "temp_7d_mean", "temp_7d_max", "temp_30d_max", "hot_days_7d", "hot_days_14d", "cold_days_7d",
    "is_precip", "is_rain", "is_snow",
    "use_per_day_since_maint", "age_x_use_since_maint", "age_x_use_30d", "use_today_vs_7d_avg",
    "log_days_since_event", "recent_event_30d", "recent_event_90d",
]

# helper columns that describe today's event or grow with time: never features
HELPERS = ["event", "past_observations", "past_events"]


def engineer_features(df: DataFrame, spec: PanelSpec, month_mean_from: DataFrame | None = None) -> DataFrame:
    """Add the derived features; drop helpers and redundant raw columns.

    ``month_mean_from`` optionally restricts the monthly temperature mean to a
    subset (e.g. train rows); by default it is computed over all rows.
    """
    # the panel feeds three branches (entity windows, monthly mean, fleet weather):
    # materialise it once instead of recomputing it from the raw tables per branch
    return derive_features(cut_lineage(df), spec, month_mean_from)


def derive_features(df: DataFrame, spec: PanelSpec, month_mean_from: DataFrame | None = None) -> DataFrame:
    """:func:`engineer_features` of a panel that is written already (it is read three times)."""
    c = F.col
    out = df.select("*", *calendar_columns(c(spec.date)), *thermal_columns(c(spec.temp), c(spec.humidity)))
    base = out if month_mean_from is None else month_mean_from.withColumn("month", F.month(spec.date))
    means = base.groupBy("month").agg(F.avg(spec.temp).alias("_month_temp"))
    out = out.join(F.broadcast(means), "month", "left").withColumn(
        "temp_dev_from_month", c(spec.temp) - c("_month_temp")
    ).drop("_month_temp")

    out = out.withColumn("use_7d_30d_ratio", ratio(c(spec.usage_7d), c(spec.usage_30d)))
    out = out.withColumn("use_roll30_std", windows.rolling_std_before(spec.usage_today, spec, 30, 5, whole=_whole(df, spec.usage_today)))
    out = out.withColumn("event", events.counter_reset_event(spec))
    out = out.withColumn("past_events", windows.past_sum("event", spec))
    out = out.withColumn("past_observations", windows.past_observations(spec))
    out = out.withColumn("past_event_rate", windows.past_rate(c("past_events"), c("past_observations")))
    out = out.withColumn("events_last_90", windows.past_sum("event", spec, 90).cast("double"))

    daily = joins.first_entity_value_per_date(df, spec, spec.temp)
    rolled = windows.rolling_over_days(daily, spec.date, spec.temp)
    out = joins.join_by_date(out, rolled, spec.date)

    age = c(spec.age).cast("bigint")
    out = out.select(
        "*",
        *weather_code_flags(c(spec.weather_type)),
        ratio(c(spec.usage_since_maint), c(spec.days_since_maint)).alias("use_per_day_since_maint"),
        (age * c(spec.usage_since_maint)).alias("age_x_use_since_maint"),
        (age * c(spec.usage_30d)).alias("age_x_use_30d"),
        (c(spec.usage_today).cast("double") / (c(spec.usage_7d) / 7 + EPS)).alias("use_today_vs_7d_avg"),
        *recency_columns(c(spec.counter)),
    )
    return out.drop(*HELPERS, *[r for r in spec.redundant if r in out.columns])


def _whole(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, IntegralType)


def feature_columns(df: DataFrame, spec: PanelSpec) -> list[str]:
    """All columns but ids and labels (B13); raises if a column derived from a label is among them.

    A column is taken for such a one if a label's name is part of its own as whole words, in any
    case: label ``y`` finds ``y_lag`` and ``last-Y``, not ``humidity``.
    """
    labels = [x for x in (spec.label, spec.other_label) if x]
    cols = [x for x in df.columns if x not in {spec.date, spec.entity, *labels}]
    leaks = [x for x in cols if any(re.search(rf"(?<![a-z0-9]){re.escape(y.lower())}(?![a-z0-9])", x.lower()) for y in labels)]
    if leaks:
        raise AssertionError(f"label leaked into the feature list: {leaks}")
    return cols


def split_feature_kinds(cols: list[str], spec: PanelSpec) -> tuple[list[str], list[str]]:
    cat = [x for x in cols if x in spec.categorical]
    return [x for x in cols if x not in cat], cat


__all__ = ["engineer_features", "feature_columns", "split_feature_kinds", "DERIVED", "flag"]
