"""Feature-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.operators import events, joins, windows
from panelrisk.plans.features import engineer_features, feature_columns
from panelrisk.queries import register
from panelrisk.queries.common import typed, typed_sql
from panelrisk.queries.sql_features import FEATURES_SQL
from panelrisk.sources.fixture import fixture_panel
from panelrisk.spec import FIXTURE_SPEC as S

IDS = [("entity_id", "l"), ("date", "t")]
RAW = [
    ("entity_type", "s"), ("entity_age", "i"), ("use_today", "l"), ("use_last_7d", "l"), ("use_last_30d", "l"),
    ("days_since_last_maintenance", "i"), ("use_since_last_maintenance", "l"), ("days_since_last_event", "i"),
    ("temp", "d"), ("weather_type", "i"), ("wind_speed", "d"), ("humidity", "i"),
]
LABELS = [("event_next_7d", "i"), ("event_next_30d", "i")]
DERIVED = [
    ("month", "i"), ("dayofweek", "i"), ("doy_sin", "d"), ("doy_cos", "d"), ("season", "s"), ("is_summer", "i"),
    ("temp_sq", "d"), ("is_hot", "i"), ("is_cold", "i"), ("temp_x_humidity", "d"), ("temp_dev_from_month", "d"),
    ("use_7d_30d_ratio", "d"), ("use_roll30_std", "d"), ("past_event_rate", "d"), ("events_last_90", "d"),
    ("temp_7d_mean", "d"), ("temp_7d_max", "d"), ("temp_30d_max", "d"),
    ("hot_days_7d", "d"), ("hot_days_14d", "d"), ("cold_days_7d", "d"),
    ("is_precip", "i"), ("is_rain", "i"), ("is_snow", "i"),
    ("use_per_day_since_maint", "d"), ("age_x_use_since_maint", "l"), ("age_x_use_30d", "l"),
    ("use_today_vs_7d_avg", "d"),
    ("log_days_since_event", "d"), ("recent_event_30d", "i"), ("recent_event_90d", "i"),
]
FEATURE_TABLE = IDS + RAW + DERIVED + LABELS


def feature_table(spark, sf):
    return engineer_features(fixture_panel(spark, sf), S)


def _subset(key: str, cols):
    out = IDS + cols

    @register(key, f"WITH {FEATURES_SQL}\nSELECT {typed_sql(out)} FROM feat")
    def q(spark, sf):
        return typed(feature_table(spark, sf), out)

    return q


_subset("engineer_features", RAW + DERIVED + LABELS)
_subset("calendar_features", [("month", "i"), ("dayofweek", "i")])
_subset("cyclic_day_encoding", [("doy_sin", "d"), ("doy_cos", "d")])
_subset("season_bucket", [("season", "s")])
_subset("is_summer", [("is_summer", "i")])
_subset("thermal_stress", [("temp_sq", "d"), ("is_hot", "i"), ("is_cold", "i"), ("temp_x_humidity", "d")])
_subset("deviation_from_month_mean", [("temp_dev_from_month", "d")])
_subset("usage_ratio", [("use_7d_30d_ratio", "d")])
_subset("rolling_usage_std", [("use_roll30_std", "d")])
_subset("past_event_rate", [("past_event_rate", "d")])
_subset("events_last_90_rows", [("events_last_90", "d")])
_subset("join_daily_exogenous", [("temp", "d"), ("temp_7d_mean", "d"), ("temp_7d_max", "d"), ("temp_30d_max", "d"),
                                 ("hot_days_7d", "d"), ("hot_days_14d", "d"), ("cold_days_7d", "d")])
_subset("weather_code_flags", [("weather_type", "i"), ("is_precip", "i"), ("is_rain", "i"), ("is_snow", "i")])
_subset("maintenance_intensity", [("use_per_day_since_maint", "d")])
_subset("age_interactions", [("age_x_use_since_maint", "l"), ("age_x_use_30d", "l")])
_subset("usage_vs_weekly_avg", [("use_today_vs_7d_avg", "d")])
_subset("recency_transforms", [("log_days_since_event", "d"), ("recent_event_30d", "i"), ("recent_event_90d", "i")])


def column_counts(df, names):
    """(column_name, n): non-null rows of each column, from one scan."""
    wide = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(names)])
    pairs = ", ".join(f"'{c}', n{i}" for i, c in enumerate(names))
    return wide.selectExpr(f"stack({len(names)}, {pairs}) AS (column_name, n)")


def column_counts_sql(names):
    return f"""WITH {FEATURES_SQL}
SELECT unnest(k) AS column_name, unnest(c) AS n
FROM (SELECT [{", ".join(f"'{c}'" for c in names)}] AS k, [{", ".join(f"COUNT({c})" for c in names)}] AS c FROM feat)"""


@register("drop_helper_columns", column_counts_sql([c for c, _ in FEATURE_TABLE]))
def q_drop_helper_columns(spark, sf):
    """The engineered table's columns are the published ones: no helper is left."""
    df = feature_table(spark, sf)
    return column_counts(df, df.columns)


@register("feature_columns", column_counts_sql([c for c, _ in RAW + DERIVED]))
def q_feature_columns(spark, sf):
    """What a model may read: everything but ids and labels."""
    df = feature_table(spark, sf)
    return column_counts(df, feature_columns(df, S))


PAST_COUNTS = IDS + [("event", "i"), ("past_events", "l"), ("past_observations", "l")]


@register("past_event_count", f"""
WITH {FEATURES_SQL}
SELECT {typed_sql(PAST_COUNTS)} FROM f2
""")
def q_past_event_count(spark, sf):
    p = events.with_events(fixture_panel(spark, sf), S)
    p = p.withColumn("past_events", windows.past_sum("event", S)).withColumn(
        "past_observations", windows.past_observations(S))
    return typed(p, PAST_COUNTS)


@register("past_observation_count", f"""
WITH {FEATURES_SQL}
SELECT {typed_sql(IDS + [("past_observations", "l")])} FROM f1
""")
def q_past_observation_count(spark, sf):
    p = fixture_panel(spark, sf).withColumn("past_observations", windows.past_observations(S))
    return typed(p, IDS + [("past_observations", "l")])


@register("first_row_per_date", f"""
WITH {FEATURES_SQL}
SELECT date, ROUND(temp, 6) AS temp FROM dw
""")
def q_first_row_per_date(spark, sf):
    d = joins.first_entity_value_per_date(fixture_panel(spark, sf), S, "temp")
    return d.select("date", F.round("temp", 6).alias("temp"))


ROLLED = [("date", "t"), ("temp_7d_mean", "d"), ("temp_7d_max", "d"), ("temp_30d_max", "d")]
EXTREME = [("date", "t"), ("hot_days_7d", "d"), ("hot_days_14d", "d"), ("cold_days_7d", "d")]


def _rolled(spark, sf):
    d = joins.first_entity_value_per_date(fixture_panel(spark, sf), S, "temp")
    return windows.rolling_over_days(d, "date", "temp")


@register("rolling_exogenous", f"WITH {FEATURES_SQL}\nSELECT {typed_sql(ROLLED)} FROM dr")
def q_rolling_exogenous(spark, sf):
    return typed(_rolled(spark, sf), ROLLED)


@register("rolling_extreme_days", f"WITH {FEATURES_SQL}\nSELECT {typed_sql(EXTREME)} FROM dr")
def q_rolling_extreme_days(spark, sf):
    return typed(_rolled(spark, sf), EXTREME)
