"""DuckDB form of the feature table, used by oracle queries (CTE ``feat``)."""

FEATURES_SQL = """
f1 AS (
  SELECT p.*,
    CAST(month(date) AS INTEGER) AS month,
    CAST(isodow(date) - 1 AS INTEGER) AS dayofweek,
    SIN(2 * PI() * dayofyear(date) / 365.25) AS doy_sin,
    COS(2 * PI() * dayofyear(date) / 365.25) AS doy_cos,
    ['winter', 'spring', 'summer', 'autumn'][(month(date) % 12) // 3 + 1] AS season,
    CASE WHEN month(date) IN (6, 7, 8) THEN 1 ELSE 0 END AS is_summer,
    POW(temp, 2) AS temp_sq,
    CAST(COALESCE(temp >= 30, false) AS INTEGER) AS is_hot,
    CAST(COALESCE(temp <= 0, false) AS INTEGER) AS is_cold,
    temp * humidity AS temp_x_humidity,
    CAST(use_last_7d AS DOUBLE) / (CAST(use_last_30d AS DOUBLE) + 1e-6) AS use_7d_30d_ratio,
    CASE WHEN COUNT(use_today) OVER w30 >= 5 THEN STDDEV_SAMP(use_today) OVER w30 END AS use_roll30_std,
    COALESCE(CAST(days_since_last_event < LAG(days_since_last_event) OVER w AS INTEGER), 0) AS event,
    ROW_NUMBER() OVER w - 1 AS past_observations
  FROM panel p
  WINDOW w AS (PARTITION BY entity_id ORDER BY date),
         w30 AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)
),
f2 AS (
  SELECT *,
    COALESCE(SUM(event) OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past_events,
    CAST(COALESCE(SUM(event) OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS events_last_90
  FROM f1
),
mm AS (SELECT month, AVG(temp) AS month_temp FROM f1 GROUP BY month),
dw AS (SELECT date, arg_min(temp, entity_id) AS temp FROM panel GROUP BY date),
dr AS (
  SELECT date,
    AVG(temp) OVER d7 AS temp_7d_mean,
    MAX(temp) OVER d7 AS temp_7d_max,
    MAX(temp) OVER d30 AS temp_30d_max,
    CAST(SUM(CAST(COALESCE(temp >= 30, false) AS INTEGER)) OVER d7 AS DOUBLE) AS hot_days_7d,
    CAST(SUM(CAST(COALESCE(temp >= 30, false) AS INTEGER)) OVER d14 AS DOUBLE) AS hot_days_14d,
    CAST(SUM(CAST(COALESCE(temp <= 0, false) AS INTEGER)) OVER d7 AS DOUBLE) AS cold_days_7d
  FROM dw
  WINDOW d7 AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         d14 AS (ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
         d30 AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
),
feat AS (
  SELECT f2.* EXCLUDE (event, past_events, past_observations),
    f2.temp - mm.month_temp AS temp_dev_from_month,
    CASE WHEN past_observations = 0 THEN 0.0 ELSE CAST(past_events AS DOUBLE) / past_observations END AS past_event_rate,
    dr.temp_7d_mean, dr.temp_7d_max, dr.temp_30d_max, dr.hot_days_7d, dr.hot_days_14d, dr.cold_days_7d,
    CAST(COALESCE(weather_type >= 51, false) AS INTEGER) AS is_precip,
    CAST(COALESCE(weather_type BETWEEN 61 AND 69, false) AS INTEGER) AS is_rain,
    CAST(COALESCE(weather_type BETWEEN 71 AND 79, false) AS INTEGER) AS is_snow,
    CAST(use_since_last_maintenance AS DOUBLE) / (CAST(days_since_last_maintenance AS DOUBLE) + 1e-6) AS use_per_day_since_maint,
    CAST(entity_age AS BIGINT) * use_since_last_maintenance AS age_x_use_since_maint,
    CAST(entity_age AS BIGINT) * use_last_30d AS age_x_use_30d,
    CAST(use_today AS DOUBLE) / (use_last_7d / 7 + 1e-6) AS use_today_vs_7d_avg,
    LN(1 + days_since_last_event) AS log_days_since_event,
    CAST(COALESCE(days_since_last_event <= 30, false) AS INTEGER) AS recent_event_30d,
    CAST(COALESCE(days_since_last_event <= 90, false) AS INTEGER) AS recent_event_90d
  FROM f2 JOIN mm USING (month) LEFT JOIN dr USING (date)
)"""
