"""Queries over the fixture panel: events, fleet series."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.operators import events, series
from panelrisk.queries import register
from panelrisk.sources.fixture import fixture_panel
from panelrisk.spec import FIXTURE_SPEC as S


def panel_with_events(spark, sf):
    return events.with_events(fixture_panel(spark, sf), S)


EVENTS_SQL = """
ev AS (
  SELECT *, COALESCE(CAST(days_since_last_event < LAG(days_since_last_event)
           OVER (PARTITION BY entity_id ORDER BY date) AS INTEGER), 0) AS event
  FROM panel
)"""


@register("event_from_counter_reset", f"""
WITH {EVENTS_SQL}
SELECT entity_id, date, days_since_last_event, event FROM ev
""")
def q_event_from_counter_reset(spark, sf):
    return panel_with_events(spark, sf).select("entity_id", "date", "days_since_last_event", "event")


def fleet_daily(spark, sf):
    return series.daily_sum(panel_with_events(spark, sf), "date", "event")


@register("fleet_daily_events", f"""
WITH {EVENTS_SQL}
SELECT date AS ds, CAST(SUM(event) AS BIGINT) AS y FROM ev GROUP BY date
""")
def q_fleet_daily_events(spark, sf):
    return fleet_daily(spark, sf)


DENSE_SQL = f"""{EVENTS_SQL},
daily AS (SELECT date AS ds, CAST(SUM(event) AS BIGINT) AS y FROM ev GROUP BY date),
cal AS (SELECT CAST(unnest(generate_series(MIN(ds), MAX(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM daily),
dense AS (SELECT cal.ds, CAST(COALESCE(daily.y, 0) AS BIGINT) AS y FROM cal LEFT JOIN daily ON cal.ds = daily.ds)"""


@register("densify_calendar", f"""
WITH {DENSE_SQL}
SELECT ds, y FROM dense
""")
def q_densify_calendar(spark, sf):
    return series.densify(fleet_daily(spark, sf), {"y": 0}).select("ds", "y")


@register("fleet_weekly_events", f"""
WITH {DENSE_SQL}
SELECT CAST(ds + CAST((7 - isodow(ds)) % 7 AS INTEGER) AS DATE) AS ds, CAST(SUM(y) AS BIGINT) AS y
FROM dense GROUP BY 1
""")
def q_fleet_weekly_events(spark, sf):
    return series.weekly(series.densify(fleet_daily(spark, sf), {"y": 0}), ["y"])
