"""Splits, sampling, labels and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.operators import aggregates, events, sampling, series, splits
from panelrisk.operators.oversampling import smote_minority
from panelrisk.queries import register
from panelrisk.queries.common import typed, typed_sql
from panelrisk.queries.q_panel import DENSE_SQL, EVENTS_SQL, fleet_daily
from panelrisk.sources.fixture import fixture_panel
from panelrisk.sources.variants import dataset_variants
from panelrisk.spec import FIXTURE_SPEC as S

LABEL = S.label
DN = "CAST(date - DATE '1970-01-01' AS DOUBLE)"
SPLIT_SQL = f"""
sb AS (SELECT MIN({DN}) AS d0, MAX({DN}) AS d1, MAX(date) AS dmax FROM panel),
sp AS (
  SELECT panel.*, CASE WHEN {DN} - d0 <= 0.8 * (d1 - d0) THEN 'train' ELSE 'test' END AS split
  FROM panel, sb
)"""
MD5 = "md5(CAST(entity_id AS VARCHAR) || '|' || CAST(date AS VARCHAR) || '-42')"


def split_panel(spark, sf):
    return splits.calendar_split(fixture_panel(spark, sf), S)


@register("calendar_split", f"WITH {SPLIT_SQL}\nSELECT entity_id, date, split FROM sp")
def q_calendar_split(spark, sf):
    return split_panel(spark, sf).select("entity_id", "date", "split")


@register("trim_test_end", f"""
WITH {SPLIT_SQL}
SELECT entity_id, date, split FROM sp, sb WHERE split = 'train' OR date <= CAST(dmax - INTERVAL 30 DAY AS DATE)
""")
def q_trim_test_end(spark, sf):
    p = split_panel(spark, sf)
    end = p.agg(F.date_sub(F.max("date"), 30).alias("_end"))
    p = p.crossJoin(F.broadcast(end))
    return p.filter((F.col("split") == "train") | (F.col("date") <= F.col("_end"))).select("entity_id", "date", "split")


@register("time_position", """
SELECT entity_id, date, CAST(ROW_NUMBER() OVER (ORDER BY date, entity_id) - 1 AS BIGINT) AS pos FROM panel
""")
def q_time_position(spark, sf):
    return typed(splits.time_positions(fixture_panel(spark, sf), S), [("entity_id", "l"), ("date", "t"), ("pos", "l")])


@register("validation_tail", f"""
WITH {SPLIT_SQL},
tr AS (SELECT entity_id, date, ROW_NUMBER() OVER (ORDER BY date, entity_id) - 1 AS pos,
              COUNT(*) OVER () AS n FROM sp WHERE split = 'train')
SELECT entity_id, date, CASE WHEN pos < FLOOR(n * 0.75) THEN 'fit' ELSE 'validation' END AS role FROM tr
""")
def q_validation_tail(spark, sf):
    tr = split_panel(spark, sf).filter("split = 'train'")
    return splits.validation_tail(tr, S).select("entity_id", "date", "role")


@register("expanding_folds", """
WITH r AS (SELECT entity_id, date, ROW_NUMBER() OVER (ORDER BY date, entity_id) - 1 AS pos,
                  COUNT(*) OVER () AS n FROM panel),
t AS (SELECT *, n // 6 AS t, n - 5 * (n // 6) AS first_test FROM r)
SELECT entity_id, date, CAST(pos AS BIGINT) AS pos,
       CAST(COALESCE(CASE WHEN pos >= first_test AND (pos - first_test) // t < 5 THEN (pos - first_test) // t END, -1) AS INTEGER) AS test_fold
FROM t
""")
def q_expanding_folds(spark, sf):
    f = splits.expanding_folds(fixture_panel(spark, sf), S, k=5)
    f = f.withColumn("test_fold", F.coalesce("test_fold", F.lit(-1)))  # -1: in no test window
    return typed(f, [("entity_id", "l"), ("date", "t"), ("pos", "l"), ("test_fold", "i")])


@register("row_count_split", f"""
WITH {DENSE_SQL},
wk AS (SELECT CAST(ds + CAST((7 - isodow(ds)) % 7 AS INTEGER) AS DATE) AS ds, CAST(SUM(y) AS BIGINT) AS y FROM dense GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ds) - 1 AS i, COUNT(*) OVER () AS n FROM wk)
SELECT ds, y, CASE WHEN i < FLOOR(n * 0.8) THEN 'train' ELSE 'holdout' END AS split FROM r
""")
def q_row_count_split(spark, sf):
    wk = series.weekly(series.densify(fleet_daily(spark, sf), {"y": 0}), ["y"])
    return splits.row_count_split(wk).select("ds", "y", "split")


@register("label_forward_window", f"""
WITH {EVENTS_SQL},
nx AS (SELECT entity_id, date, MIN(CASE WHEN event = 1 THEN date END) OVER (PARTITION BY entity_id ORDER BY date
          ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
          MAX(date) OVER () AS dmax FROM ev)
SELECT entity_id, date,
  CAST(COALESCE(nxt - date <= 7, false) AS INTEGER) AS label_7,
  CAST(COALESCE(nxt - date <= 30, false) AS INTEGER) AS label_30,
  CAST(dmax - date >= 7 AS INTEGER) AS label_complete_7,
  CAST(dmax - date >= 30 AS INTEGER) AS label_complete_30
FROM nx
""")
def q_label_forward_window(spark, sf):
    p = events.with_events(fixture_panel(spark, sf), S)
    lab = events.forward_event_label(p, S, "event")
    return lab.select("entity_id", "date", "label_7", "label_30", "label_complete_7", "label_complete_30")


UNDER_SQL = """
r AS (SELECT entity_id, date, event_next_30d,
             ROW_NUMBER() OVER (PARTITION BY event_next_30d = 0 ORDER BY {md5}) - 1 AS rk FROM panel),
c AS (SELECT SUM(CASE WHEN event_next_30d <> 0 THEN 1 ELSE 0 END) AS n_min,
             SUM(CASE WHEN event_next_30d = 0 THEN 1 ELSE 0 END) AS n_maj FROM panel)
SELECT entity_id, date, event_next_30d FROM r, c
WHERE event_next_30d <> 0 OR rk < LEAST(n_maj, FLOOR(n_min * {mult}))"""


@register("undersample_majority_exact", "WITH " + UNDER_SQL.format(md5=MD5, mult="1.0"))
def q_undersample_majority_exact(spark, sf):
    u = sampling.undersample_majority(fixture_panel(spark, sf), S, LABEL, ratio=1.0)
    return u.select("entity_id", "date", LABEL)


@register("undersample_to_ratio", "WITH " + UNDER_SQL.format(md5=MD5, mult="(1.0 / 0.5)"))
def q_undersample_to_ratio(spark, sf):
    u = sampling.undersample_to_ratio(fixture_panel(spark, sf), S, LABEL, ratio=0.5)
    return u.select("entity_id", "date", LABEL)


SMOTE_NUMERIC = ["use_today", "use_last_7d", "days_since_last_maintenance", "temp", "humidity"]


@register("smote_minority", """
WITH c AS (SELECT SUM(CASE WHEN event_next_30d = 0 THEN 1 ELSE 0 END) AS n0, SUM(CASE WHEN event_next_30d = 1 THEN 1 ELSE 0 END) AS n1 FROM panel)
SELECT ratio, label, CAST(rows AS BIGINT) AS rows, 0 AS outside FROM (
  SELECT 1.0 AS ratio, 0 AS label, n0 AS rows FROM c UNION ALL SELECT 1.0, 1, GREATEST(n0, n1) FROM c
  UNION ALL SELECT 0.5, 0, n0 FROM c UNION ALL SELECT 0.5, 1, GREATEST(CAST(FLOOR(n0 * 0.5) AS BIGINT), n1) FROM c)""")
def q_smote_minority(spark, sf):
    """Rows per class after oversampling, and the values outside the minority's own range (none)."""
    panel = fixture_panel(spark, sf)
    own = panel.filter(F.col(LABEL) == 1).agg(*[f(c).alias(f"{n}_{c}") for c in SMOTE_NUMERIC for n, f in (("lo", F.min), ("hi", F.max))])
    out = None
    for ratio in (1.0, 0.5):
        grown = smote_minority(panel, S, LABEL, SMOTE_NUMERIC, ["entity_type", "weather_type"], ratio=ratio).crossJoin(F.broadcast(own))
        off = F.lit(False)
        for c in SMOTE_NUMERIC:
            off = off | ~F.col(c).between(F.col(f"lo_{c}") - 1e-9, F.col(f"hi_{c}") + 1e-9)
        got = grown.groupBy(F.col(LABEL).alias("label")).agg(F.count(F.lit(1)).alias("rows"), F.sum((off & (F.col(LABEL) == 1)).cast("int")).alias("outside"))
        got = got.select(F.lit(ratio).alias("ratio"), "label", "rows", "outside")
        out = got if out is None else out.unionByName(got)
    return typed(out, [("ratio", "d"), ("label", "i"), ("rows", "l"), ("outside", "i")])


@register("thin_test_negatives", f"""
WITH {SPLIT_SQL},
t AS (SELECT * FROM sp WHERE split = 'test'),
r AS (SELECT entity_id, date, event_next_30d, ROW_NUMBER() OVER (ORDER BY {MD5}) - 1 AS rk FROM t WHERE event_next_30d = 0),
k AS (SELECT ROUND_EVEN(COUNT(*) * 0.5, 0) AS keep FROM t WHERE event_next_30d = 0)
SELECT entity_id, date, event_next_30d FROM t WHERE event_next_30d <> 0
UNION ALL
SELECT entity_id, date, event_next_30d FROM r, k WHERE rk < keep
""")
def q_thin_test_negatives(spark, sf):
    t = split_panel(spark, sf).filter("split = 'test'")
    return sampling.thin_negatives(t, S, LABEL, 0.5).select("entity_id", "date", LABEL)


@register("sample_for_explain", f"""
WITH {SPLIT_SQL}
SELECT entity_id, date FROM sp WHERE split = 'test' ORDER BY {MD5} LIMIT 2000
""")
def q_sample_for_explain(spark, sf):
    t = split_panel(spark, sf).filter("split = 'test'")
    return sampling.sample_rows(t, S, 2000).select("entity_id", "date")


BAL = [("split", "s"), ("positives", "l"), ("negatives", "l"), ("scale_pos_weight", "d"), ("base_rate", "d")]


@register("class_balance", f"""
WITH {SPLIT_SQL}
SELECT split, CAST(SUM(CASE WHEN event_next_30d = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
  CAST(SUM(CASE WHEN event_next_30d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
  ROUND(CAST(SUM(CASE WHEN event_next_30d = 0 THEN 1 ELSE 0 END) AS DOUBLE)
        / GREATEST(SUM(CASE WHEN event_next_30d = 1 THEN 1 ELSE 0 END), 1), 6) AS scale_pos_weight,
  ROUND(AVG(CAST(event_next_30d AS DOUBLE)), 6) AS base_rate
FROM sp GROUP BY split
""")
def q_class_balance(spark, sf):
    return typed(aggregates.class_balance(split_panel(spark, sf), LABEL, ["split"]), BAL)


DIAG = [("split", "s"), ("rows", "l"), ("min_date", "t"), ("max_date", "t"), ("pos_rate", "d"), ("summer_share", "d")]


@register("split_diagnosis", f"""
WITH {SPLIT_SQL}
SELECT split, CAST(COUNT(*) AS BIGINT) AS rows, MIN(date) AS min_date, MAX(date) AS max_date,
  ROUND(AVG(CAST(event_next_30d AS DOUBLE)), 6) AS pos_rate,
  ROUND(AVG(CASE WHEN month(date) IN (6, 7, 8) THEN 1.0 ELSE 0.0 END), 6) AS summer_share
FROM sp GROUP BY split
""")
def q_split_diagnosis(spark, sf):
    return typed(aggregates.split_diagnosis(split_panel(spark, sf), S, LABEL), DIAG)


PROF = [("total", "d"), ("periods", "l"), ("min_ds", "t"), ("max_ds", "t"), ("mean_y", "d"), ("min_y", "d"),
        ("max_y", "d")]


@register("series_profile", f"""
WITH {DENSE_SQL},
wk AS (SELECT CAST(ds + CAST((7 - isodow(ds)) % 7 AS INTEGER) AS DATE) AS ds, SUM(y) AS y FROM dense GROUP BY 1)
SELECT ROUND(CAST(SUM(y) AS DOUBLE), 6) AS total,
  CAST(COUNT(*) AS BIGINT) AS periods, MIN(ds) AS min_ds, MAX(ds) AS max_ds,
  ROUND(AVG(y), 6) AS mean_y, ROUND(CAST(MIN(y) AS DOUBLE), 6) AS min_y, ROUND(CAST(MAX(y) AS DOUBLE), 6) AS max_y
FROM wk
""")
def q_series_profile(spark, sf):
    wk = series.weekly(series.densify(fleet_daily(spark, sf), {"y": 0}), ["y"])
    return typed(aggregates.series_profile(wk), PROF)


SEAS = [("level", "s"), ("season", "s"), ("month", "i"), ("events", "l"), ("rows", "l")]


@register("seasonal_event_totals", f"""
WITH {EVENTS_SQL},
d AS (SELECT CAST(month(date) AS INTEGER) AS month,
             ['winter', 'spring', 'summer', 'autumn'][(month(date) % 12) // 3 + 1] AS season, event FROM ev)
SELECT CASE GROUPING(season, month) WHEN 1 THEN 'season' WHEN 2 THEN 'month' ELSE 'total' END AS level,
  COALESCE(season, 'all') AS season, CAST(COALESCE(month, 0) AS INTEGER) AS month, CAST(SUM(event) AS BIGINT) AS events, CAST(COUNT(*) AS BIGINT) AS rows
FROM d GROUP BY GROUPING SETS ((season), (month), ())
""")
def q_seasonal_event_totals(spark, sf):
    p = events.with_events(fixture_panel(spark, sf), S)
    t = aggregates.event_totals_by_season_month(p, S, "event")
    t = t.withColumn("season", F.coalesce("season", F.lit("all"))).withColumn("month", F.coalesce("month", F.lit(0)))
    return typed(t, SEAS)


ENT = [("entities", "l"), ("mean_events", "d"), ("median_events", "d"), ("max_events", "d"),
       ("mean_zero_week_share", "d")]


@register("entity_event_profile", f"""
WITH {EVENTS_SQL},
e AS (SELECT *, CAST(date + CAST((7 - isodow(date)) % 7 AS INTEGER) AS DATE) AS wk FROM ev),
per AS (SELECT entity_id, SUM(event) AS events, MIN(wk) AS w0, MAX(wk) AS w1,
               COUNT(DISTINCT CASE WHEN event > 0 THEN wk END) AS event_weeks FROM e GROUP BY entity_id)
SELECT CAST(COUNT(*) AS BIGINT) AS entities, ROUND(AVG(events), 6) AS mean_events,
  ROUND(quantile_cont(events, 0.5), 6) AS median_events, ROUND(CAST(MAX(events) AS DOUBLE), 6) AS max_events,
  ROUND(AVG(1 - event_weeks / ((w1 - w0) / 7 + 1)), 6) AS mean_zero_week_share
FROM per
""")
def q_entity_event_profile(spark, sf):
    p = events.with_events(fixture_panel(spark, sf), S)
    return typed(aggregates.entity_event_profile(p, S, "event"), ENT)


VARIANTS_SQL = """
vb AS (SELECT year(MAX(date)) AS last_year, FLOOR(MAX(entity_id) * 0.9) AS cut FROM panel),
variants AS (
  SELECT panel.*, 'full' AS dataset FROM panel
  UNION ALL SELECT panel.*, 'no_last_year' FROM panel, vb WHERE year(date) < last_year
  UNION ALL SELECT panel.*, 'until_entity' FROM panel, vb WHERE entity_id <= cut
  UNION ALL SELECT panel.*, 'no_last_year_until_entity' FROM panel, vb WHERE year(date) < last_year AND entity_id <= cut
)"""


@register("dataset_variants", f"WITH {VARIANTS_SQL}\nSELECT dataset, entity_id, date FROM variants")
def q_dataset_variants(spark, sf):
    return dataset_variants(fixture_panel(spark, sf), S).select("dataset", "entity_id", "date")


DSP = [("dataset", "s"), ("min_date", "t"), ("max_date", "t"), ("entities", "l"), ("rows", "l"), ("label_rate", "d")]


@register("dataset_profile", f"""
WITH {VARIANTS_SQL}
SELECT dataset, MIN(date) AS min_date, MAX(date) AS max_date, CAST(COUNT(DISTINCT entity_id) AS BIGINT) AS entities,
  CAST(COUNT(*) AS BIGINT) AS rows, ROUND(AVG(CAST(event_next_30d AS DOUBLE)), 6) AS label_rate
FROM variants GROUP BY dataset
""")
def q_dataset_profile(spark, sf):
    v = dataset_variants(fixture_panel(spark, sf), S)
    return typed(aggregates.dataset_profile(v, S, LABEL), DSP)


# Fixed rule set (temperature, maintenance and event recency thresholds).
RULES = {
    "temp_gt_25": "temp > 25",
    "temp_gt_25_maint_lt_30_event_lt_30": "temp > 25 AND days_since_last_maintenance < 30 AND days_since_last_event < 30",
    "temp_gt_28_maint_lt_20_event_lt_20": "temp > 28 AND days_since_last_maintenance < 20 AND days_since_last_event < 20",
}


def _rule_sql():
    parts = []
    for name, cond in RULES.items():
        parts.append(f"""SELECT '{name}' AS rule, CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS n,
  ROUND(SUM(CASE WHEN {cond} THEN event_next_30d ELSE 0 END) / SUM(CASE WHEN {cond} THEN 1 ELSE 0 END), 6) AS rate,
  ROUND((SUM(CASE WHEN {cond} THEN event_next_30d ELSE 0 END) / SUM(CASE WHEN {cond} THEN 1 ELSE 0 END))
        / (SUM(event_next_30d) / COUNT(*)), 6) AS lift
FROM panel""")
    return "\nUNION ALL\n".join(parts)


@register("subgroup_rule_lift", _rule_sql())
def q_subgroup_rule_lift(spark, sf):
    rules = {k: F.expr(v) for k, v in RULES.items()}
    r = aggregates.rule_lift(fixture_panel(spark, sf), rules, LABEL)
    return typed(r, [("rule", "s"), ("n", "l"), ("rate", "d"), ("lift", "d")])


@register("union_rows", f"""
WITH {SPLIT_SQL},
t AS (SELECT * FROM sp WHERE split = 'train'),
r AS (SELECT entity_id, date, event_next_30d, ROW_NUMBER() OVER (ORDER BY {MD5}) - 1 AS rk FROM t WHERE event_next_30d = 0),
c AS (SELECT SUM(CASE WHEN event_next_30d <> 0 THEN 1 ELSE 0 END) AS n_min, SUM(CASE WHEN event_next_30d = 0 THEN 1 ELSE 0 END) AS n_maj FROM t)
SELECT entity_id, date, event_next_30d FROM t WHERE event_next_30d <> 0
UNION ALL
SELECT entity_id, date, event_next_30d FROM r, c WHERE rk < LEAST(n_maj, FLOOR(n_min * 1.0))
""")
def q_union_rows(spark, sf):
    """Train-only balancing (the default scope): positives UNION ALL the kept negatives."""
    tr = split_panel(spark, sf).filter("split = 'train'")
    return sampling.undersample_majority(tr, S, LABEL, 1.0).select("entity_id", "date", LABEL)


@register("filter_entity", f"""
WITH {EVENTS_SQL},
one AS (SELECT MIN(entity_id) AS e FROM panel)
SELECT date, CAST(event AS INTEGER) AS event FROM ev, one WHERE entity_id = e
""")
def q_filter_entity(spark, sf):
    """One entity's events, filtered after event derivation."""
    from panelrisk.plans.forecast_entity import entity_events

    p = fixture_panel(spark, sf)
    first = p.agg(F.min("entity_id")).collect()[0][0]
    return entity_events(p, S, first).select("date", F.col("event").cast("int").alias("event"))
