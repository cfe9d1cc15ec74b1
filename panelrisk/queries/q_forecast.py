"""Forecasting queries: series, baselines, holdout and rolling-origin evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.functions.columns import verdict
from panelrisk.operators import forecast as fc
from panelrisk.operators import joins, metrics, series
from panelrisk.queries import register
from panelrisk.queries.common import typed
from panelrisk.queries.q_panel import EVENTS_SQL
from panelrisk.sources.fixture import fixture_panel
from panelrisk.spec import FIXTURE_SPEC as S

# Fixed parameters of the weekly runs: masked ranges, season length, horizon.
MASK = "1997-05-01:1997-06-30,2000-12-01:2001-01-31"
PERIOD = 52
HORIZON = 8
HORIZON_DAYS = 56


def _interp_sql(src: str, cols: list[str], part: str = "") -> str:
    pb = f"PARTITION BY {part} " if part else ""
    back = f"OVER ({pb}ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    fwd = f"OVER ({pb}ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    inner = [f"{src}.*", "CAST(ds - DATE '1970-01-01' AS DOUBLE) AS dn"]
    for c in cols:
        inner += [
            f"last_value({c} IGNORE NULLS) {back} AS {c}_pv",
            f"last_value(CASE WHEN {c} IS NOT NULL THEN CAST(ds - DATE '1970-01-01' AS DOUBLE) END IGNORE NULLS) {back} AS {c}_pp",
            f"first_value({c} IGNORE NULLS) {fwd} AS {c}_nv",
            f"first_value(CASE WHEN {c} IS NOT NULL THEN CAST(ds - DATE '1970-01-01' AS DOUBLE) END IGNORE NULLS) {fwd} AS {c}_np",
        ]
    outer = [f"{part}, ds" if part else "ds"]
    for c in cols:
        outer.append(
            f"CASE WHEN {c} IS NOT NULL THEN CAST({c} AS DOUBLE) "
            f"WHEN {c}_pv IS NOT NULL AND {c}_nv IS NOT NULL THEN {c}_pv + ({c}_nv - {c}_pv) * (dn - {c}_pp) / ({c}_np - {c}_pp) "
            f"WHEN {c}_pv IS NOT NULL THEN CAST({c}_pv AS DOUBLE) ELSE CAST({c}_nv AS DOUBLE) END AS {c}")
    return f"SELECT {', '.join(outer)} FROM (SELECT {', '.join(inner)} FROM {src})"


TS_SQL = f"""{EVENTS_SQL},
daily AS (SELECT date AS ds, CAST(SUM(event) AS DOUBLE) AS y FROM ev GROUP BY date),
cal AS (SELECT CAST(unnest(generate_series(MIN(ds), MAX(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM daily),
dy AS (SELECT cal.ds, COALESCE(daily.y, 0.0) AS y FROM cal LEFT JOIN daily USING (ds)),
wm AS (SELECT date AS ds, AVG(temp) AS temp, AVG(humidity) AS humidity FROM panel GROUP BY date),
wc AS (SELECT cal.ds, wm.temp, wm.humidity FROM cal LEFT JOIN wm USING (ds)),
wi AS ({_interp_sql('wc', ['temp', 'humidity'])}),
dd AS (SELECT dy.ds, dy.y, wi.temp, wi.humidity FROM dy JOIN wi USING (ds)),
ts AS (SELECT CAST(ds + CAST((7 - isodow(ds)) % 7 AS INTEGER) AS DATE) AS ds, SUM(y) AS y,
              AVG(temp) AS temp, AVG(humidity) AS humidity FROM dd GROUP BY 1)"""

MASK_SQL = " OR ".join(f"ds BETWEEN DATE '{s}' AND DATE '{e}'" for s, e in fc.parse_ranges(MASK))
HOLD_SQL = f"""{TS_SQL},
mk AS (SELECT ds, CASE WHEN {MASK_SQL} THEN NULL ELSE y END AS y, CAST({MASK_SQL} AS INTEGER) AS masked, temp, humidity FROM ts),
hs AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ds) - 1 AS t, FLOOR(COUNT(*) OVER () * 0.8) AS n_train FROM mk),
sp AS (SELECT *, CASE WHEN t < n_train THEN 'train' ELSE 'holdout' END AS split FROM hs),
nm AS (SELECT AVG(y) AS naive_mean FROM sp WHERE split = 'train'),
tf AS (SELECT regr_intercept(y, t) AS a, regr_slope(y, t) AS b FROM sp WHERE split = 'train' AND y IS NOT NULL),
pr AS (SELECT sp.*, nm.naive_mean, COALESCE(LAG(y, {PERIOD}) OVER (ORDER BY t), nm.naive_mean) AS snaive,
              GREATEST(tf.a + tf.b * t, 0.0) AS trend FROM sp, nm, tf)"""


def weekly_ts(spark, sf, with_weather=True):
    return fc.build_timeseries(fixture_panel(spark, sf), S, "W", with_weather)


def holdout(spark, sf):
    ts = fc.mask_ranges(weekly_ts(spark, sf), MASK)
    sp = fc.holdout_split(ts)
    sn = fc.seasonal_naive(sp, PERIOD)
    return fc.trend_forecast(sn)


TS = [("ds", "t"), ("y", "d"), ("temp", "d"), ("humidity", "d")]


@register("build_timeseries", f"WITH {TS_SQL}\nSELECT ds, ROUND(y, 6) AS y, ROUND(temp, 6) AS temp, ROUND(humidity, 6) AS humidity FROM ts")
def q_build_timeseries(spark, sf):
    return typed(weekly_ts(spark, sf), TS)


@register("daily_exogenous_mean", "SELECT date AS ds, ROUND(AVG(temp), 6) AS temp, ROUND(AVG(humidity), 6) AS humidity FROM panel GROUP BY date")
def q_daily_exogenous_mean(spark, sf):
    d = series.daily_mean(fixture_panel(spark, sf), "date", ["temp", "humidity"])
    return typed(d, TS[:1] + TS[2:])


@register("join_series_regressors", f"WITH {TS_SQL}\nSELECT ds, ROUND(y, 6) AS y, ROUND(temp, 6) AS temp, ROUND(humidity, 6) AS humidity FROM dd")
def q_join_series_regressors(spark, sf):
    fc_daily = fc.build_timeseries(fixture_panel(spark, sf), S, "D", True)
    return typed(fc_daily, TS)


@register("weekly_regressor_mean", f"WITH {TS_SQL}\nSELECT ds, ROUND(temp, 6) AS temp, ROUND(humidity, 6) AS humidity FROM ts")
def q_weekly_regressor_mean(spark, sf):
    return typed(weekly_ts(spark, sf), TS[:1] + TS[2:])


@register("interpolate_gaps", f"""WITH
ed AS (SELECT entity_id, date AS ds, temp FROM panel),
ec AS (SELECT entity_id, CAST(unnest(generate_series(MIN(ds), MAX(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM ed GROUP BY entity_id),
eg AS (SELECT ec.entity_id, ec.ds, ed.temp FROM ec LEFT JOIN ed USING (entity_id, ds)),
ei AS ({_interp_sql('eg', ['temp'], 'entity_id')})
SELECT entity_id, ds, ROUND(temp, 6) + 0.0 AS temp FROM ei""")
def q_interpolate_gaps(spark, sf):
    d = fixture_panel(spark, sf).select("entity_id", F.col("date").alias("ds"), "temp")
    dense = series.densify(d, None, by=["entity_id"])
    out = series.interpolate_linear(dense, ["temp"], by=["entity_id"])
    return typed(out, [("entity_id", "l"), ("ds", "t"), ("temp", "d")])


@register("mask_outlier_ranges", f"WITH {HOLD_SQL}\nSELECT ds, ROUND(y, 6) AS y, CAST(masked AS INTEGER) AS masked FROM mk")
def q_mask_outlier_ranges(spark, sf):
    return typed(fc.mask_ranges(weekly_ts(spark, sf, False), MASK), [("ds", "t"), ("y", "d"), ("masked", "i")])


HO = [("ds", "t"), ("y", "d"), ("split", "s")]


@register("naive_mean", f"WITH {HOLD_SQL}\nSELECT ds, ROUND(y, 6) AS y, split, ROUND(naive_mean, 6) AS naive_mean FROM pr WHERE split = 'holdout'")
def q_naive_mean(spark, sf):
    return typed(holdout(spark, sf).filter("split = 'holdout'"), HO + [("naive_mean", "d")])


@register("seasonal_naive", f"WITH {HOLD_SQL}\nSELECT ds, ROUND(y, 6) AS y, split, ROUND(snaive, 6) AS snaive FROM pr WHERE split = 'holdout'")
def q_seasonal_naive(spark, sf):
    return typed(holdout(spark, sf).filter("split = 'holdout'"), HO + [("snaive", "d")])


@register("seasonal_lag_lookup", f"WITH {HOLD_SQL}\nSELECT ds, ROUND(y, 6) AS y, ROUND(LAG(y, {PERIOD}) OVER (ORDER BY t), 6) AS y_lag FROM sp")
def q_seasonal_lag_lookup(spark, sf):
    sp = fc.holdout_split(fc.mask_ranges(weekly_ts(spark, sf, False), MASK))
    return typed(fc.seasonal_lag(sp, PERIOD), [("ds", "t"), ("y", "d"), ("y_lag", "d")])


@register("trend_forecast", f"WITH {HOLD_SQL}\nSELECT ds, ROUND(y, 6) AS y, split, ROUND(trend, 6) AS trend FROM pr")
def q_trend_forecast(spark, sf):
    return typed(holdout(spark, sf), HO + [("trend", "d")])


@register("clip_nonnegative", f"WITH {HOLD_SQL}\nSELECT ds, ROUND(GREATEST(temp - 15.0, 0.0), 6) AS temp_excess FROM pr")
def q_clip_nonnegative(spark, sf):
    from panelrisk.functions.columns import clip_nonnegative

    h = holdout(spark, sf)
    return typed(h.withColumn("temp_excess", clip_nonnegative(F.col("temp") - 15.0)), [("ds", "t"), ("temp_excess", "d")])


ERR_SQL = f"""{HOLD_SQL},
lg AS (SELECT 'trend' AS model, y, trend AS yhat FROM pr WHERE split = 'holdout'
       UNION ALL SELECT 'naive_mean', y, naive_mean FROM pr WHERE split = 'holdout'
       UNION ALL SELECT 'seasonal_naive', y, snaive FROM pr WHERE split = 'holdout'),
er AS (SELECT model, AVG(ABS(y - yhat)) AS mae, SQRT(AVG((y - yhat) * (y - yhat))) AS rmse,
              AVG(CASE WHEN y <> 0 THEN ABS((y - yhat) / y) END) * 100 AS mape
       FROM lg WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY model)"""
ERR = [("model", "s"), ("mae", "d"), ("rmse", "d"), ("mape", "d")]


def holdout_errors(spark, sf):
    h = holdout(spark, sf).filter("split = 'holdout'")
    long = h.select("y", F.expr("stack(3, 'trend', trend, 'naive_mean', naive_mean, 'seasonal_naive', snaive) AS (model, yhat)"))
    return metrics.forecast_errors(long, "y", "yhat", ["model"])


@register("forecast_errors", f"WITH {ERR_SQL}\nSELECT model, ROUND(mae, 6) AS mae, ROUND(rmse, 6) AS rmse, ROUND(mape, 6) AS mape FROM er")
def q_forecast_errors(spark, sf):
    return typed(holdout_errors(spark, sf), ERR)


CMP = [("best_model", "s"), ("best_mae", "d"), ("trend_beats_naive", "i"), ("trend_beats_snaive", "i"), ("verdict", "s")]
VERDICT_SQL = """CASE WHEN tm < nm AND tm < sm THEN 'beats_both' WHEN tm < nm OR tm < sm THEN 'beats_one' ELSE 'beats_none' END"""


@register("holdout_compare", f"""WITH {ERR_SQL},
w AS (SELECT arg_min(model, mae) AS best_model, MIN(mae) AS best_mae,
        MAX(CASE WHEN model = 'trend' THEN mae END) AS tm, MAX(CASE WHEN model = 'naive_mean' THEN mae END) AS nm,
        MAX(CASE WHEN model = 'seasonal_naive' THEN mae END) AS sm FROM er)
SELECT best_model, ROUND(best_mae, 6) AS best_mae, CAST(tm < nm AS INTEGER) AS trend_beats_naive,
  CAST(tm < sm AS INTEGER) AS trend_beats_snaive, {VERDICT_SQL} AS verdict FROM w""")
def q_holdout_compare(spark, sf):
    return typed(compare_table(holdout_errors(spark, sf)), CMP)


def compare_table(err):
    m = lambda name: F.max(F.when(F.col("model") == name, F.col("mae")))
    w = err.agg(F.min_by("model", "mae").alias("best_model"), F.min("mae").alias("best_mae"),
                m("trend").alias("tm"), m("naive_mean").alias("nm"), m("seasonal_naive").alias("sm"))
    a, b = F.col("tm") < F.col("nm"), F.col("tm") < F.col("sm")
    return w.select("best_model", "best_mae", a.cast("int").alias("trend_beats_naive"),
                    b.cast("int").alias("trend_beats_snaive"),
                    verdict(a, b, "beats_both", "beats_one", "beats_none").alias("verdict"))


@register("variant_verdict", f"""WITH {ERR_SQL},
w AS (SELECT MAX(CASE WHEN model = 'trend' THEN mae END) AS tm, MAX(CASE WHEN model = 'naive_mean' THEN mae END) AS nm,
        MAX(CASE WHEN model = 'seasonal_naive' THEN mae END) AS sm FROM er)
SELECT {VERDICT_SQL} AS verdict FROM w""")
def q_variant_verdict(spark, sf):
    return compare_table(holdout_errors(spark, sf)).select("verdict")


FUT_SQL = f"""{HOLD_SQL},
fu AS (SELECT CAST(MAX(ds) + 7 * CAST(unnest(generate_series(1, {HORIZON})) AS INTEGER) AS DATE) AS ds FROM ts),
mm AS (SELECT month(ds) AS m, AVG(temp) AS mt, AVG(humidity) AS mh FROM ts GROUP BY 1),
fr AS (SELECT fu.ds, COALESCE(ts.temp, mm.mt) AS temp, COALESCE(ts.humidity, mm.mh) AS humidity
       FROM fu LEFT JOIN ts USING (ds) LEFT JOIN mm ON month(fu.ds) = mm.m)"""


@register("make_future", f"WITH {FUT_SQL}\nSELECT ds FROM fu")
def q_make_future(spark, sf):
    return fc.make_future(weekly_ts(spark, sf, False), HORIZON, 7)


FR = [("ds", "t"), ("temp", "d"), ("humidity", "d")]


def _future_regs(spark, sf):
    ts = weekly_ts(spark, sf)
    fut = fc.make_future(ts, HORIZON, 7)
    return joins.month_mean_fill(fut, ts, "ds", ["temp", "humidity"])


@register("future_regressors", f"WITH {FUT_SQL}\nSELECT ds, ROUND(temp, 6) AS temp, ROUND(humidity, 6) AS humidity FROM fr")
def q_future_regressors(spark, sf):
    return typed(_future_regs(spark, sf), FR)


@register("month_mean_lookup", f"""WITH {FUT_SQL},
al AS (SELECT ds FROM ts WHERE month(ds) IN (1, 7) UNION ALL SELECT ds FROM fu)
SELECT al.ds, ROUND(COALESCE(ts.temp, mm.mt), 6) AS temp FROM al LEFT JOIN ts USING (ds) LEFT JOIN mm ON month(al.ds) = mm.m""")
def q_month_mean_lookup(spark, sf):
    ts = weekly_ts(spark, sf)
    fut = fc.make_future(ts, HORIZON, 7)
    probe = ts.filter(F.month("ds").isin(1, 7)).select("ds").unionByName(fut)
    return typed(joins.month_mean_fill(probe, ts, "ds", ["temp"]), [("ds", "t"), ("temp", "d")])


@register("future_tail", f"""WITH {HOLD_SQL},
fu AS (SELECT CAST(MAX(ds) + 7 * CAST(unnest(generate_series(1, {HORIZON})) AS INTEGER) AS DATE) AS ds FROM ts),
fa AS (SELECT regr_intercept(y, t) AS a, regr_slope(y, t) AS b, COUNT(*) AS n, MAX(ds) AS last FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY ds) - 1 AS t FROM mk) WHERE y IS NOT NULL),
tt AS (SELECT COUNT(*) AS n_all FROM mk)
SELECT fu.ds, ROUND(GREATEST(a + b * (n_all - 1 + (fu.ds - last) / 7), 0.0), 6) AS yhat FROM fu, fa, tt""")
def q_future_tail(spark, sf):
    from panelrisk.plans.forecast import trend_future

    ts = fc.mask_ranges(weekly_ts(spark, sf, False), MASK)
    return typed(trend_future(ts, HORIZON, 7), [("ds", "t"), ("yhat", "d")])


CV_SQL = f"""{HOLD_SQL},
cb AS (SELECT MIN(ds) AS lo, MAX(ds) AS hi, (MAX(ds) - MIN(ds)) AS span FROM mk),
cp AS (SELECT lo, hi, CAST(FLOOR(span * 0.5) AS INTEGER) AS init, GREATEST(CAST(FLOOR(span * 0.1) AS INTEGER), 7) AS per FROM cb),
cuts AS (SELECT CAST(hi - {HORIZON_DAYS} - CAST(j AS INTEGER) * per AS DATE) AS cutoff
         FROM cp, generate_series(0, 100000) AS r(j) WHERE (hi - {HORIZON_DAYS} - CAST(j AS INTEGER) * per) - lo >= init),
hist AS (SELECT cutoff, AVG(y) AS yhat FROM mk, cuts WHERE ds <= cutoff GROUP BY cutoff),
pts AS (SELECT cuts.cutoff, mk.ds, CAST(mk.ds - cuts.cutoff AS INTEGER) AS horizon, mk.y, hist.yhat
        FROM mk, cuts, hist WHERE hist.cutoff = cuts.cutoff AND mk.ds > cuts.cutoff
          AND mk.ds <= cuts.cutoff + {HORIZON_DAYS} AND mk.y IS NOT NULL)"""


def cv_naive_points(spark, sf):
    ts = fc.mask_ranges(weekly_ts(spark, sf, False), MASK)
    cuts = fc.cutoffs(ts, HORIZON_DAYS)
    return fc.cv_naive(ts, cuts, HORIZON_DAYS)


@register("cv_fold_points", f"WITH {CV_SQL}\nSELECT cutoff, ds, horizon FROM pts")
def q_cv_fold_points(spark, sf):
    ts = fc.mask_ranges(weekly_ts(spark, sf, False), MASK).filter(F.col("y").isNotNull())
    cuts = fc.cutoffs(ts, HORIZON_DAYS)
    return typed(fc.cv_points(ts, cuts, HORIZON_DAYS), [("cutoff", "t"), ("ds", "t"), ("horizon", "i")])


@register("rolling_origin_cv", f"WITH {CV_SQL}\nSELECT cutoff, ds, horizon, ROUND(y, 6) AS y, ROUND(yhat, 6) AS yhat FROM pts")
def q_rolling_origin_cv(spark, sf):
    return typed(cv_naive_points(spark, sf), [("cutoff", "t"), ("ds", "t"), ("horizon", "i"), ("y", "d"), ("yhat", "d")])


@register("cv_error_by_horizon", f"""WITH {CV_SQL},
g AS (SELECT horizon, SUM(ABS(y - yhat)) AS sa, SUM((y - yhat) * (y - yhat)) AS ss, COUNT(*) AS cnt FROM pts GROUP BY horizon),
wv AS (SELECT GREATEST(FLOOR(COUNT(*) * 0.1), 1) AS w FROM pts),
gc AS (SELECT *, SUM(cnt) OVER (ORDER BY horizon ROWS UNBOUNDED PRECEDING) AS cn,
              SUM(sa) OVER (ORDER BY horizon ROWS UNBOUNDED PRECEDING) AS ca,
              SUM(ss) OVER (ORDER BY horizon ROWS UNBOUNDED PRECEDING) AS cs FROM g),
pr2 AS (SELECT t.horizon, t.cn, t.ca, t.cs, wv.w, i.horizon AS ih, i.cn AS icn, i.cnt AS icnt, i.ca AS ica, i.sa AS isa,
               i.cs AS ics, i.ss AS iss
        FROM gc t, gc i, wv WHERE i.horizon <= t.horizon AND t.cn - i.cn + i.cnt >= wv.w),
bt AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY horizon ORDER BY ih DESC) AS rn FROM pr2)
SELECT CAST(horizon AS INTEGER) AS horizon,
  ROUND(((ca - ica + isa) - ((cn - icn + icnt) - w) * isa / icnt) / w, 6) AS mae,
  ROUND(SQRT(((cs - ics + iss) - ((cn - icn + icnt) - w) * iss / icnt) / w), 6) AS rmse
FROM bt WHERE rn = 1""")
def q_cv_error_by_horizon(spark, sf):
    return typed(fc.error_by_horizon(cv_naive_points(spark, sf)), [("horizon", "i"), ("mae", "d"), ("rmse", "d")])
