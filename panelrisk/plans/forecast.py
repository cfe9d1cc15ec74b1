"""Forecast flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.operators import events, normal, series
from panelrisk.operators import forecast as fc
from panelrisk.operators.positions import attach
from panelrisk.session import cut_lineage
from panelrisk.spec import PanelSpec

SEASON = {"W": 52, "D": 365}  # periods in a year
STEP = {"W": 7, "D": 1}
HORIZON = {"W": 8, "D": 30}


def trend_future(ts: DataFrame, horizon: int, step_days: int = 7, ds: str = "ds", y: str = "y") -> DataFrame:
    """Linear trend refit on the whole series, forecast for the next ``horizon`` periods, clipped at 0."""
    t = fc.with_period_index(ts, ds)
    fit = t.filter(F.col(y).isNotNull()).agg(F.regr_intercept(y, "t").alias("a"), F.regr_slope(y, "t").alias("b"))
    last = t.agg(F.max(ds).alias("_last"), (F.count(F.lit(1)) - 1).alias("_tl"))
    fut = attach(attach(fc.make_future(ts, horizon, step_days, ds), fit), last)
    tt = F.col("_tl") + F.datediff(F.col(ds), F.col("_last")) / step_days
    return fut.select(ds, F.greatest(F.col("a") + F.col("b") * tt, F.lit(0.0)).alias("yhat"))


def fit_seasonal(ts: DataFrame, by=(), fit_col: str | None = None, regressors=(), multiplicative: bool = False,
                 weekly: bool = False) -> DataFrame:
    """Trend + Fourier seasonality per series.

    ``ts`` has ``ds, y`` (+ regressors, + by keys); rows with ``fit_col`` true
    are fitted (all rows when None), every row is predicted. The fits come from
    summed products (``operators.normal``): any number of series in one job.
    """
    by, regs = list(by), list(regressors)
    ts = cut_lineage(ts.select(*by, "ds", F.col("y").cast("double").alias("y"), *regs, *([fit_col] if fit_col else [])))
    fits = normal.fit_series(ts, by, fit_col, regs, multiplicative, weekly).drop("cutoff")
    out = normal.predict(attach(ts, fits, by), regs, multiplicative, weekly)
    return out.select(*by, "ds", "y", "yhat", "yhat_lower", "yhat_upper", "trend", "yearly",
                      *(["weekly"] if weekly else []))


def forecast_with_future(ts: DataFrame, horizon: int, step_days: int = 7, by=(), regressors=(),
                         multiplicative: bool = False) -> DataFrame:
    """Fit on the whole history, predict history + ``horizon`` future periods.

    Future regressors come from the known value or the calendar-month mean of the same series (M09).
    """
    from panelrisk.operators import joins

    fut = fc.make_future(ts, horizon, step_days, "ds", by)
    if regressors:
        fut = joins.month_mean_fill(fut, ts, "ds", list(regressors), by)
    full = ts.select(*by, "ds", "y", *regressors).unionByName(
        fut.withColumn("y", F.lit(None).cast("double")).select(*by, "ds", "y", *regressors))
    return fit_seasonal(full, by, None, regressors, multiplicative, weekly=(step_days == 1))


def entity_weekly_series(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Weekly event counts per entity over that entity's own span, zero-filled (M06 input)."""
    from panelrisk.functions.calendar import week_ending_sunday

    ev = events.with_events(panel, spec)
    wk = ev.groupBy(spec.entity, week_ending_sunday(F.col(spec.date)).alias("ds")).agg(
        F.sum("event").cast("double").alias("y"))
    cal = series.calendar(wk, "ds", step_days=7, by=[spec.entity])
    return cal.join(wk, [spec.entity, "ds"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))


def cv_seasonal(ts: DataFrame, cuts: DataFrame, horizon_days: int, by=(), regressors=(), multiplicative: bool = False,
                weekly: bool = False) -> DataFrame:
    """Fit per cutoff on ds <= cutoff, predict (cutoff, cutoff + horizon] (M11 for the model).

    All cutoffs of a series are fitted from running sums over one scan of it.
    """
    by, regs = list(by), list(regressors)
    ts = cut_lineage(ts.select(*by, "ds", F.col("y").cast("double").alias("y"), *regs))
    fits = normal.fit_series(ts, by, None, regs, multiplicative, weekly, cuts, horizon_days)
    pts = attach(ts, fits, by).filter((F.col("ds") > F.col("cutoff")) & (F.col("ds") <= F.date_add("cutoff", horizon_days)))
    out = normal.predict(pts, regs, multiplicative, weekly)
    return out.select(*by, "cutoff", "ds", "y", "yhat", "yhat_lower", "yhat_upper",
                      F.datediff("ds", "cutoff").alias("horizon"))


def cv_performance(ts: DataFrame, horizon: int, freq: str = "W", by=(), regressors=(),
                   multiplicative: bool = False) -> DataFrame:
    """Cross-validated MAE, RMSE, MAPE and coverage of the seasonal model by horizon (M11 + M12)."""
    days = horizon * STEP[freq]
    pts = cv_seasonal(ts, fc.cutoffs(ts, days, by=by), days, by, regressors, multiplicative, freq == "D")
    return fc.error_by_horizon(pts.filter(F.col("y").isNotNull()), "y", "yhat", by=by, lower="yhat_lower", upper="yhat_upper")


def holdout_predictions(ts: DataFrame, freq: str = "W", by=(), regressors=(), multiplicative: bool = False) -> DataFrame:
    """Long (by…, ds, y, model, pred) of the seasonal model and both baselines on the last fifth of each series."""
    by = list(by)
    sp = cut_lineage(fc.holdout_split(ts, by=by))
    fitted = fit_seasonal(sp.withColumn("_tr", F.col("split") == "train"), by, "_tr", regressors, multiplicative, freq == "D")
    base = fc.seasonal_naive(sp, SEASON[freq], by).filter("split = 'holdout'").select(*by, "ds", "naive_mean", "snaive")
    return fitted.join(base, [*by, "ds"]).select(*by, "ds", "y", F.expr(
        "stack(3, 'seasonal_model', yhat, 'naive_mean', naive_mean, 'seasonal_naive', snaive) AS (model, pred)"))


def forecast_fleet(panel: DataFrame, spec: PanelSpec, mask: str | None = None, horizon: int | None = None,
                   freq: str = "W", with_weather: bool = False, multiplicative: bool = False, entity=None,
                   cv: bool = False) -> dict[str, DataFrame]:
    """Forecast main flow (N05): series → mask → holdout fit + baselines → refit → future.

    ``freq`` W or D (with weekly seasonality); ``entity``: the series of one
    entity (an unknown one raises); ``with_weather``: temperature and humidity
    as regressors; ``cv``: adds ``cv`` (errors by horizon) and ``cv_mae``.
    """
    from panelrisk.operators import metrics
    from panelrisk.plans.forecast_entity import only_entity

    horizon = HORIZON[freq] if horizon is None else horizon
    if entity is not None:
        panel = only_entity(panel, spec, entity)
    regs = list(fc.WEATHER) if with_weather else []
    ts = cut_lineage(fc.mask_ranges(fc.build_timeseries(panel, spec, freq, with_weather), mask))
    long = holdout_predictions(ts, freq, (), regs, multiplicative)
    future = forecast_with_future(ts, horizon, STEP[freq], (), regs, multiplicative)
    out = {"series": ts, "holdout_errors": metrics.forecast_errors(long, "y", "pred", ["model"]),
           "forecast": future.select("ds", "yhat", "yhat_lower", "yhat_upper"),
           "components": future.select("ds", "trend", "yearly", *(["weekly"] if freq == "D" else []))}
    if cv:
        out["cv"] = cv_performance(ts, horizon, freq, (), regs, multiplicative)
        out["cv_mae"] = out["cv"].agg(F.avg("mae").alias("cv_mae"))
    return out


def forecast_matrix(series: DataFrame, by=("dataset",), freq: str = "W", horizon: int | None = None) -> DataFrame:
    """One row per series: size, holdout errors of model and baselines, cross-validated MAE, verdict.

    ``series`` holds the series of all datasets (``by…, ds, y``): they are
    fitted, and their cutoffs too, by the same grouped jobs.
    """
    from panelrisk.operators import metrics

    by = list(by)
    ts = cut_lineage(series.select(*by, "ds", F.col("y").cast("double").alias("y")))
    size = ts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_periods"), F.avg("y").alias("mean_y"))
    err = metrics.forecast_errors(holdout_predictions(ts, freq, by), "y", "pred", [*by, "model"])
    of = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    err = err.groupBy(*by).agg(of("seasonal_model", "mae").alias("model_mae"), of("seasonal_model", "rmse").alias("model_rmse"),
                               of("naive_mean", "mae").alias("naive_mae"), of("seasonal_naive", "mae").alias("snaive_mae"))
    cv = cv_performance(ts, HORIZON[freq] if horizon is None else horizon, freq, by).groupBy(*by).agg(F.avg("mae").alias("cv_mae"))
    out = size.join(err, by, "left").join(cv, by, "left")
    a, b = F.col("model_mae") < F.col("naive_mae"), F.col("model_mae") < F.col("snaive_mae")
    out = out.withColumn("beats_naive", a.cast("int")).withColumn("beats_snaive", b.cast("int"))
    text = F.when(a & b, "beats_both").when(a, "beats_naive_only").otherwise("beats_none")
    return out.withColumn("verdict", text).withColumn("freq", F.lit(freq))
