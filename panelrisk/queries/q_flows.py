"""Fitted-model flows: seasonal forecast, CV, tuning, matrices, reports (rows-only checks).

SURVEY 2L (L01, L03–L05), 2M (M05, M06, M10, M11 model, M13), 2N (N05–N08), I13.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.operators import forecast as fc
from panelrisk.operators import metrics, models, prep, splits
from panelrisk.plans import forecast as pf
from panelrisk.queries import register
from panelrisk.queries.q_forecast import HORIZON, HORIZON_DAYS, MASK, weekly_ts
from panelrisk.queries.q_models import feat_split, matrices
from panelrisk.sources.fixture import fixture_panel
from panelrisk.spec import FIXTURE_SPEC as S

MATRIX_MODELS = ("gbt", "gbt_regularized", "gbt_depth4", "gbt_depth6", "random_forest", "logreg", "ensemble")
TARGET_MODELS = ("gbt", "gbt_regularized", "logreg", "gbt_depth6", "ensemble")

@register("fit_seasonal_model")
def q_fit_seasonal_model(spark, sf):
    ts = fc.holdout_split(fc.mask_ranges(weekly_ts(spark, sf), MASK)).withColumn("_tr", F.col("split") == "train")
    return pf.fit_seasonal(ts, (), "_tr", ["temp", "humidity"]).select("ds", "y", "yhat", "yhat_lower", "yhat_upper")


@register("forecast_per_entity")
def q_forecast_per_entity(spark, sf):
    ts = pf.entity_weekly_series(fixture_panel(spark, sf), S)
    out = pf.forecast_with_future(ts, HORIZON, 7, ["entity_id"])
    return out.select("entity_id", "ds", "yhat", "yhat_lower", "yhat_upper")


@register("forecast_output")
def q_forecast_output(spark, sf):
    ts = fc.mask_ranges(weekly_ts(spark, sf, False), MASK).select("ds", "y")
    return pf.forecast_with_future(ts, HORIZON, 7).select("ds", "yhat", "yhat_lower", "yhat_upper")


@register("component_table")
def q_component_table(spark, sf):
    ts = weekly_ts(spark, sf, False).select("ds", "y")
    return pf.fit_seasonal(ts).select("ds", "trend", "yearly")


@register("rolling_origin_cv_model")
def q_rolling_origin_cv_model(spark, sf):
    ts = fc.mask_ranges(weekly_ts(spark, sf, False), MASK).select("ds", "y")
    return pf.cv_performance(ts, HORIZON)


@register("forecast_fleet")
def q_forecast_fleet(spark, sf):
    out = pf.forecast_fleet(fixture_panel(spark, sf), S, MASK, HORIZON)
    return out["holdout_errors"]


@register("forecast_fleet_daily")
def q_forecast_fleet_daily(spark, sf):
    """Daily, multiplicative, with weather: the next 30 days."""
    return pf.forecast_fleet(fixture_panel(spark, sf), S, MASK, freq="D", with_weather=True, multiplicative=True)["forecast"]


@register("cv_classifier")
def q_cv_classifier(spark, sf):
    from panelrisk.plans.cv import cv_classifier

    return cv_classifier(feat_split(spark, sf), S, "gbt_regularized", 5)


@register("tune_expanding")
def q_tune_expanding(spark, sf):
    from panelrisk.plans.cv import tune_expanding

    return tune_expanding(feat_split(spark, sf), S, n_trials=40, k=4)


@register("model_matrix")
def q_model_matrix(spark, sf):
    from panelrisk.plans.experiments import experiment_table, scored_long

    long = scored_long(fixture_panel(spark, sf), S, MATRIX_MODELS)
    return experiment_table(long, "label")


@register("target_matrix")
def q_target_matrix(spark, sf):
    from panelrisk.plans.experiments import scored_long, target_table

    long = scored_long(fixture_panel(spark, sf), S, TARGET_MODELS, honest=True)
    return target_table(long)


@register("experiment_matrix")
def q_experiment_matrix(spark, sf):
    """Per dataset variant: size, holdout errors of the seasonal model and both baselines, CV MAE, verdict."""
    from panelrisk.plans.experiments import weekly_series

    return pf.forecast_matrix(weekly_series(fixture_panel(spark, sf), S))


def _model_scores(spark, sf):
    p, tr, te = matrices(spark, sf)
    m = models.fit("gbt_regularized", tr)
    return models.score(m, tr).unionByName(models.score(m, te)).drop("features")


@register("evaluation_panels")
def q_evaluation_panels(spark, sf):
    from panelrisk.operators.thresholds import alarm_rate_threshold
    from panelrisk.plans.reports import evaluation_panels

    s = _model_scores(spark, sf)
    th = alarm_rate_threshold(s, "score", 0.10, ["split"])
    s = s.join(F.broadcast(th), "split").withColumn("alarm", (F.col("score") >= F.col("threshold")).cast("int"))
    t = evaluation_panels(s, "label", "score", "alarm")
    none = F.lit(None).cast("long").alias("n")
    roc = t["roc"].select(F.lit("roc").alias("panel"), "split", F.col("fpr").alias("x"), F.col("tpr").alias("y"), none)
    pr = t["pr"].select(F.lit("pr").alias("panel"), "split", F.col("recall").alias("x"), F.col("precision").alias("y"), none)
    cells = t["confusion"].select(F.lit("confusion").alias("panel"), "split", F.col("predicted").cast("double").alias("x"), F.col("actual").cast("double").alias("y"), "n")
    return roc.unionByName(pr).unionByName(cells)


@register("operating_point_report")
def q_operating_point_report(spark, sf):
    """Booster fitted on the first three quarters of train: top rates, honest threshold and curve, per dataset."""
    from panelrisk.plans.experiments import scored_long
    from panelrisk.plans.reports import operating_point_report

    long = scored_long(fixture_panel(spark, sf), S, ("gbt",), datasets=("full", "no_last_year", "no_last_year_until_entity"), honest=True)
    return operating_point_report(long)


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    from panelrisk.plans.importance import permutation_importance

    f = feat_split(spark, sf)
    p, tr, te = matrices(spark, sf)
    m = models.fit("gbt_regularized", tr)
    return permutation_importance(m, p, f.filter("split = 'test'"), "label", ["entity_id", "date"])


@register("top_k_importance")
def q_top_k_importance(spark, sf):
    """The 10 features with the largest gain."""
    p, tr, te = matrices(spark, sf)
    m = models.fit("gbt", tr)
    return models.feature_importance(m, p.output_columns, spark).orderBy(F.desc("gain"), "feature").limit(10)
