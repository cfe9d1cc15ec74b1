"""Registered fits run the configured schedules, whole model lists and whole search space."""

from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from panelrisk.operators import models
from panelrisk.operators.trees import FitSpec
from panelrisk.queries import q_flows, q_models

SF = "/root/testdata/sf0.001"
FITS = {
    "model_gbt": ["gbt"], "model_gbt_regularized": ["gbt_regularized"], "model_gbt_depth4": ["gbt_depth4"], "model_gbt_depth6": ["gbt_depth6"],
    "model_gbt_hist": ["gbt_hist"], "model_logreg": ["logreg"], "score_rows": ["gbt_regularized"],
    "feature_importance": ["gbt"], "top_k_importance": ["gbt"],
}


@pytest.mark.parametrize("key", FITS)
def test_registered_fit_is_not_shortened(spark, monkeypatch, key):
    built = []

    def build(name, weight_col="weight", overrides=None, reg_param=0.0):
        est = real(name, weight_col, overrides, reg_param)
        built.append((name, {k: est.getOrDefault(k) for k in models.CONFIGS[name]}))
        return MagicMock()

    real = models.build
    monkeypatch.setattr(models, "build", build)
    monkeypatch.setattr(models, "score", lambda *a: MagicMock())
    monkeypatch.setattr(models, "feature_importance", lambda *a: MagicMock())
    frame = MagicMock()
    frame.agg.return_value.collect.return_value = [[100.0]]
    monkeypatch.setattr(models, "with_class_weight", lambda *a: frame)
    for m in (q_models, q_flows):
        monkeypatch.setattr(m, "matrices", lambda *a, **k: (MagicMock(), frame, frame))
    E.queries()[key](spark, SF)
    assert built == [(name, models.CONFIGS[name]) for name in FITS[key]]


def test_shared_fits_run_the_configured_schedules():
    from panelrisk.operators import fits

    trees = {n: (s.trees, s.rate) for n, s in fits.SPECS.items() if n != "random_forest"}
    assert trees == {n: (models.CONFIGS[n]["maxIter"], models.CONFIGS[n]["stepSize"]) for n in trees}
    assert set(models.ENSEMBLE) <= set(trees) and fits.SPECS["random_forest"].trees == 400 == sum(f.spec.trees for f, _ in fits.pieces([fits.Fit("d", "f", fits.SPECS["random_forest"])]))


def test_search_covers_the_space():
    from panelrisk.plans.cv import search_space

    trials = search_space()
    assert len(trials) == 40 and trials == search_space() and len(set(trials)) == 40
    for values, lo, hi in (([t.trees for t in trials], 300, 1200), ([t.rate for t in trials], 0.01, 0.1), ([t.leaves for t in trials], 15, 127), ([t.rows for t in trials], 0.6, 1), ([t.cols for t in trials], 0.6, 1), ([t.reg for t in trials], 0, 5)):
        assert lo <= min(values) < lo + 0.3 * (hi - lo) and hi - 0.3 * (hi - lo) < max(values) <= hi


def test_search_scores_every_row_of_every_window(spark):
    """Two trials: their mean AP is that of the same fits made and scored one by one."""
    import numpy as np

    from panelrisk.operators import fits, metrics
    from panelrisk.operators.trees import FitSpec
    from panelrisk.plans import cv
    from panelrisk.plans.features import feature_columns, split_feature_kinds
    from panelrisk.queries.q_models import feat_split
    from panelrisk.spec import FIXTURE_SPEC as S

    f = feat_split(spark, SF)
    trials = [FitSpec(trees=3, leaves=5), FitSpec(trees=2, rate=0.2, reg=0.0)]
    got = {r.trial: r.mean_ap for r in cv.tune_expanding(f, S, k=3, fit_rows=500, trials=trials).collect()}
    num, cat = split_feature_kinds([c for c in feature_columns(f, S) if c not in ("split", "label")], S)
    parts = cv.fold_parts(f.filter("split = 'train'"), S, 3).withColumn("dataset", F.lit("t"))
    b = fits.bin_rows(parts, num, cat, ["dataset", "entity_id", "date", "part", "label"], "true").persist()
    for t, spec in enumerate(trials):
        ap = []
        for i in range(3):
            one = fits.fit_many(b, [fits.Fit("t", "m", spec, i)], ["entity_id", "date"], 500)
            s = fits.score_many(b.filter(F.col("part") == i + 1), one, ["label"])
            assert s.count() == b.filter(F.col("part") == i + 1).count()
            ap.append(metrics.auc_ap(s, "label", "score").first().average_precision)
        assert abs(np.mean(ap) - got[t]) < 1e-9


def test_matrices_hold_every_model(spark, monkeypatch):
    from panelrisk.plans import experiments

    asked = []

    def long(panel, spec, names, honest=False):
        asked.append((len(names), "ensemble" in names, honest))
        return None

    monkeypatch.setattr(experiments, "scored_long", long)
    monkeypatch.setattr(experiments, "experiment_table", lambda *a: None)
    monkeypatch.setattr(experiments, "target_table", lambda *a: None)
    E.queries()["model_matrix"](spark, SF)
    E.queries()["target_matrix"](spark, SF)
    assert asked == [(7, True, False), (5, True, True)]


def test_ensemble_is_the_mean_of_its_members(spark):
    from panelrisk.plans.experiments import scored_long
    from panelrisk.sources.fixture import fixture_panel
    from panelrisk.spec import FIXTURE_SPEC as S

    small = {n: FitSpec(trees=2, depth=i + 1, leaves=2 << i) for i, n in enumerate(models.ENSEMBLE)}
    out = scored_long(fixture_panel(spark, SF), S, (*models.ENSEMBLE, "ensemble"), small, ["full"]).groupBy("model").agg({"score": "avg", "*": "count"}).toPandas().set_index("model")
    members = out.loc[list(models.ENSEMBLE)]
    assert out["count(1)"].nunique() == 1 and abs(out.loc["ensemble", "avg(score)"] - members["avg(score)"].mean()) < 1e-9


def test_honest_rows_and_thresholds(spark):
    """Fitted on the first three quarters of train; the threshold comes from the validation rows alone."""
    from panelrisk.plans.experiments import honest_table, scored_long
    from panelrisk.sources.fixture import fixture_panel
    from panelrisk.spec import FIXTURE_SPEC as S

    out = scored_long(fixture_panel(spark, SF), S, ("gbt",), {"gbt": FitSpec(trees=2, leaves=4)}, ["full"], honest=True)
    n = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert set(n) == {"train", "validation", "test"} and n["train"] == (n["train"] + n["validation"]) * 3 // 4
    rows = [("d", "m", s, y, p) for s, y, p in [("train", 1.0, 0.1), ("train", 0.0, 0.9), ("validation", 1.0, 0.8), ("validation", 1.0, 0.7), ("validation", 0.0, 0.6), ("validation", 0.0, 0.2), ("test", 1.0, 0.75), ("test", 0.0, 0.65), ("test", 1.0, 0.1), ("test", 0.0, 0.61)]]
    frame = spark.createDataFrame(rows, "dataset string, model string, split string, label double, score double")
    r = honest_table(frame, target_precision=0.9).first()
    assert 0.6 < r.honest_threshold <= 0.7 and r.validation_precision == 1.0
    hits = [(y, p) for _, _, s, y, p in rows if s == "test" and p >= r.honest_threshold]
    assert r.honest_precision == sum(y for y, _ in hits) / len(hits) and r.honest_recall == sum(y for y, _ in hits) / 2 and r.honest_alarm_rate == len(hits) / 4
    swapped = frame.withColumn("score", F.when(F.col("split") == "train", 1 - F.col("score")).otherwise(F.col("score")))
    assert honest_table(swapped, target_precision=0.9).first() == r  # scores of fit rows do not matter
    nothing = honest_table(frame.filter("split <> 'validation' OR label = 0"), target_precision=0.9).first()
    assert nothing.honest_threshold is None and nothing.honest_recall is None
