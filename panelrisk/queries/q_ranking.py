"""Experiment matrix, CV on given scores, latest-row ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.operators import metrics, splits, thresholds
from panelrisk.operators.positions import attach
from panelrisk.plans.experiments import experiment_table
from panelrisk.plans.score import latest_rows, rank_by_score, score_latest
from panelrisk.queries import register
from panelrisk.queries.common import typed
from panelrisk.queries.q_metrics import (GRID_SQL, SCORE_A_SQL, SCORE_B_SQL, SCORED_SQL, Y, _counts_sql,
                                         _grid_list_sql, AUC_SQL, AP_SQL, score_a, score_b, scored)
from panelrisk.queries.q_splits import VARIANTS_SQL
from panelrisk.sources.fixture import fixture_panel
from panelrisk.sources.variants import dataset_variants
from panelrisk.spec import FIXTURE_SPEC as S

LABEL = S.label
DN = "CAST(date - DATE '1970-01-01' AS DOUBLE)"


def model_scores(spark, sf):
    """Long table (dataset, model, split, label, score) over all dataset variants."""
    v = dataset_variants(fixture_panel(spark, sf), S)
    v = splits.calendar_split(v, S, by=["dataset"])
    a = v.select("dataset", F.lit("model_a").alias("model"), "split", LABEL, score_a().alias("score"))
    b = v.select("dataset", F.lit("model_b").alias("model"), "split", LABEL, score_b().alias("score"))
    return a.unionByName(b)


LONG_SQL = f"""{VARIANTS_SQL},
vb2 AS (SELECT dataset, MIN({DN}) AS d0, MAX({DN}) AS d1 FROM variants GROUP BY dataset),
vs AS (SELECT variants.*, CASE WHEN {DN} - d0 <= 0.8 * (d1 - d0) THEN 'train' ELSE 'test' END AS split
       FROM variants JOIN vb2 USING (dataset)),
lg AS (SELECT dataset, 'model_a' AS model, split, {Y}, {SCORE_A_SQL} AS score FROM vs
       UNION ALL SELECT dataset, 'model_b', split, {Y}, {SCORE_B_SQL} FROM vs),
te AS (SELECT * FROM lg WHERE split = 'test'),
trn AS (SELECT * FROM lg WHERE split = 'train'),
g AS (SELECT dataset, model, score, SUM(CASE WHEN {Y} = 1 THEN 1 ELSE 0 END) AS pos,
             SUM(CASE WHEN {Y} = 1 THEN 0 ELSE 1 END) AS neg FROM te GROUP BY dataset, model, score),
c AS (SELECT *, SUM(pos) OVER (PARTITION BY dataset, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             SUM(neg) OVER (PARTITION BY dataset, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
             SUM(pos) OVER (PARTITION BY dataset, model) AS P, SUM(neg) OVER (PARTITION BY dataset, model) AS N FROM g),
ra AS (SELECT dataset, model, {AUC_SQL} AS roc_auc, {AP_SQL} AS pr_auc FROM c GROUP BY dataset, model),
tq AS (SELECT dataset, model, quantile_cont(score, 0.9) AS thr, AVG(CAST({Y} AS DOUBLE)) AS base_rate,
              SUM(CASE WHEN {Y} = 1 THEN 1 ELSE 0 END) AS P FROM te GROUP BY dataset, model),
tk AS (SELECT tq.dataset, tq.model, tq.base_rate,
         CASE WHEN SUM(CASE WHEN score >= thr THEN 1 ELSE 0 END) > 0 THEN
           CAST(SUM(CASE WHEN score >= thr AND {Y} = 1 THEN 1 ELSE 0 END) AS DOUBLE) / SUM(CASE WHEN score >= thr THEN 1 ELSE 0 END) ELSE 0.0 END AS prec_top10,
         CASE WHEN MAX(tq.P) > 0 THEN CAST(SUM(CASE WHEN score >= thr AND {Y} = 1 THEN 1 ELSE 0 END) AS DOUBLE) / MAX(tq.P) ELSE 0.0 END AS rec_top10
       FROM tq JOIN te USING (dataset, model) GROUP BY tq.dataset, tq.model, tq.base_rate),
gq AS (SELECT dataset, model, unnest(quantile_cont(score, {_grid_list_sql()})) AS t FROM trn GROUP BY dataset, model),
gth AS (SELECT DISTINCT dataset, model, t FROM gq),
gg AS (SELECT gth.dataset, gth.model, gth.t,
         SUM(CASE WHEN trn.score >= gth.t AND trn.{Y} = 1 THEN 1 ELSE 0 END) AS tp,
         SUM(CASE WHEN trn.score >= gth.t AND trn.{Y} <> 1 THEN 1 ELSE 0 END) AS fp,
         SUM(CASE WHEN trn.{Y} = 1 THEN 1 ELSE 0 END) AS P
       FROM gth JOIN trn USING (dataset, model) GROUP BY gth.dataset, gth.model, gth.t),
gr AS (SELECT dataset, model, arg_max(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END, t) AS train_prec_at_recall80
       FROM gg WHERE CASE WHEN P > 0 THEN CAST(tp AS DOUBLE) / P ELSE 0.0 END >= 0.8 GROUP BY dataset, model),
ex AS (SELECT ra.dataset, ra.model, ra.roc_auc, ra.pr_auc, tk.base_rate, tk.prec_top10, tk.rec_top10,
         tk.prec_top10 / tk.base_rate AS lift_top10, gr.train_prec_at_recall80
       FROM ra JOIN tk USING (dataset, model) LEFT JOIN gr USING (dataset, model))"""

EXP = [("dataset", "s"), ("model", "s"), ("roc_auc", "d"), ("pr_auc", "d"), ("base_rate", "d"), ("prec_top10", "d"),
       ("rec_top10", "d"), ("lift_top10", "d"), ("train_prec_at_recall80", "d")]


def _sel(cols):
    return ", ".join(f"ROUND({n}, 6) AS {n}" if k == "d" else n for n, k in cols)


@register("experiment_row", f"WITH {LONG_SQL}\nSELECT {_sel(EXP)} FROM ex")
def q_experiment_row(spark, sf):
    return typed(experiment_table(model_scores(spark, sf), LABEL), EXP)


@register("best_model_per_dataset", f"""WITH {LONG_SQL}
SELECT dataset, arg_max(model, pr_auc) AS model, ROUND(MAX(pr_auc), 6) AS pr_auc FROM ex GROUP BY dataset""")
def q_best_model_per_dataset(spark, sf):
    e = experiment_table(model_scores(spark, sf), LABEL)
    b = e.groupBy("dataset").agg(F.max_by("model", "pr_auc").alias("model"), F.max("pr_auc").alias("pr_auc"))
    return typed(b, [("dataset", "s"), ("model", "s"), ("pr_auc", "d")])


@register("leaderboard", f"""WITH {LONG_SQL}
SELECT dataset, model, ROUND(pr_auc, 6) AS pr_auc, ROUND(prec_top10, 6) AS prec_top10,
  CAST(ROW_NUMBER() OVER (PARTITION BY dataset ORDER BY pr_auc DESC, model) AS INTEGER) AS place FROM ex""")
def q_leaderboard(spark, sf):
    from pyspark.sql import Window

    e = experiment_table(model_scores(spark, sf), LABEL)
    w = Window.partitionBy("dataset").orderBy(F.desc("pr_auc"), "model")
    e = e.withColumn("place", F.row_number().over(w))
    return typed(e, [("dataset", "s"), ("model", "s"), ("pr_auc", "d"), ("prec_top10", "d"), ("place", "i")])


GAP_SQL = f"""{SCORED_SQL},{_counts_sql('sc', 'split')},
m AS (SELECT split, {AUC_SQL} AS roc_auc, {AP_SQL} AS ap FROM c GROUP BY split)"""


@register("generalisation_gap", f"""WITH {GAP_SQL}
SELECT ROUND(MAX(CASE WHEN split = 'train' THEN roc_auc END), 6) AS train_roc_auc,
  ROUND(MAX(CASE WHEN split = 'test' THEN roc_auc END), 6) AS test_roc_auc,
  ROUND(MAX(CASE WHEN split = 'train' THEN ap END), 6) AS train_ap,
  ROUND(MAX(CASE WHEN split = 'test' THEN ap END), 6) AS test_ap FROM m""")
def q_generalisation_gap(spark, sf):
    m = metrics.auc_ap(scored(spark, sf), LABEL, "score", ["split"])
    pv = m.groupBy().pivot("split", ["train", "test"]).agg(F.first("roc_auc").alias("roc_auc"),
                                                            F.first("average_precision").alias("ap"))
    out = pv.select(F.col("train_roc_auc"), F.col("test_roc_auc"), F.col("train_ap"), F.col("test_ap"))
    return typed(out, [("train_roc_auc", "d"), ("test_roc_auc", "d"), ("train_ap", "d"), ("test_ap", "d")])


CV_SQL = f"""
r AS (SELECT panel.*, {SCORE_A_SQL} AS score, ROW_NUMBER() OVER (ORDER BY date, entity_id) - 1 AS pos,
             COUNT(*) OVER () AS n FROM panel),
fr AS (SELECT *, (pos - (n - 5 * (n // 6))) // (n // 6) AS fold FROM r WHERE pos >= n - 5 * (n // 6)),
g AS (SELECT fold, score, SUM(CASE WHEN {Y} = 1 THEN 1 ELSE 0 END) AS pos,
             SUM(CASE WHEN {Y} = 1 THEN 0 ELSE 1 END) AS neg FROM fr GROUP BY fold, score),
c AS (SELECT *, SUM(pos) OVER (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             SUM(neg) OVER (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
             SUM(pos) OVER (PARTITION BY fold) AS P, SUM(neg) OVER (PARTITION BY fold) AS N FROM g),
ra AS (SELECT fold, {AUC_SQL} AS roc_auc, {AP_SQL} AS ap FROM c GROUP BY fold HAVING MAX(P) > 0),
tq AS (SELECT fold, quantile_cont(score, 0.9) AS thr, SUM(CASE WHEN {Y} = 1 THEN 1 ELSE 0 END) AS P FROM fr GROUP BY fold),
tk AS (SELECT tq.fold,
   CAST(SUM(CASE WHEN score >= thr AND {Y} = 1 THEN 1 ELSE 0 END) AS DOUBLE) / SUM(CASE WHEN score >= thr THEN 1 ELSE 0 END) AS p10,
   CAST(SUM(CASE WHEN score >= thr AND {Y} = 1 THEN 1 ELSE 0 END) AS DOUBLE) / MAX(tq.P) AS r10
   FROM tq JOIN fr USING (fold) GROUP BY tq.fold),
cv AS (SELECT ra.fold, roc_auc, ap, p10, r10 FROM ra JOIN tk USING (fold))"""

CV = [("fold", "i"), ("roc_auc", "d"), ("ap", "d"), ("p10", "d"), ("r10", "d")]


def cv_scores(spark, sf):
    from panelrisk.plans.cv import cv_given_scores

    p = fixture_panel(spark, sf).withColumn("score", score_a())
    return cv_given_scores(p, S, LABEL, "score", k=5)


@register("cv_score_only", f"WITH {CV_SQL}\nSELECT CAST(fold AS INTEGER) AS fold, {_sel(CV[1:])} FROM cv")
def q_cv_score_only(spark, sf):
    return typed(cv_scores(spark, sf), CV)


CVS = [("roc_auc_mean", "d"), ("roc_auc_std", "d"), ("ap_mean", "d"), ("ap_std", "d"), ("p10_mean", "d"),
       ("p10_std", "d"), ("r10_mean", "d"), ("r10_std", "d")]


@register("cv_summary", f"""WITH {CV_SQL}
SELECT ROUND(AVG(roc_auc), 6) AS roc_auc_mean, ROUND(STDDEV_POP(roc_auc), 6) AS roc_auc_std,
  ROUND(AVG(ap), 6) AS ap_mean, ROUND(STDDEV_POP(ap), 6) AS ap_std, ROUND(AVG(p10), 6) AS p10_mean,
  ROUND(STDDEV_POP(p10), 6) AS p10_std, ROUND(AVG(r10), 6) AS r10_mean, ROUND(STDDEV_POP(r10), 6) AS r10_std FROM cv""")
def q_cv_summary(spark, sf):
    from panelrisk.operators.aggregates import mean_std

    return typed(mean_std(cv_scores(spark, sf), ["roc_auc", "ap", "p10", "r10"]), CVS)


LATEST_SQL = f"""
lt AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY date DESC) AS rn FROM panel),
la AS (SELECT entity_id, entity_type, date, use_today, days_since_last_event, {SCORE_A_SQL} AS score FROM lt WHERE rn = 1),
rk AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, entity_id) AS risk_rank FROM la)"""
LATEST = [("entity_id", "l"), ("entity_type", "s"), ("date", "t"), ("use_today", "l"), ("days_since_last_event", "i")]


def latest(spark, sf):
    return latest_rows(fixture_panel(spark, sf), S)


@register("latest_row_per_entity", f"WITH {LATEST_SQL}\nSELECT entity_id, entity_type, date, use_today, days_since_last_event FROM la")
def q_latest_row_per_entity(spark, sf):
    return typed(latest(spark, sf), LATEST)


RANKED = [("risk_rank", "l"), ("entity_id", "l"), ("score", "d")]


@register("risk_rank", f"WITH {LATEST_SQL}\nSELECT CAST(risk_rank AS BIGINT) AS risk_rank, entity_id, score FROM rk")
def q_risk_rank(spark, sf):
    la = latest(spark, sf).withColumn("score", score_a())
    return typed(rank_by_score(la, S, "score"), RANKED)


@register("top_k_risk", f"WITH {LATEST_SQL}\nSELECT CAST(risk_rank AS BIGINT) AS risk_rank, entity_id, score FROM rk ORDER BY risk_rank LIMIT 10")
def q_top_k_risk(spark, sf):
    la = latest(spark, sf).withColumn("score", score_a())
    top = la.orderBy(F.desc("score"), "entity_id").limit(10)
    return typed(rank_by_score(top, S, "score"), RANKED)


SCORED_LATEST = [("risk_rank", "l"), ("entity_id", "l"), ("entity_type", "s"), ("date", "t"), ("score", "d"),
                 ("alarm_flag", "i")]


@register("score_latest", f"""WITH {LATEST_SQL},
th AS (SELECT quantile_cont(score, 0.9) AS thr FROM la)
SELECT CAST(risk_rank AS BIGINT) AS risk_rank, entity_id, entity_type, date, score,
  CAST(score >= thr AS INTEGER) AS alarm_flag FROM rk, th""")
def q_score_latest(spark, sf):
    out = score_latest(fixture_panel(spark, sf), S, lambda d: d.withColumn("score", score_a()), alarm_rate=0.10)
    return typed(out, SCORED_LATEST)


@register("panel_order", "SELECT entity_id, date, use_today FROM panel ORDER BY entity_id, date")
def q_panel_order(spark, sf):
    return fixture_panel(spark, sf).select("entity_id", "date", "use_today").orderBy("entity_id", "date")


UNI_COLS = ["entity_age", "use_today", "use_last_7d", "use_last_30d", "days_since_last_maintenance",
            "use_since_last_maintenance", "days_since_last_event", "temp", "wind_speed", "humidity"]


@register("univariate_auc", f"""WITH {SCORED_SQL},
tr AS (SELECT {Y}, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in UNI_COLS)} FROM sp WHERE split = 'train'),
u AS (UNPIVOT tr ON {', '.join(UNI_COLS)} INTO NAME feature VALUE score),
g AS (SELECT feature, score, SUM(CASE WHEN {Y} = 1 THEN 1 ELSE 0 END) AS pos,
             SUM(CASE WHEN {Y} = 1 THEN 0 ELSE 1 END) AS neg FROM u GROUP BY feature, score),
c AS (SELECT *, SUM(pos) OVER (PARTITION BY feature ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             SUM(neg) OVER (PARTITION BY feature ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
             SUM(pos) OVER (PARTITION BY feature) AS P, SUM(neg) OVER (PARTITION BY feature) AS N FROM g)
SELECT feature, ROUND({AUC_SQL}, 6) AS roc_auc FROM c GROUP BY feature""")
def q_univariate_auc(spark, sf):
    from panelrisk.plans.importance import univariate_auc

    tr = splits.calendar_split(fixture_panel(spark, sf), S).filter("split = 'train'")
    return typed(univariate_auc(tr, LABEL, UNI_COLS), [("feature", "s"), ("roc_auc", "d")])
