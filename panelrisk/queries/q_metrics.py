"""Thresholds, metrics, ranking and CV on a deterministic score.

The score is a fixed expression of the fixture panel, so every metric has an
exact SQL oracle; fitted models are exercised by the rows-only model queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.functions.columns import alarm
from panelrisk.operators import metrics, splits, thresholds
from panelrisk.operators.positions import attach
from panelrisk.queries import register
from panelrisk.queries.common import typed
from panelrisk.queries.q_splits import SPLIT_SQL
from panelrisk.sources.fixture import fixture_panel
from panelrisk.spec import FIXTURE_SPEC as S

LABEL = S.label


def score_a():
    return F.round(1.0 / (1.0 + F.exp(-(F.col("use_today") / 50.0 - F.col("days_since_last_event") / 100.0))), 6)


def score_b():
    return F.round(1.0 / (1.0 + F.exp(-(F.col("use_last_7d") / 300.0 - F.col("days_since_last_maintenance") / 50.0))), 6)


SCORE_A_SQL = "ROUND(1.0 / (1.0 + EXP(-(use_today / 50.0 - days_since_last_event / 100.0))), 6)"
SCORE_B_SQL = "ROUND(1.0 / (1.0 + EXP(-(use_last_7d / 300.0 - days_since_last_maintenance / 50.0))), 6)"
SCORED_SQL = f"{SPLIT_SQL},\nsc AS (SELECT sp.*, {SCORE_A_SQL} AS score FROM sp)"
Y = "event_next_30d"


def scored(spark, sf):
    return splits.calendar_split(fixture_panel(spark, sf), S).withColumn("score", score_a())


def _counts_sql(src: str, by: str) -> str:
    """Distinct-score table with running TP/FP in descending order (SQL side)."""
    pb = f"PARTITION BY {by}" if by else ""
    return f"""
g AS (SELECT {by + ',' if by else ''} score, SUM(CASE WHEN {Y} = 1 THEN 1 ELSE 0 END) AS pos,
             SUM(CASE WHEN {Y} = 1 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY {by + ',' if by else ''} score),
c AS (SELECT *, SUM(pos) OVER ({pb} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             SUM(neg) OVER ({pb} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
             SUM(pos) OVER ({pb}) AS P, SUM(neg) OVER ({pb}) AS N FROM g)"""


AUC_SQL = "CAST(SUM(pos * (N - fp + 0.5 * neg)) AS DOUBLE) / (CAST(MAX(P) AS DOUBLE) * MAX(N))"
AP_SQL = "COALESCE(SUM(CASE WHEN pos > 0 THEN CAST(pos AS DOUBLE) / P * tp / (tp + fp) END), 0.0)"


@register("roc_auc", f"WITH {SCORED_SQL},{_counts_sql('sc', 'split')}\nSELECT split, ROUND({AUC_SQL}, 6) AS roc_auc FROM c GROUP BY split")
def q_roc_auc(spark, sf):
    return typed(metrics.auc_ap(scored(spark, sf), LABEL, "score", ["split"]), [("split", "s"), ("roc_auc", "d")])


@register("average_precision", f"WITH {SCORED_SQL},{_counts_sql('sc', 'split')}\nSELECT split, ROUND({AP_SQL}, 6) AS average_precision FROM c GROUP BY split")
def q_average_precision(spark, sf):
    return typed(metrics.auc_ap(scored(spark, sf), LABEL, "score", ["split"]),
                 [("split", "s"), ("average_precision", "d")])


ALARM_SQL = f"""{SCORED_SQL},
th AS (SELECT split, quantile_cont(score, 0.9) AS thr FROM sc GROUP BY split),
al AS (SELECT sc.*, th.thr, CAST(COALESCE(score >= thr, false) AS INTEGER) AS alarm FROM sc JOIN th USING (split))"""


def alarmed(spark, sf):
    s = scored(spark, sf)
    th = thresholds.alarm_rate_threshold(s, "score", 0.10, ["split"])
    return attach(s, th, ["split"]).withColumn("alarm", alarm(F.col("score"), F.col("threshold")))


@register("threshold_alarm_rate", f"WITH {ALARM_SQL}\nSELECT split, ROUND(thr, 6) AS threshold FROM th")
def q_threshold_alarm_rate(spark, sf):
    th = thresholds.alarm_rate_threshold(scored(spark, sf), "score", 0.10, ["split"])
    return typed(th, [("split", "s"), ("threshold", "d")])


@register("alarm_flag", f"WITH {ALARM_SQL}\nSELECT entity_id, date, split, alarm FROM al")
def q_alarm_flag(spark, sf):
    return typed(alarmed(spark, sf), [("entity_id", "l"), ("date", "t"), ("split", "s"), ("alarm", "i")])


@register("flagged_rate", f"WITH {ALARM_SQL}\nSELECT split, ROUND(AVG(CAST(alarm AS DOUBLE)), 6) AS flagged_rate FROM al GROUP BY split")
def q_flagged_rate(spark, sf):
    a = alarmed(spark, sf).groupBy("split").agg(F.avg(F.col("alarm").cast("double")).alias("flagged_rate"))
    return typed(a, [("split", "s"), ("flagged_rate", "d")])


CONF_SQL = f"""{ALARM_SQL},
cf AS (SELECT split,
  SUM(CASE WHEN {Y} = 1 AND alarm = 1 THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN {Y} <> 1 AND alarm = 1 THEN 1 ELSE 0 END) AS fp,
  SUM(CASE WHEN {Y} = 1 AND alarm <> 1 THEN 1 ELSE 0 END) AS fn, SUM(CASE WHEN {Y} <> 1 AND alarm <> 1 THEN 1 ELSE 0 END) AS tn
  FROM al GROUP BY split)"""

CONF = [("split", "s"), ("tp", "l"), ("fp", "l"), ("fn", "l"), ("tn", "l"), ("alarms", "l")]


@register("confusion_counts", f"WITH {CONF_SQL}\nSELECT split, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, CAST(tp + fp AS BIGINT) AS alarms FROM cf")
def q_confusion_counts(spark, sf):
    return typed(metrics.confusion(alarmed(spark, sf), LABEL, "alarm", ["split"]), CONF)


def _report_sql():
    def prf(tp, fp, fn):
        p = f"(CASE WHEN {tp} + {fp} > 0 THEN CAST({tp} AS DOUBLE) / ({tp} + {fp}) ELSE 0.0 END)"
        r = f"(CASE WHEN {tp} + {fn} > 0 THEN CAST({tp} AS DOUBLE) / ({tp} + {fn}) ELSE 0.0 END)"
        f = f"(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)"
        return p, r, f

    p1, r1, f1 = prf("tp", "fp", "fn")
    p0, r0, f0 = prf("tn", "fn", "fp")
    n1, n0, n = "(tp + fn)", "(tn + fp)", "(tp + fn + tn + fp)"
    rows = [
        ("0", p0, r0, f0, n0), ("1", p1, r1, f1, n1),
        ("macro avg", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", n),
        ("weighted avg", f"({p0} * {n0} + {p1} * {n1}) / {n}", f"({r0} * {n0} + {r1} * {n1}) / {n}",
         f"({f0} * {n0} + {f1} * {n1}) / {n}", n),
        ("accuracy", "NULL", "NULL", f"CAST(tp + tn AS DOUBLE) / {n}", n),
    ]
    sel = [f"SELECT split, '{k}' AS row, ROUND(CAST({p} AS DOUBLE), 6) AS precision, ROUND(CAST({r} AS DOUBLE), 6) AS recall, "
           f"ROUND(CAST({f} AS DOUBLE), 6) AS f1, CAST({s} AS BIGINT) AS support FROM cf" for k, p, r, f, s in rows]
    return f"WITH {CONF_SQL}\n" + "\nUNION ALL\n".join(sel)


@register("precision_recall_f1", _report_sql())
def q_precision_recall_f1(spark, sf):
    r = metrics.classification_report(alarmed(spark, sf), LABEL, "alarm", ["split"])
    return typed(r, [("split", "s"), ("row", "s"), ("precision", "d"), ("recall", "d"), ("f1", "d"), ("support", "l")])


def _grid_list_sql():
    return "[" + ", ".join(f"'{q!r}'::DOUBLE" for q in thresholds.GRID) + "]"


GRID_SQL = f"""{SCORED_SQL},
qs AS (SELECT split, unnest(quantile_cont(score, {_grid_list_sql()})) AS t FROM sc GROUP BY split),
ths AS (SELECT DISTINCT split, t FROM qs),
gt AS (SELECT ths.split, ths.t,
         SUM(CASE WHEN sc.score >= ths.t AND {Y} = 1 THEN 1 ELSE 0 END) AS tp,
         SUM(CASE WHEN sc.score >= ths.t AND {Y} <> 1 THEN 1 ELSE 0 END) AS fp,
         SUM(CASE WHEN {Y} = 1 THEN 1 ELSE 0 END) AS P
       FROM ths JOIN sc ON ths.split = sc.split GROUP BY ths.split, ths.t),
gm AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN P > 0 THEN CAST(tp AS DOUBLE) / P ELSE 0.0 END AS recall FROM gt),
gf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM gm)"""


def grid(spark, sf):
    return thresholds.grid_table(scored(spark, sf), LABEL, "score", ["split"])


@register("threshold_recall", f"""WITH {GRID_SQL}
SELECT split, ROUND(MAX(t), 6) AS threshold, ROUND(arg_max(precision, t), 6) AS precision FROM gf WHERE recall >= 0.8 GROUP BY split""")
def q_threshold_recall(spark, sf):
    return typed(thresholds.recall_threshold(grid(spark, sf), 0.8, ["split"]),
                 [("split", "s"), ("threshold", "d"), ("precision", "d")])


@register("threshold_precision", f"""WITH {GRID_SQL}
SELECT split, ROUND(MIN(t), 6) AS threshold, ROUND(arg_min(precision, t), 6) AS precision, ROUND(arg_min(recall, t), 6) AS recall
FROM gf WHERE tp + fp > 0 AND precision >= 0.3 GROUP BY split""")
def q_threshold_precision(spark, sf):
    return typed(thresholds.precision_threshold(grid(spark, sf), 0.3, ["split"]),
                 [("split", "s"), ("threshold", "d"), ("precision", "d"), ("recall", "d")])


@register("threshold_f1", f"""WITH {GRID_SQL},
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY split ORDER BY f1 DESC, t ASC) AS rn FROM gf)
SELECT split, ROUND(t, 6) AS threshold, ROUND(f1, 6) AS f1 FROM r WHERE rn = 1""")
def q_threshold_f1(spark, sf):
    return typed(thresholds.f1_threshold(grid(spark, sf), ["split"]), [("split", "s"), ("threshold", "d"), ("f1", "d")])


RECALL_TARGETS = [0.9, 0.8, 0.7, 0.6, 0.5]


@register("pr_tradeoff_table", f"""WITH {GRID_SQL},
tg AS (SELECT unnest({RECALL_TARGETS}) AS target)
SELECT split, ROUND(target, 6) AS target, ROUND(MAX(t), 6) AS threshold, ROUND(arg_max(precision, t), 6) AS precision
FROM gf, tg WHERE recall >= target GROUP BY split, target""")
def q_pr_tradeoff_table(spark, sf):
    t = thresholds.recall_tradeoff(grid(spark, sf), RECALL_TARGETS, ["split"])
    return typed(t, [("split", "s"), ("target", "d"), ("threshold", "d"), ("precision", "d")])


@register("threshold_mode", f"""WITH {GRID_SQL},
tq AS (SELECT quantile_cont(score, 0.9) AS q FROM sc WHERE split = 'train'),
fx AS (SELECT MAX(t) AS t FROM gf WHERE split = 'train' AND recall >= 0.8),
pr AS (SELECT MIN(t) AS t FROM gf WHERE split = 'train' AND tp + fp > 0 AND precision >= 0.3)
SELECT 'alarm' AS mode, ROUND(q, 6) AS threshold FROM tq
UNION ALL SELECT 'fixed', ROUND(t, 6) FROM fx
UNION ALL SELECT 'precision', ROUND(COALESCE(pr.t, tq.q), 6) FROM pr, tq""")
def q_threshold_mode(spark, sf):
    from panelrisk.plans.train import choose_threshold

    s = scored(spark, sf).filter("split = 'train'")
    rows = [choose_threshold(s, LABEL, "score", m, alarm_rate=0.10, recall_target=0.8, precision_target=0.3)
            .withColumn("mode", F.lit(m)) for m in ("alarm", "fixed", "precision")]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return typed(out, [("mode", "s"), ("threshold", "d")])


HONEST_SQL = f"""{SCORED_SQL},
tr AS (SELECT *, ROW_NUMBER() OVER (ORDER BY date, entity_id) - 1 AS pos, COUNT(*) OVER () AS n FROM sc WHERE split = 'train'),
va AS (SELECT * FROM tr WHERE pos >= FLOOR(n * 0.75)),
vq AS (SELECT unnest(quantile_cont(score, {_grid_list_sql()})) AS t FROM va),
vt AS (SELECT DISTINCT t FROM vq),
vg AS (SELECT vt.t, SUM(CASE WHEN va.score >= vt.t AND {Y} = 1 THEN 1 ELSE 0 END) AS tp,
              SUM(CASE WHEN va.score >= vt.t AND {Y} <> 1 THEN 1 ELSE 0 END) AS fp FROM vt, va GROUP BY vt.t),
ch AS (SELECT MIN(t) AS t, arg_min(CAST(tp AS DOUBLE) / (tp + fp), t) AS vp FROM vg WHERE tp + fp > 0 AND CAST(tp AS DOUBLE) / (tp + fp) >= 0.3)"""


@register("honest_threshold_transfer", f"""WITH {HONEST_SQL}
SELECT ROUND(ch.t, 6) AS threshold, ROUND(vp, 6) AS validation_precision,
  CAST(SUM(CASE WHEN score >= ch.t THEN 1 ELSE 0 END) AS BIGINT) AS test_alarms,
  ROUND(CASE WHEN SUM(CASE WHEN score >= ch.t THEN 1 ELSE 0 END) > 0 THEN
        CAST(SUM(CASE WHEN score >= ch.t AND {Y} = 1 THEN 1 ELSE 0 END) AS DOUBLE) / SUM(CASE WHEN score >= ch.t THEN 1 ELSE 0 END)
        ELSE 0.0 END, 6) AS test_precision,
  ROUND(CAST(SUM(CASE WHEN score >= ch.t AND {Y} = 1 THEN 1 ELSE 0 END) AS DOUBLE) / SUM(CASE WHEN {Y} = 1 THEN 1 ELSE 0 END), 6) AS test_recall
FROM sc, ch WHERE split = 'test' GROUP BY ch.t, vp""")
def q_honest_threshold_transfer(spark, sf):
    from panelrisk.plans.reports import honest_transfer

    s = scored(spark, sf)
    out = honest_transfer(s, S, LABEL, "score", target_precision=0.3)
    return typed(out, [("threshold", "d"), ("validation_precision", "d"), ("test_alarms", "l"),
                       ("test_precision", "d"), ("test_recall", "d")])


@register("roc_curve", f"""WITH {SCORED_SQL},{_counts_sql('sc', 'split')}
SELECT split, ROUND(score, 6) AS threshold, ROUND(CAST(fp AS DOUBLE) / N, 6) AS fpr, ROUND(CAST(tp AS DOUBLE) / P, 6) AS tpr FROM c""")
def q_roc_curve(spark, sf):
    return typed(metrics.roc_curve(scored(spark, sf), LABEL, "score", ["split"]),
                 [("split", "s"), ("threshold", "d"), ("fpr", "d"), ("tpr", "d")])


@register("pr_curve", f"""WITH {SCORED_SQL},{_counts_sql('sc', 'split')}
SELECT split, ROUND(score, 6) AS threshold, ROUND(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision, ROUND(CAST(tp AS DOUBLE) / P, 6) AS recall FROM c""")
def q_pr_curve(spark, sf):
    return typed(metrics.pr_curve(scored(spark, sf), LABEL, "score", ["split"]),
                 [("split", "s"), ("threshold", "d"), ("precision", "d"), ("recall", "d")])


RATES = [0.01, 0.02, 0.03, 0.05, 0.10]
OP = [("rate", "d"), ("threshold", "d"), ("alarms", "l"), ("precision", "d"), ("recall", "d"), ("tp", "l"),
      ("fp", "l"), ("meets_target", "i")]


def _op_sql(src: str):
    rates = "[" + ", ".join(f"'{r!r}'::DOUBLE" for r in RATES) + "]"
    qs = "[" + ", ".join(f"'{1 - r!r}'::DOUBLE" for r in RATES) + "]"
    return f"""
oq0 AS (SELECT quantile_cont(score, {qs}) AS qv, SUM(CASE WHEN {Y} = 1 THEN 1 ELSE 0 END) AS P FROM {src}),
oq AS (SELECT unnest({rates}) AS rate, unnest(qv) AS thr, P FROM oq0),
ob AS (SELECT oq.rate, oq.thr, oq.P,
         SUM(CASE WHEN x.score >= oq.thr AND x.{Y} = 1 THEN 1 ELSE 0 END) AS tp,
         SUM(CASE WHEN x.score >= oq.thr AND x.{Y} <> 1 THEN 1 ELSE 0 END) AS fp
       FROM oq, {src} x GROUP BY oq.rate, oq.thr, oq.P)"""


@register("operating_points", f"""WITH {SCORED_SQL},
te AS (SELECT * FROM sc WHERE split = 'test'),{_op_sql('te')}
SELECT ROUND(rate, 6) AS rate, ROUND(thr, 6) AS threshold, CAST(tp + fp AS BIGINT) AS alarms,
  ROUND(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END, 6) AS precision,
  ROUND(CASE WHEN P > 0 THEN CAST(tp AS DOUBLE) / P ELSE 0.0 END, 6) AS recall,
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  CAST(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END >= 0.3 AS INTEGER) AS meets_target
FROM ob""")
def q_operating_points(spark, sf):
    te = scored(spark, sf).filter("split = 'test'")
    return typed(metrics.at_top_rates(te, LABEL, "score", RATES, target_precision=0.3), OP)


@register("max_recall_at_precision", f"""WITH {SCORED_SQL},
te AS (SELECT * FROM sc WHERE split = 'test'),{_counts_sql('te', '')},
pr AS (SELECT CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / P AS recall FROM c),
tg AS (SELECT unnest([0.3, 0.4]) AS target)
SELECT ROUND(target, 6) AS target, ROUND(COALESCE(MAX(CASE WHEN precision >= target THEN recall END), 0.0), 6) AS max_recall,
  ROUND(MAX(precision), 6) AS max_precision FROM pr, tg GROUP BY target""")
def q_max_recall_at_precision(spark, sf):
    te = scored(spark, sf).filter("split = 'test'")
    return typed(metrics.max_recall_at_precision(te, LABEL, "score", [0.3, 0.4]),
                 [("target", "d"), ("max_recall", "d"), ("max_precision", "d")])


@register("max_precision_at_recall", f"""WITH {SCORED_SQL},
te AS (SELECT * FROM sc WHERE split = 'test'),{_counts_sql('te', '')},
pr AS (SELECT CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / P AS recall FROM c),
tg AS (SELECT unnest([0.5, 0.3, 0.2, 0.1]) AS target)
SELECT ROUND(target, 6) AS target, ROUND(MAX(CASE WHEN recall >= target THEN precision END), 6) AS max_precision
FROM pr, tg GROUP BY target""")
def q_max_precision_at_recall(spark, sf):
    te = scored(spark, sf).filter("split = 'test'")
    return typed(metrics.max_precision_at_recall(te, LABEL, "score", [0.5, 0.3, 0.2, 0.1]),
                 [("target", "d"), ("max_precision", "d")])


@register("lift", f"""WITH {SCORED_SQL},
tq AS (SELECT split, quantile_cont(score, 0.9) AS thr FROM sc GROUP BY split)
SELECT split, ROUND((CAST(SUM(CASE WHEN score >= thr AND {Y} = 1 THEN 1 ELSE 0 END) AS DOUBLE) / SUM(CASE WHEN score >= thr THEN 1 ELSE 0 END))
  / AVG(CAST({Y} AS DOUBLE)), 6) AS lift_top10 FROM sc JOIN tq USING (split) GROUP BY split""")
def q_lift(spark, sf):
    s = scored(spark, sf)
    op = metrics.at_top_rates(s, LABEL, "score", [0.10], ["split"])
    base = s.groupBy("split").agg(F.avg(F.col(LABEL).cast("double")).alias("base_rate"))
    out = op.join(base, "split").select("split", F.try_divide("precision", "base_rate").alias("lift_top10"))
    return typed(out, [("split", "s"), ("lift_top10", "d")])
