"""Ranking and operating-point metrics, grouped by any ``by`` columns.

Everything starts from the table of distinct scores per group with their
positive/negative counts; running counts in descending score order (built by
distributed positions) give TP and FP at every threshold. AUC and average
precision are sums over that table, so one job serves any number of
(split, model, dataset, fold) groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.operators.positions import attach, exact_quantiles, with_positions
from panelrisk.session import cut_lineage


def score_table(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """(by…, score, pos, neg, tp, fp, P, N): cumulative counts at threshold ``score``.

    ``tp``/``fp`` count rows with score >= this score (alarms at that threshold).
    """
    by = list(by)
    g = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("long").alias("neg"),
    )
    c = with_positions(g, score, by=by, descending=True, cumulative=["pos", "neg"], out="_rank")
    c = cut_lineage(c.withColumnRenamed("pos_cum", "tp").withColumnRenamed("neg_cum", "fp").drop("_rank"))
    totals = c.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return attach(c, totals, by)


def auc_ap(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """ROC AUC (ties count ½) and step-wise average precision per group.

    A group of one class has no AUC (NULL); without positives its average precision is 0.
    """
    t = score_table(df, label, score, by)
    below = F.col("N") - F.col("fp")  # negatives strictly below this score
    auc_term = F.col("pos") * (below + 0.5 * F.col("neg"))
    ap_term = F.when(F.col("pos") > 0, F.col("pos") / F.col("P") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return t.groupBy(*by).agg(
        F.try_divide(F.sum(auc_term), F.first("P") * F.first("N")).alias("roc_auc"),
        F.coalesce(F.sum(ap_term), F.lit(0.0)).alias("average_precision"),
    )


def roc_curve(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """(by…, threshold, fpr, tpr) at every distinct score."""
    t = score_table(df, label, score, by)
    return t.select(*by, F.col(score).alias("threshold"), F.try_divide("fp", "N").alias("fpr"),
                    F.try_divide("tp", "P").alias("tpr"))


def pr_curve(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """(by…, threshold, precision, recall) at every distinct score."""
    t = score_table(df, label, score, by)
    return t.select(*by, F.col(score).alias("threshold"),
                    (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                    F.try_divide("tp", "P").alias("recall"))


def confusion(df: DataFrame, label: str, alarm: str, by=()) -> DataFrame:
    """TP/FP/FN/TN and alarm count."""
    y, a = F.col(label) == 1, F.col(alarm) == 1
    s = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return df.groupBy(*by).agg(
        s(y & a).alias("tp"), s(~y & a).alias("fp"), s(y & ~a).alias("fn"), s(~y & ~a).alias("tn"),
        s(a).alias("alarms"),
    )


def classification_report(df: DataFrame, label: str, alarm: str, by=()) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages.

    Zero divisions give 0, as with ``zero_division=0``.
    """
    by = list(by)
    c = confusion(df, label, alarm, by)

    def prf(tp, fp, fn):
        p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
        r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
        return p, r, f

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    n1, n0 = tp + fn, tn + fp
    n = n1 + n0
    rows = [
        ("'0'", p0, r0, f0, n0),
        ("'1'", p1, r1, f1, n1),
        ("'macro avg'", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        ("'weighted avg'", (p0 * n0 + p1 * n1) / n, (r0 * n0 + r1 * n1) / n, (f0 * n0 + f1 * n1) / n, n),
        ("'accuracy'", F.lit(None).cast("double"), F.lit(None).cast("double"), (tp + tn) / n, n),
    ]
    wide = c.select(*by, *[
        F.struct(F.expr(k).alias("row"), pp.cast("double").alias("precision"), rr.cast("double").alias("recall"),
                 ff.cast("double").alias("f1"), ss.cast("long").alias("support")).alias(f"_r{i}")
        for i, (k, pp, rr, ff, ss) in enumerate(rows)
    ])
    return wide.select(*by, F.explode(F.array(*[f"_r{i}" for i in range(len(rows))])).alias("r")).select(*by, "r.*")


def at_top_rates(df: DataFrame, label: str, score: str, rates: list[float], by=(), target_precision=None) -> DataFrame:
    """Operating points at the top ``rate`` share of scores.

    Threshold = quantile(score, 1 - rate) (exact, linear); alarms = score >= it.
    Counting happens on the distinct-score table, joined to the ≤ len(rates)
    thresholds per group.
    """
    by = list(by)
    rates = list(dict.fromkeys(rates))
    th = exact_quantiles(df, score, [1 - r for r in rates], by).withColumn("rate", F.round(1 - F.col("q"), 10))
    # one row per group with its thresholds: every score row is read once, whatever the number of rates
    th = th.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rate", "value"))).alias("_th"))
    joined = attach(score_table(df, label, score, by), th, by)
    aggs, points = [F.first("P").alias("P"), F.first("_th").alias("_th")], []
    for i in range(len(rates)):
        point = F.get("_th", F.lit(i))
        hit = F.col(score) >= point["value"]
        aggs += [F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(f"_{c}{i}") for c in ("pos", "neg")]
        points.append(F.struct(point["rate"].alias("rate"), point["value"].alias("value"), F.col(f"_pos{i}").alias("tp"), F.col(f"_neg{i}").alias("fp")))
    agg = joined.groupBy(*by).agg(*aggs).select(*by, "P", F.explode(F.array(*points)).alias("_p")).select(*by, "P", "_p.*")
    out = agg.select(
        *by, "rate", F.col("value").alias("threshold"), (F.col("tp") + F.col("fp")).alias("alarms"),
        F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0).alias("precision"),
        F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(0.0).alias("recall"),
        F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
    )
    if target_precision is not None:
        out = out.withColumn("meets_target", (F.col("precision") >= target_precision).cast("int"))
    return out


def max_recall_at_precision(df: DataFrame, label: str, score: str, targets: list[float], by=()) -> DataFrame:
    """Best recall on the PR curve with precision >= target; also the max precision."""
    by = list(by)
    pr = pr_curve(df, label, score, by)
    best = [F.coalesce(F.max(F.when(F.col("precision") >= t, F.col("recall"))), F.lit(0.0)) for t in targets]
    return _per_target(pr, targets, best, "max_recall", by, [F.max("precision").alias("max_precision")])


def max_precision_at_recall(df: DataFrame, label: str, score: str, targets: list[float], by=()) -> DataFrame:
    """Ceiling table: max precision on the PR curve with recall >= target."""
    pr = pr_curve(df, label, score, list(by))
    return _per_target(pr, targets, [F.max(F.when(F.col("recall") >= t, F.col("precision"))) for t in targets], "max_precision", list(by))


def _per_target(pr: DataFrame, targets: list[float], aggs: list, out: str, by: list[str], more=()) -> DataFrame:
    """(by…, target, ``out``, …): the aggregate of each target from one pass over the curve."""
    wide = pr.groupBy(*by).agg(*[a.alias(f"_t{i}") for i, a in enumerate(aggs)], *more)
    rest = [c for c in wide.columns if not c.startswith("_t") and c not in by]
    points = F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"_t{i}").alias(out)) for i, t in enumerate(targets)])
    return wide.select(*by, *rest, F.explode(points).alias("_p")).select(*by, "_p.*", *rest)


def forecast_errors(df: DataFrame, actual: str, pred: str, by=()) -> DataFrame:
    """MAE, RMSE and MAPE % (zero actuals excluded; NULL when none)."""
    e = F.col(actual) - F.col(pred)
    return df.filter(F.col(actual).isNotNull() & F.col(pred).isNotNull()).groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.when(F.col(actual) != 0, F.abs(e / F.col(actual)))) * 100).alias("mape"),
    )
