"""Threshold selection (J01–J06) in one pass per group.

The candidate grid is the set of distinct values among 400 exact quantiles at
linspace(.001, .999). Each distinct score falls in a grid bucket
(number of grid values <= score); per-bucket positive/negative counts and
suffix sums over at most 401 buckets give TP/FP for every candidate at once,
instead of rescanning the data 400 times.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.operators.positions import count_less, exact_quantiles, join_groups
from panelrisk.session import cut_lineage

GRID = [float(x) for x in np.linspace(0.001, 0.999, 400)]


def alarm_rate_threshold(df: DataFrame, score: str, rate: float, by=()) -> DataFrame:
    """quantile(score, 1 - rate) per group (J01): (by…, threshold)."""
    q = exact_quantiles(df, score, [1.0 - rate], by)
    return q.select(*by, F.col("value").alias("threshold"))


def grid_table(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """(by…, threshold, tp, fp, P, N) for every candidate threshold of the grid."""
    by = list(by)
    qs = exact_quantiles(df, score, GRID, by)
    # at most 400 values per group: a small array
    grid = cut_lineage(qs.groupBy(*by).agg(F.array_sort(F.array_distinct(F.collect_list("value"))).alias("_ths")))
    g = df.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
    )
    g = join_groups(g, grid, by) if by else g.crossJoin(F.broadcast(grid))  # one row; with groups the size decides
    g = g.withColumn("_bucket", count_less("_ths", F.col(score), inclusive=True))
    b = g.groupBy(*by, "_bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # every bucket index 0..len(grid) per group, so candidate j meets its suffix sum by equality
    dense = grid.select(*by, F.explode(F.sequence(F.lit(0), F.size("_ths"))).alias("_bucket"))
    b = dense.join(b, [*by, "_bucket"], "left").fillna(0, ["pos", "neg"])
    suffix = Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding,
                                                                          Window.currentRow)
    whole = Window.partitionBy(*by)
    b = cut_lineage(b.select(*by, "_bucket", F.sum("pos").over(suffix).alias("tp"), F.sum("neg").over(suffix).alias("fp"),
                             F.sum("pos").over(whole).alias("P"), F.sum("neg").over(whole).alias("N")))
    # candidate j (1-based) alarms the scores in buckets >= j
    cand = grid.select(*by, F.posexplode("_ths").alias("_j0", "threshold")).withColumn("_bucket", F.col("_j0") + 1)
    out = cand.join(b, [*by, "_bucket"], "inner").select(*by, "threshold", "tp", "fp", "P", "N")
    out = cut_lineage(out)
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f)


def recall_threshold(grid: DataFrame, target: float, by=()) -> DataFrame:
    """Highest candidate with recall >= target → (threshold, precision)."""
    ok = grid.filter(F.col("recall") >= target)
    return ok.groupBy(*by).agg(
        F.max("threshold").alias("threshold"), F.max_by("precision", "threshold").alias("precision")
    )


def precision_threshold(grid: DataFrame, target: float, by=()) -> DataFrame:
    """Lowest candidate with alarms > 0 and precision >= target → (threshold, precision, recall)."""
    ok = grid.filter((F.col("tp") + F.col("fp") > 0) & (F.col("precision") >= target))
    return ok.groupBy(*by).agg(
        F.min("threshold").alias("threshold"),
        F.min_by("precision", "threshold").alias("precision"),
        F.min_by("recall", "threshold").alias("recall"),
    )


def f1_threshold(grid: DataFrame, by=()) -> DataFrame:
    """Candidate with the highest F1, the lowest one on ties."""
    w = Window.partitionBy(*by).orderBy(F.desc("f1"), F.asc("threshold"))
    return grid.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*by, "threshold", "f1")


def recall_tradeoff(grid: DataFrame, targets: list[float], by=()) -> DataFrame:
    """For each recall target: precision and threshold of J02."""
    by = list(by)
    tg = grid.sparkSession.createDataFrame([(float(t),) for t in targets], "target double")
    j = grid.crossJoin(F.broadcast(tg)).filter(F.col("recall") >= F.col("target"))
    return j.groupBy(*by, "target").agg(
        F.max("threshold").alias("threshold"), F.max_by("precision", "threshold").alias("precision")
    )
