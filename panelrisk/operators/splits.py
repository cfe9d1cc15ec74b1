"""Chronological splits.

No split copies data: each adds a ``split``/``fold`` column that later steps
filter on, and the split filter stays above the history windows (features of
test rows need their train-period history).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.operators.positions import attach, group_sizes, numeric_key, with_positions
from panelrisk.session import cut_lineage
from panelrisk.spec import PanelSpec


def calendar_split(df: DataFrame, spec: PanelSpec, train_frac: float = 0.8, test_end=None,
                   out: str = "split", by=(), span_of: DataFrame | None = None) -> DataFrame:
    """``train`` if date <= min + frac·(max - min) on the time axis, else ``test``.

    With ``test_end`` (a date), test rows after it get split NULL (B18): the
    day itself is kept. ``span_of`` is a written table of the same dates, if there
    is one; otherwise ``df`` is written to be read twice.
    """
    if span_of is None:
        df = span_of = cut_lineage(df)  # read by the span aggregate and by the labelling pass
    dn = numeric_key(df, spec.date)
    span = span_of.groupBy(*by).agg(F.min(dn).alias("_d0"), F.max(dn).alias("_d1"))
    o = attach(df, span, by)
    is_train = (dn - F.col("_d0")) <= F.lit(train_frac) * (F.col("_d1") - F.col("_d0"))
    s = F.when(is_train, F.lit("train"))
    if test_end is not None:
        s = s.when(F.col(spec.date) <= F.lit(test_end).cast("date"), F.lit("test"))
    else:
        s = s.otherwise(F.lit("test"))
    return o.withColumn(out, s).drop("_d0", "_d1")


def trim_test_end(split_df: DataFrame, spec: PanelSpec, test_end, split: str = "split") -> DataFrame:
    """Drop test rows after ``test_end`` (censored label tail)."""
    keep = (F.col(split) == "train") | (F.col(spec.date) <= F.lit(test_end).cast("date"))
    return split_df.filter(keep)


def time_positions(df: DataFrame, spec: PanelSpec, by=(), out: str = "pos") -> DataFrame:
    """Global 0-based position after sorting by (date, entity)."""
    return with_positions(df, spec.date, by=by, tiebreak=spec.entity, out=out)


def validation_tail(train: DataFrame, spec: PanelSpec, frac: float = 0.25, out: str = "role") -> DataFrame:
    """Last ``frac`` of train rows by (date, entity) → ``validation``; rest ``fit``.

    Cut = int(n·(1-frac)) rows, like slicing a date-sorted frame.
    """
    p = time_positions(train, spec)
    p = attach(p, group_sizes(p))
    cut = F.floor(F.col("n") * (1 - frac))
    return p.withColumn(out, F.when(F.col("pos") < cut, "fit").otherwise("validation")).drop("n")


def expanding_folds(df: DataFrame, spec: PanelSpec, k: int = 5, pos: str | None = None) -> DataFrame:
    """Expanding-window folds over (date, entity) positions.

    With n rows and t = n div (k+1), fold i (0-based) tests positions
    [n-(k-i)·t, n-(k-i)·t+t) and trains on every earlier position. Adds
    ``pos`` and ``test_fold`` (NULL for rows in no test window).
    """
    p = df if pos else time_positions(df, spec)
    pos = pos or "pos"
    p = attach(p, group_sizes(p))
    t = F.floor(F.col("n") / (k + 1))
    first_test = F.col("n") - k * t
    fold = F.when(F.col(pos) >= first_test, F.floor((F.col(pos) - first_test) / t)).cast("int")
    return p.withColumn("test_fold", F.when(fold < k, fold)).withColumn("fold_size", t.cast("bigint")).drop("n")


def fold_table(spark, k: int) -> DataFrame:
    return spark.range(k).select(F.col("id").cast("int").alias("fold"))


def expand_folds(folded: DataFrame, k: int, pos: str = "pos") -> DataFrame:
    """One row per (row, fold) it takes part in, with ``role`` train/test.

    The k-row fold table is broadcast; the range condition is a per-row filter
    on the row's own position, so no data rows are paired with each other.
    """
    folds = fold_table(folded.sparkSession, k)
    sizes = folded.agg(F.count(F.lit(1)).alias("_n"))
    x = attach(folded, sizes).crossJoin(F.broadcast(folds))
    start = F.col("_n") - (k - F.col("fold")) * F.col("fold_size")
    role = F.when(F.col(pos) < start, "train").when(F.col(pos) < start + F.col("fold_size"), "test")
    return x.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_n")


def row_count_split(series: DataFrame, ds: str = "ds", train_frac: float = 0.8, out: str = "split") -> DataFrame:
    """First int(n·frac) periods → train, the rest → holdout.

    The series has one row per period (bounded by the calendar), so a plain
    ordered window is fine here.
    """
    from pyspark.sql import Window

    p = series.withColumn("_i", F.row_number().over(Window.orderBy(ds)) - 1)
    n = series.agg(F.count(F.lit(1)).alias("_n"))
    p = attach(p, n)
    return p.withColumn(out, F.when(F.col("_i") < F.floor(F.col("_n") * train_frac), "train").otherwise("holdout")) \
        .drop("_i", "_n")
