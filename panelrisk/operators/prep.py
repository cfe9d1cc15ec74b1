"""Preprocessing fitted on train, applied anywhere.

Fitting runs as grouped aggregates over the stacked (feature, value) table,
so all columns are fitted in one job. Medians and modes (one value per column)
travel as literals in the transform expressions; the categories' codes are a
table, however long, that a join looks up: Spark broadcasts it only where it is small.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.operators.positions import quantiles_of_counts, with_positions
from panelrisk.session import cut_lineage


@dataclass
class Preprocessor:
    numeric: list[str]
    categorical: list[str]
    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    dictionary: DataFrame | None = None  # (feature, value, code)
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        """Keys of ``means`` and ``stds``, in the order of the output columns."""
        return [*self.numeric, *(f"cat__{c}" for c in self.categorical)]

    @property
    def output_columns(self) -> list[str]:
        return [f"num__{c}" for c in self.numeric] + [f"cat__{c}" for c in self.categorical]


def numeric_medians(train: DataFrame, cols: list[str], look: int = 50_000, near: float = 0.015) -> DataFrame:
    """(feature, median) — linear-interpolated 0.5 quantile of non-NULL values.

    Two cuts around every median are guessed from about ``look`` rows. Then every
    row is counted: values outside the cuts as one low and one high value, so only
    those between are told apart (some in a hundred, or few distinct ones). The
    counts show whether the middle ranks do lie between; a feature of which they
    do not is counted again without cuts.
    """
    known = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    n = train.count()
    some = train if n <= look else train.sample(look / n, 42)
    cuts = some.agg(*[F.percentile_approx(known(c), [0.5 - near, 0.5 + near], 2000).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    cuts = {c: cuts[f"q{i}"] or [-math.inf, math.inf] for i, c in enumerate(cols)}
    counts = cut_lineage(_counts_between(train, cuts))
    low, high = F.sum(F.when(F.col("_side") < 0, F.col("_cnt")).otherwise(0)), F.sum(F.when(F.col("_side") > 0, F.col("_cnt")).otherwise(0))
    sides = counts.groupBy("feature").agg(low.alias("low"), high.alias("high"), F.sum("_cnt").alias("n")).collect()  # one row per feature
    missed = [r.feature for r in sides if r.low > (r.n - 1) // 2 or r.high > (r.n - 1) // 2]
    if missed:
        whole = _counts_between(train, {c: [-math.inf, math.inf] for c in missed})
        counts = counts.filter(~F.col("feature").isin(missed)).unionByName(whole)
    return quantiles_of_counts(counts.drop("_side"), "value", [0.5], ["feature"]).select("feature", F.col("value").alias("median"))


def _counts_between(train: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """(feature, value, _side, _cnt): distinct values between the two cuts of each column; below is -inf, above inf."""
    names = list(cuts)
    at = lambda which: F.get(F.lit([float(cuts[c][which]) for c in names]), F.col("_i"))
    expr = ", ".join(f"{i}, CAST(`{c}` AS DOUBLE)" for i, c in enumerate(names))
    long = train.selectExpr(f"stack({len(names)}, {expr}) AS (_i, _v)").filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    long = long.withColumn("_side", F.when(F.col("_v") < at(0), -1).when(F.col("_v") > at(1), 1).otherwise(0))
    value = F.when(F.col("_side") < 0, -math.inf).when(F.col("_side") > 0, math.inf).otherwise(F.col("_v"))
    counts = long.groupBy("_i", value.alias("value"), "_side").agg(F.count(F.lit(1)).alias("_cnt"))
    return counts.select(F.get(F.lit(names), F.col("_i")).alias("feature"), "value", "_side", "_cnt")


def category_counts(train: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, num, n): value as text, numeric value for ordering (NULL for text)."""
    expr = ", ".join(f"'{c}', CAST(`{c}` AS STRING), TRY_CAST(`{c}` AS DOUBLE)" for c in cols)
    long = train.selectExpr(f"stack({len(cols)}, {expr}) AS (feature, value, num)").filter(F.col("value").isNotNull())
    return long.groupBy("feature", "value", "num").agg(F.count(F.lit(1)).alias("n"))


def category_modes(train: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, mode): most frequent value, the smallest one on ties."""
    c = category_counts(train, cols)
    w = Window.partitionBy("feature").orderBy(F.desc("n"), F.asc_nulls_last("num"), "value")
    return c.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("feature", F.col("value").alias("mode"))


def category_dictionary(train: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, code): sorted categories → 0..n-1 (numbers numerically, text lexically)."""
    placed = with_positions(category_counts(train, cols), "num", by=["feature"], tiebreak="value", out="code")
    return placed.select("feature", "value", "code")


def fit_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str], standardize: bool = False) -> Preprocessor:
    """Fit medians, modes and dictionaries on ``train`` (H04); optional train mean/population std."""
    p = Preprocessor(list(numeric), list(categorical))
    if numeric:
        p.medians = {r.feature: r.median for r in numeric_medians(train, numeric).collect()}
    if categorical:
        p.modes = {r.feature: r.mode for r in category_modes(train, categorical).collect()}
        p.dictionary = cut_lineage(category_dictionary(train, categorical))
    if standardize and p.output_columns:  # the whole matrix, codes included
        imputed = transform(train, p)
        aggs = []
        for i, c in enumerate(p.output_columns):
            aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
        row = imputed.agg(*aggs).collect()[0]
        names = p.names
        p.means = {c: row[f"m{i}"] for i, c in enumerate(names)}
        p.stds = {c: row[f"s{i}"] for i, c in enumerate(names)}
    return p


def _impute_num(c: str, p: Preprocessor) -> Column:
    x = F.col(f"`{c}`").cast("double")
    x = F.when(F.isnan(x), None).otherwise(x)
    return F.coalesce(x, F.lit(p.medians.get(c))).alias(f"num__{c}")


def encode(df: DataFrame, p: Preprocessor) -> DataFrame:
    """Adds ``cat__<column>``: the category's code, that of the mode for NULL, -1 for an unseen one."""
    for i, c in enumerate(p.categorical):
        if p.dictionary is None:
            df = df.withColumn(f"cat__{c}", F.lit(-1.0))
            continue
        own = p.dictionary.filter(F.col("feature") == c).select(F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}"))
        df = df.join(own, F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(p.modes.get(c))) == F.col(f"_value{i}"), "left")
        df = df.withColumn(f"cat__{c}", F.coalesce(F.col(f"_code{i}").cast("double"), F.lit(-1.0))).drop(f"_value{i}", f"_code{i}")
    return df


def transform(df: DataFrame, p: Preprocessor, keep: list[str] = (), standardize: bool = False) -> DataFrame:
    """Numeric block then categorical block, other columns dropped except ``keep``; unseen → -1."""
    cols = [F.col(k) for k in keep] + [_impute_num(c, p) for c in p.numeric] + [F.col(f"cat__{c}") for c in p.categorical]
    out = encode(df, p).select(*cols)
    if standardize:
        out = out.withColumns({
            x: (F.col(f"`{x}`") - F.lit(p.means.get(c) or 0.0)) / F.lit(p.stds.get(c) or 1.0) for x, c in zip(p.output_columns, p.names)
        })
    return out


def assemble(df: DataFrame, p: Preprocessor, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=p.output_columns, outputCol=out, handleInvalid="keep").transform(df)
