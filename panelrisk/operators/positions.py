"""Global row positions and prefix sums without a single-partition sort.

``row_number() over (order by …)`` with no partition moves every row into one
task. Here the rows go through one range exchange on (group, key, tie-break, row
hash): Spark samples the keys, every task sorts one range and numbers its rows,
and the ranges are written once. The counts of (group, range) then give each
range its offset; a position is offset plus number. The cost is that of one
sort, whatever the number of ranges. A key that a third of all rows share is cut
by the tie-break, or by the hash of the row where there is none, so rows that
tie come out in the same order on every run. Groups are sorted like keys: a
large one spans ranges, small ones share one, and rows of a NULL group are a group.

Used for time positions (E12), ranks (E11), row-count splits and folds
(G02–G04), hash-ordered sampling (G05–G09), exact quantiles (J01) and the
cumulative counts behind ROC/PR metrics (K01–K10).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, MapType, StringType, TimestampNTZType, TimestampType

from panelrisk.session import cut_lineage

ROWS_PER_RANGE = 1_000_000
MIN_RANGES = 16


def count_less(arr: str, key: Column, inclusive: bool = False, most: int = 1 << 10) -> Column:
    """Number of elements of the sorted array column ``arr`` that are < ``key`` (<= if inclusive).

    Binary search for arrays of fewer than ``most`` (a power of two) elements: log2(``most``) steps.
    """
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(most.bit_length() - 1))])

    def step(at: Column, by: Column) -> Column:
        probe = F.get(F.col(arr), at + by - 1)  # NULL behind the end
        below = probe <= key if inclusive else probe < key
        return F.when(F.coalesce(below, F.lit(False)), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def range_count(n_rows: int, rows_per_range: int = ROWS_PER_RANGE) -> int:
    """Ranges grow with the data so every range stays around ``rows_per_range`` rows."""
    return int(max(MIN_RANGES, -(-n_rows // rows_per_range)))


def numeric_key(df: DataFrame, col: str) -> Column:
    dt = df.schema[col].dataType
    if isinstance(dt, DateType):
        return F.datediff(F.col(col), F.lit("1970-01-01").cast("date")).cast("double")
    if isinstance(dt, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    if isinstance(dt, StringType):  # the first six bytes: in the strings' order, ties left to the final sort
        return F.conv(F.rpad(F.hex(F.substring(F.col(col).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(col).cast("double")


def with_positions(
    df: DataFrame,
    order: str,
    by: list[str] | tuple = (),
    descending: bool = False,
    tiebreak: str | None = None,
    cumulative: list[str] | tuple = (),
    out: str = "pos",
    n_ranges: int | None = None,
    keep_ranges: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``out`` = 0-based position within ``by`` in order (``order`` [desc], ``tiebreak`` asc).

    For each column ``c`` in ``cumulative`` also add ``c_cum``: the inclusive
    running sum of ``c`` in that order. Rows with a NULL ``order`` key come last.
    With ``keep_ranges`` the range of every row stays as ``_range``.
    """
    by, cum = list(by), list(cumulative)
    d = cut_lineage(df)  # read by the sampling of the exchange and by the exchange
    if n_ranges is None:
        n_ranges = range_count(d.count(), rows_per_range)  # a metadata count on the written table
    hashed = [f"`{f.name}`" for f in d.schema.fields if not isinstance(f.dataType, MapType)]
    d = d.withColumn("_hash", F.xxhash64(*[F.col(c) for c in hashed]))
    key = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    keys = [*[F.col(c).asc() for c in by], key, *([F.col(tiebreak).asc()] if tiebreak else []), F.col("_hash").asc()]
    d = d.repartitionByRange(n_ranges, *keys).sortWithinPartitions(*keys)
    # range << 33 | number of the row in its sorted range
    d = cut_lineage(d.withColumn("_at", F.monotonically_increasing_id()).drop("_hash"))
    d = d.withColumn("_range", F.shiftright("_at", 33))
    totals = d.groupBy(*by, "_range").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), *[F.sum(c).alias(f"_t_{c}") for c in cum]
    )
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *by, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cum],
    )
    d = join_groups(d, totals, [*by, "_range"]).withColumn(out, F.col("_at") + F.col("_shift"))
    running = Window.partitionBy(*by, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in cum:
        d = d.withColumn(f"{c}_cum", F.col(f"_o_{c}") + F.sum(c).over(running))
    return d.drop("_at", "_shift", *[f"_o_{c}" for c in cum], *([] if keep_ranges else ["_range"]))


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on the columns ``by`` in which NULL matches NULL; the columns come from ``left``."""
    r = right.select(*[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], *[c for c in right.columns if c not in by])
    on = [F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)]
    return left.join(r, on, how).drop(*[f"_by_{i}" for i in range(len(by))])


def group_sizes(df: DataFrame, by: list[str] | tuple = (), out: str = "n") -> DataFrame:
    """Row count per group (one row per group; a single row without ``by``)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def attach(df: DataFrame, small: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """Join a per-group (or single-row) aggregate back onto ``df``.

    A single row is broadcast. With groups (splits, datasets, or as many as
    there are entities) the size decides: no hint is given, but ``small`` is
    written first. Its size is known then, so a small one is broadcast and ``df``
    is not dealt by a key of a few values.
    """
    by = list(by)
    return join_groups(df, cut_lineage(small), by) if by else df.crossJoin(F.broadcast(small))


def asof_lookup(left: DataFrame, right: DataFrame, by: list[str] | tuple, left_key: str, right_key: str,
                payload: list[str]) -> DataFrame:
    """For each ``left`` row: ``payload`` of the ``right`` row with the largest right_key <= left_key.

    Both inputs are small per group (ranges, horizons, wanted ranks). The two
    tables are unioned and one ordered window carries the last right row
    forward, so no left row is paired with every right row.
    """
    by = list(by)
    l_cols = [c for c in left.columns if c not in by]
    lt = left.select(*by, F.col(left_key).cast("double").alias("_ak"), F.lit(1).alias("_side"),
                     F.struct(*l_cols).alias("_l"), F.lit(None).cast(
                         right.select(F.struct(*payload).alias("p")).schema["p"].dataType).alias("_r"))
    rt = right.select(*by, F.col(right_key).cast("double").alias("_ak"), F.lit(0).alias("_side"),
                      F.lit(None).cast(lt.schema["_l"].dataType).alias("_l"), F.struct(*payload).alias("_r"))
    w = Window.partitionBy(*by).orderBy("_ak", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = lt.unionByName(rt).withColumn("_hit", F.last("_r", ignorenulls=True).over(w))
    return u.filter("_side = 1").select(*by, "_l.*", "_hit.*")


def exact_quantiles(df: DataFrame, col: str, probs: list[float], by: list[str] | tuple = ()) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy's default) per group.

    Returns (by…, q, value). Works on the table of distinct values with their
    counts: running counts give each value its rank interval; the 2·len(probs)
    wanted ranks per group are located first among the position ranges (small
    × small), then equi-joined to the value table on the range key, so no row
    is compared with every wanted rank and no group is gathered in one task.
    """
    g = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_cnt"))
    return quantiles_of_counts(g, col, probs, by)


def quantiles_of_counts(g: DataFrame, col: str, probs: list[float], by: list[str] | tuple = ()) -> DataFrame:
    """:func:`exact_quantiles` of the table of distinct values ``col`` and their counts ``_cnt``."""
    by = list(by)
    spark = g.sparkSession
    p = cut_lineage(with_positions(g, col, by=by, cumulative=["_cnt"], keep_ranges=True))
    p = p.withColumn("_start", F.col("_cnt_cum") - F.col("_cnt"))
    ranges = p.groupBy(*by, "_range").agg(F.min("_start").alias("_r0"), F.max("_cnt_cum").alias("_r1"))
    n = p.groupBy(*by).agg(F.sum("_cnt").alias("_n"))
    qs = spark.createDataFrame([(float(q),) for q in probs], "q double")
    h = (F.col("_n") - 1) * F.col("q")
    wanted = n.crossJoin(F.broadcast(qs))  # groups × probabilities: small
    wanted = wanted.withColumn("_h", h).withColumn("_lo", F.floor("_h")).withColumn("_hi", F.ceil("_h"))
    ranks = wanted.select(*by, "q", "_h", F.explode(F.array("_lo", "_hi")).alias("_r")).distinct()
    # the range holding rank r is the one with the largest start <= r
    located = asof_lookup(ranks, ranges, by, "_r", "_r0", ["_range"])
    vals = join_groups(p, located, [*by, "_range"]).filter(
        (F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_cnt_cum"))
    ).select(*by, "q", "_h", "_r", F.col(col).cast("double").alias("_v"))
    lo_v = F.min_by("_v", "_r")
    hi_v = F.max_by("_v", "_r")
    out = vals.groupBy(*by, "q").agg(lo_v.alias("_vlo"), hi_v.alias("_vhi"), F.first("_h").alias("_h"))
    frac = F.col("_h") - F.floor("_h")
    return out.select(*by, "q", (F.col("_vlo") + frac * (F.col("_vhi") - F.col("_vlo"))).alias("value"))
