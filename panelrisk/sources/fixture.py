"""Entity-by-day fixture panel derived from ``lineitem`` and ``supplier``.

Entity = supplier, day = ship date. The panel has the shape of the vehicle-day
files the library is written for: daily usage with trailing 7/30-day sums,
maintenance and event counters that reset, fleet-wide weather-like exogenous
columns, and forward-looking 7/30-day event labels.

Plan shape (what scales): lineitem is aggregated to one row per
(supplier, day) with map-side partial aggregation; the per-day fleet size is
counted on lineitem, an aggregate bounded by the number of calendar days and is broadcast back;
the supplier attributes are joined on the entity key (Spark picks broadcast or
sort-merge by size); all per-entity windows share one
``partitionBy(entity).orderBy(day)`` so they cost one exchange and one sort.
A window partition holds at most one row per calendar day, so no entity can
make a task grow with the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelrisk.sources.tables import table

# Fixed values of the fixture definition: weather code by (fleet line count % 7).
WEATHER_CODES = [0, 1, 3, 51, 61, 63, 71]


def day_number(d: Column) -> Column:
    """Days since 1970-01-01 (int)."""
    return F.datediff(d, F.lit("1970-01-01").cast("date"))


def fixture_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus"
    )
    q = F.col("l_quantity")
    # lines without a supplier are in no entity's days (they count for the fleet)
    entity_day = li.filter(F.col("l_suppkey").isNotNull()).groupBy(
        F.col("l_suppkey").alias("entity_id"), F.to_date("l_shipdate").alias("date")
    ).agg(
        F.sum(q).cast("bigint").alias("use_today"),
        F.max(((F.col("l_returnflag") == "R") & (q >= 45)).cast("int")).alias("ev"),
        F.max(((F.col("l_linestatus") == "F") & (q <= 5)).cast("int")).alias("mt"),
    )
    # one row per calendar day: bounded by the date span, safe to broadcast; counted on the lines, so
    # that the (entity, day) aggregate is shuffled once
    fleet = li.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count(F.lit(1)).cast("int").alias("fn"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")

    base = (
        entity_day.join(supplier, entity_day.entity_id == supplier.s_suppkey)
        .join(F.broadcast(fleet), "date")
        .withColumn("dn", day_number(F.col("date")))
    )
    by_entity = Window.partitionBy("entity_id").orderBy("dn")
    running = by_entity.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # later rows come first in this order: a growing frame, summed up once, instead of a shrinking one
    ahead = Window.partitionBy("entity_id").orderBy(F.col("dn").desc()).rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("cu", F.sum("use_today").over(running))

    fn = F.col("fn")
    doy = F.dayofyear("date")
    season_temp = F.round(12 - 16 * F.cos(2 * F.pi() * (doy - 20) / 365.25), 1)
    next_ev = F.min(F.when(F.col("ev") == 1, F.col("dn"))).over(ahead)
    # first day of the entity: min over the running frame (ascending order) reuses the
    # window spec of the other columns instead of adding an unordered window and sort
    d0 = F.min("dn").over(running)

    def within(h: int) -> Column:
        return F.coalesce((next_ev - F.col("dn") <= h).cast("int"), F.lit(0))

    return base.select(
        "entity_id",
        "date",
        F.when(F.col("s_nationkey") % 2 == 0, "A").otherwise("B").alias("entity_type"),
        (F.year("date") - 1988 + F.col("s_suppkey") % 5).cast("int").alias("entity_age"),
        "use_today",
        F.sum("use_today").over(by_entity.rangeBetween(-6, 0)).cast("bigint").alias("use_last_7d"),
        F.sum("use_today").over(by_entity.rangeBetween(-29, 0)).cast("bigint").alias("use_last_30d"),
        (F.col("dn") - F.coalesce(F.max(F.when(F.col("mt") == 1, F.col("dn"))).over(running), d0))
        .cast("int").alias("days_since_last_maintenance"),
        (F.col("cu") - F.coalesce(F.max(F.when(F.col("mt") == 1, F.col("cu"))).over(running), F.lit(0)))
        .cast("bigint").alias("use_since_last_maintenance"),
        (F.col("dn") - F.coalesce(F.max(F.when(F.col("ev") == 1, F.col("dn"))).over(running), d0))
        .cast("int").alias("days_since_last_event"),
        F.round(season_temp + (fn % 7) - 3, 1).alias("temp"),
        F.element_at(F.array(*[F.lit(c) for c in WEATHER_CODES]), (fn % 7) + 1).cast("int").alias("weather_type"),
        ((fn % 90).cast("double") / 10).alias("wind_speed"),
        (40 + fn % 41).cast("int").alias("humidity"),
        within(7).alias("event_next_7d"),
        within(30).alias("event_next_30d"),
    )


# The same panel in DuckDB SQL, used as the common table of every oracle query.
FIXTURE_PANEL_SQL = """
li AS (
  SELECT l_suppkey AS entity_id, CAST(l_shipdate AS DATE) AS date,
         CAST(SUM(l_quantity) AS BIGINT) AS use_today,
         MAX(CASE WHEN l_returnflag = 'R' AND l_quantity >= 45 THEN 1 ELSE 0 END) AS ev,
         MAX(CASE WHEN l_linestatus = 'F' AND l_quantity <= 5 THEN 1 ELSE 0 END) AS mt,
         COUNT(*) AS n_lines
  FROM lineitem GROUP BY 1, 2
),
fleet AS (SELECT date, CAST(SUM(n_lines) AS INTEGER) AS fn FROM li GROUP BY date),
pbase AS (
  SELECT li.*, s.s_suppkey, s.s_nationkey, f.fn,
         CAST(li.date - DATE '1970-01-01' AS INTEGER) AS dn
  FROM li JOIN supplier s ON li.entity_id = s.s_suppkey JOIN fleet f ON li.date = f.date
),
pcum AS (
  SELECT *, SUM(use_today) OVER (PARTITION BY entity_id ORDER BY dn
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cu
  FROM pbase
),
panel AS (
  SELECT entity_id, date,
    CASE WHEN s_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS entity_type,
    CAST(year(date) - 1988 + s_suppkey % 5 AS INTEGER) AS entity_age,
    use_today,
    CAST(SUM(use_today) OVER (PARTITION BY entity_id ORDER BY dn RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS use_last_7d,
    CAST(SUM(use_today) OVER (PARTITION BY entity_id ORDER BY dn RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS use_last_30d,
    CAST(dn - COALESCE(MAX(CASE WHEN mt = 1 THEN dn END) OVER (PARTITION BY entity_id ORDER BY dn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                       MIN(dn) OVER (PARTITION BY entity_id)) AS INTEGER) AS days_since_last_maintenance,
    CAST(cu - COALESCE(MAX(CASE WHEN mt = 1 THEN cu END) OVER (PARTITION BY entity_id ORDER BY dn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS use_since_last_maintenance,
    CAST(dn - COALESCE(MAX(CASE WHEN ev = 1 THEN dn END) OVER (PARTITION BY entity_id ORDER BY dn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                       MIN(dn) OVER (PARTITION BY entity_id)) AS INTEGER) AS days_since_last_event,
    ROUND(ROUND(12 - 16 * COS(2 * PI() * (dayofyear(date) - 20) / 365.25), 1) + (fn % 7) - 3, 1) AS temp,
    CAST([0, 1, 3, 51, 61, 63, 71][fn % 7 + 1] AS INTEGER) AS weather_type,
    CAST(fn % 90 AS DOUBLE) / 10 AS wind_speed,
    CAST(40 + fn % 41 AS INTEGER) AS humidity,
    CASE WHEN MIN(CASE WHEN ev = 1 THEN dn END) OVER (PARTITION BY entity_id ORDER BY dn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - dn <= 7 THEN 1 ELSE 0 END AS event_next_7d,
    CASE WHEN MIN(CASE WHEN ev = 1 THEN dn END) OVER (PARTITION BY entity_id ORDER BY dn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - dn <= 30 THEN 1 ELSE 0 END AS event_next_30d
  FROM pcum
)"""


def with_panel(sql: str) -> str:
    """Prefix an oracle query (which reads ``panel``) with the panel CTEs.

    ``sql`` may start with its own ``WITH`` list; it is merged.
    """
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return "WITH " + FIXTURE_PANEL_SQL + ",\n" + body[4:].lstrip()
    return "WITH " + FIXTURE_PANEL_SQL + "\n" + body
