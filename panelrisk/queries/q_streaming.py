"""Streaming re-aims: incremental history features and windowed weekly counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.operators import splits
from panelrisk.queries import register
from panelrisk.queries.common import typed
from panelrisk.queries.q_metrics import SCORE_A_SQL, score_a
from panelrisk.queries.q_splits import SPLIT_SQL
from panelrisk.queries.sql_features import FEATURES_SQL
from panelrisk.sources.csv import scratch_path
from panelrisk.sources.fixture import fixture_panel
from panelrisk.spec import FIXTURE_SPEC as S
from panelrisk.streaming.counts import weekly_counts_stream
from panelrisk.streaming.score import stream_features

OUT = [("entity_id", "l"), ("date", "t"), ("event", "i"), ("use_roll30_std", "d"), ("events_last_90", "d"),
       ("past_event_rate", "d"), ("score", "d")]


FILE_ROWS = 1 << 19  # rows of an arriving file, about


def write_months(new, folder: str) -> int:
    """Write the rows of ``new`` month by month, in order; how many files a month has.

    An entity's rows of a month share a file, and files of later months come later,
    so a trigger of that many files takes a month at a time, however ``new`` is split.
    """
    spark = new.sparkSession
    by_month = scratch_path(spark, "months")
    new.withColumn("_month", F.trunc("date", "month")).write.partitionBy("_month").parquet(by_month)
    rows = spark.read.parquet(by_month)
    months = rows.groupBy("_month").count().orderBy("_month").collect()  # one row per month
    files = max([1, *(-(-m["count"] // FILE_ROWS) for m in months)])
    for m in months:
        rows.filter(F.col("_month") == F.lit(m["_month"])).select(*new.columns).repartition(files, "entity_id").write.mode("append").parquet(folder)
    return files


@register("stream_score", f"""WITH {FEATURES_SQL},
{SPLIT_SQL.strip()}
SELECT f2.entity_id, f2.date, CAST(event AS INTEGER) AS event, ROUND(use_roll30_std, 6) + 0.0 AS use_roll30_std,
  ROUND(events_last_90, 6) + 0.0 AS events_last_90,
  ROUND(CASE WHEN past_observations = 0 THEN 0.0 ELSE CAST(past_events AS DOUBLE) / past_observations END, 6) + 0.0 AS past_event_rate,
  ROUND({SCORE_A_SQL.replace('use_today', 'f2.use_today').replace('days_since', 'f2.days_since')}, 6) + 0.0 AS score
FROM f2 JOIN sp USING (entity_id, date) WHERE sp.split = 'test'""")
def q_stream_score(spark, sf):
    """Rows after the calendar cut arrive as monthly files; features and scores must equal the batch table."""
    p = splits.calendar_split(fixture_panel(spark, sf), S)
    cols = ["entity_id", "date", "use_today", "days_since_last_event"]
    history = p.filter("split = 'train'").select(*cols)
    incoming = scratch_path(spark, "incoming")
    new = p.filter("split = 'test'").select(*cols)
    files = write_months(new, incoming)
    score = lambda d: d.withColumn("score", score_a())
    out, _ = stream_features(spark, history, incoming, new.schema, S, scratch_path(spark, "stream"), score, max_files_per_trigger=files)
    return typed(out, OUT)


@register("stream_event_counts", """
SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type, CAST(COUNT(*) AS BIGINT) AS n,
  ROUND(SUM(value), 4) + 0.0 AS value_sum
FROM events GROUP BY 1, 2""", panel=False)
def q_stream_event_counts(spark, sf):
    r = weekly_counts_stream(spark, sf)
    return typed(r, [("week_start", "t"), ("event_type", "s"), ("n", "l"), ("value_sum", "d")], digits=4)
