"""Windowed event counts from a file stream.

``events.ts`` is a timestamp without zone; ``withWatermark`` needs a
TIMESTAMP, so the wall time is read as UTC explicitly (independent of the
session zone). Seven-day windows are epoch-aligned (Thursday); a 4-day start
offset gives Monday–Sunday weeks. The stream runs in update mode and every
micro-batch appends its updated counts with the batch id; the final count of
a window is the one of its latest batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.sources.csv import scratch_path


def utc_instant(ts_ntz):
    """Wall time without zone → the instant of that wall time in UTC."""
    secs = F.second(ts_ntz).cast("decimal(8,6)") + (F.date_format(ts_ntz, "SSSSSS").cast("int") / 1e6).cast("decimal(8,6)")
    return F.make_timestamp(F.year(ts_ntz), F.month(ts_ntz), F.dayofmonth(ts_ntz), F.hour(ts_ntz),
                            F.minute(ts_ntz), secs, F.lit("UTC"))


def day_of(ts_col) -> object:
    """UTC calendar day of a TIMESTAMP, without the session zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(ts_col) / 86_400_000_000).cast("int"))


def weekly_counts_stream(spark: SparkSession, source_dir: str, file_name: str = "events.parquet",
                         watermark: str = "1 day", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run the stream to completion (``availableNow``) and return the final weekly counts."""
    schema = spark.read.parquet(f"{source_dir.rstrip('/')}/{file_name}").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", file_name).parquet(source_dir)
    ev = src.withColumn("ts_utc", utc_instant(F.col("ts")))
    agg = (ev.withWatermark("ts_utc", watermark)
           .groupBy(F.window("ts_utc", "7 days", "7 days", "4 days").alias("w"), "event_type")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")))
    out = out or scratch_path(spark, "stream-counts")
    ckpt = checkpoint or scratch_path(spark, "stream-counts-ckpt")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.select(day_of(F.col("w.start")).alias("week_start"), "event_type", "n", "value_sum",
                     F.lit(batch_id).alias("batch_id")).write.mode("append").parquet(out)

    q = agg.writeStream.outputMode("update").option("checkpointLocation", ckpt).foreachBatch(sink).trigger(
        availableNow=True).start()
    q.awaitTermination()
    res = spark.read.parquet(out)
    return res.groupBy("week_start", "event_type").agg(
        F.max_by("n", "batch_id").alias("n"), F.max_by("value_sum", "batch_id").alias("value_sum"))
