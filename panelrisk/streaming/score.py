"""Incremental history features for newly arriving panel rows.

New rows arrive as files; each micro-batch (``foreachBatch``) joins the
stored per-entity state — the last 90 rows and running totals — so the
row-window features of the new rows equal the batch computation over the
full history, without re-reading that history. State, output and late rows
are tables keyed by the batch id in fixed folders: a batch that is run again
after a stop starts from the same state and overwrites its own tables, so every
row comes out once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelrisk.operators import windows
from panelrisk.spec import PanelSpec

TAIL = 90
KEEP = 3  # versions of the state that stay
FEATURES = ["event", "use_roll30_std", "events_last_90", "past_event_rate"]


def initial_state(history: DataFrame, spec: PanelSpec):
    """(tail, totals) from already processed rows."""
    w = Window.partitionBy(spec.entity).orderBy(spec.date)
    h = history.select(spec.entity, spec.date, spec.usage_today, spec.counter).withColumn(
        "event", F.coalesce((F.col(spec.counter) < F.lag(spec.counter).over(w)).cast("int"), F.lit(0)))
    return _tail_and_totals(h, None, spec)


def _tail_and_totals(rows: DataFrame, prev_totals: DataFrame | None, spec: PanelSpec):
    r = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(spec.entity).orderBy(F.desc(spec.date))))
    tail = r.filter(F.col("_rn") <= TAIL).drop("_rn")
    tot = rows.groupBy(spec.entity).agg(F.sum("event").alias("events_all"), F.count(F.lit(1)).alias("obs_all"))
    if prev_totals is not None:
        tot = prev_totals.unionByName(tot).groupBy(spec.entity).agg(
            F.sum("events_all").alias("events_all"), F.sum("obs_all").alias("obs_all"))
    return tail, tot


def features_for_batch(batch: DataFrame, tail: DataFrame, totals: DataFrame, spec: PanelSpec) -> DataFrame:
    """History features of ``batch`` rows given the stored state (one exchange on the entity key)."""
    cols = [spec.entity, spec.date, spec.usage_today, spec.counter]
    new = batch.select(*cols).withColumn("_new", F.lit(1)).withColumn("event", F.lit(None).cast("int"))
    old = tail.select(*cols, "event").withColumn("_new", F.lit(0))
    both = old.unionByName(new)
    w = Window.partitionBy(spec.entity).orderBy(spec.date)
    ev = F.coalesce((F.col(spec.counter) < F.lag(spec.counter).over(w)).cast("int"), F.lit(0))
    both = both.withColumn("event", F.when(F.col("_new") == 1, ev).otherwise(F.col("event")))
    both = both.withColumn("use_roll30_std", windows.rolling_std_before(spec.usage_today, spec, 30, 5))
    both = both.withColumn("events_last_90", windows.past_sum("event", spec, 90).cast("double"))
    fresh = both.filter("_new = 1")
    wn = Window.partitionBy(spec.entity).orderBy(spec.date)
    fresh = fresh.withColumn("_k", F.row_number().over(wn) - 1).withColumn(
        "_ev_before", F.coalesce(F.sum("event").over(wn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fresh = fresh.join(totals, spec.entity, "left").fillna(0, ["events_all", "obs_all"])
    obs = F.col("obs_all") + F.col("_k")
    evs = F.col("events_all") + F.col("_ev_before")
    fresh = fresh.withColumn("past_event_rate", F.when(obs == 0, 0.0).otherwise(evs / obs))
    return fresh.select(*cols, *FEATURES)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table is complete."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stream_features(spark: SparkSession, history: DataFrame, incoming_dir: str, schema, spec: PanelSpec, base: str,
                    scorer: Callable[[DataFrame], DataFrame] | None = None, max_files_per_trigger: int = 1,
                    after_batch: Callable[[int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Process every file in ``incoming_dir`` in arrival order; return all rows written and the late ones.

    ``base`` is a folder of the shared file system that outlives the session:
    called again with it after a stop, the stream goes on where it was. Rows not
    newer than the last one of their entity are late: they go to a side table
    and change nothing. ``scorer`` (a stored model's, say) adds columns to the
    new rows. ``after_batch`` is called before a batch is committed.
    """
    state = lambda kind, v: f"{base}/state/{kind}/v={v}"
    ready = _exists(spark, state("tail", -1)) and _exists(spark, state("totals", -1))
    if not ready and not _exists(spark, f"{base}/out/batch=0"):  # behind the first batches, that state is gone
        tail, tot = initial_state(history, spec)
        tail.write.mode("overwrite").parquet(state("tail", -1))
        tot.write.mode("overwrite").parquet(state("totals", -1))

    def process(batch: DataFrame, batch_id: int) -> None:
        # batch b starts from what batch b - 1 left and overwrites its own tables only: repeating it changes nothing
        t = spark.read.parquet(state("tail", batch_id - 1))
        s = spark.read.parquet(state("totals", batch_id - 1))
        last = t.groupBy(spec.entity).agg(F.max(spec.date).alias("_last"))
        marked = batch.join(last, spec.entity, "left").withColumn("_late", F.coalesce(F.col(spec.date) <= F.col("_last"), F.lit(False))).drop("_last")
        marked.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{base}/late/batch={batch_id}")
        feats = features_for_batch(marked.filter("NOT _late"), t, s, spec)
        (scorer(feats) if scorer else feats).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
        feats = spark.read.parquet(f"{base}/out/batch={batch_id}")
        rows = t.unionByName(feats.select(spec.entity, spec.date, spec.usage_today, spec.counter, "event"))
        new_tail, _ = _tail_and_totals(rows, None, spec)
        add = feats.groupBy(spec.entity).agg(F.sum("event").alias("events_all"), F.count(F.lit(1)).alias("obs_all"))
        new_tot = s.unionByName(add).groupBy(spec.entity).agg(F.sum("events_all").alias("events_all"),
                                                              F.sum("obs_all").alias("obs_all"))
        new_tail.write.mode("overwrite").parquet(state("tail", batch_id))
        new_tot.write.mode("overwrite").parquet(state("totals", batch_id))
        if batch_id >= KEEP - 1:  # a restart asks for the state before the last batch at most
            for kind in ("tail", "totals"):
                _drop(spark, state(kind, batch_id - KEEP))
        if after_batch:
            after_batch(batch_id)

    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(incoming_dir)
    q = src.writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(process) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch"), spark.read.parquet(f"{base}/late").drop("batch")
