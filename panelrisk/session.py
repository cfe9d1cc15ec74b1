"""Session helpers: a local session for tests/bench, and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "panelrisk") -> SparkSession:
    """A local session configured like the cluster one: AQE on, UTC, no UI."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local session that names none (as in tests) gets a scratch folder; on a
    cluster the executors would scatter their files over their own disks, so the
    setting is required there.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="panelrisk-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the Arrow batches that tasks exchange with Python, unless the session bounds them itself.

    A batch lives several times over, in the executor's and in its workers' memory.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1b") == "1b":  # not set
        spark.conf.set(key, size)


def bound_methods(spark: SparkSession, size: int = 8000) -> None:
    """Plans whose generated method the JVM would not compile (HotSpot stops at 8,000 bytes) run in smaller ones.

    A session that sets the limit itself keeps it.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":  # not set
        spark.conf.set(key, str(size))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage like a reliable checkpoint (the files survive executor
    loss), and later readers get column pruning and filter pushdown on it.
    """
    import uuid

    spark = df.sparkSession
    bound_batches(spark)
    bound_methods(spark)
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/panelrisk-tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
