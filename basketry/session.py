"""Session helpers: configuration defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults that matter for correctness and for the scale we target. The
# shuffle partition count is only a starting point: AQE coalesces small
# partitions and splits skewed ones at runtime.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # local mode runs everything in the driver JVM; on a cluster the
    # deployment sets executor memory instead
    "spark.driver.memory": "16g",
}

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, app: str = "basketry",
              shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Return (or create) a session with the library defaults applied."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and points at shared storage.
    Only when it is unset (local tests) do we create a private folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            # a machine-local folder is invisible to other executors and is
            # lost with its machine: on a cluster the setting must be given
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or object storage)")
        path = tempfile.mkdtemp(prefix="basketry-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        # Spark refuses to change spark.checkpoint.dir in a running session;
        # the context's own folder carries the choice to later calls
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for a written stage table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df, name: str = "stage"):
    """Materialise a DataFrame that several later steps read: a parquet
    table written once into the shared checkpoint folder and read back.
    It cuts the lineage, survives executor loss, and -- unlike
    ``Dataset.checkpoint`` on an unpersisted plan, which evaluates the plan a
    second time to fill the checkpoint -- computes the plan exactly once."""
    path = scratch_path(df.sparkSession, name)
    write_table(df, path)
    out = df.sparkSession.read.parquet(path)
    out.stage_path = path
    return out


def spread(df, rows: int):
    """``df`` dealt out evenly, about ``rows`` rows to a task.  A compact
    table may be a single scan task however many rows it holds; steps that
    work long on a row need more.  Counts the rows first, so ``df`` should be
    a scan or a light plan.  What fits one task is left as it is."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > 1 else df


def write_table(df, path: str) -> None:
    """Write a parquet table; the shuffle files of the job are removed once it
    is there (otherwise they stay until the driver collects its garbage)."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(CLEANUP, before)


def release(*tables) -> None:
    """Delete stage tables (as ``stage`` returned them) that nothing reads any
    more, such as an earlier round's state."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.stage_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
