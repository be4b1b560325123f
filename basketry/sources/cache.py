"""Memoised models and result tables (S4-S6), keyed by data version and
parameters -- unlike a cache keyed by parameters alone, a model can never
outlive the data it was fitted on.

The data version of a parquet input is its file listing with sizes and
modification times (read through the Hadoop FileSystem of the session, so
it works for any shared storage).  Artefacts live under
``<spark.checkpoint.dir>/memo/<application id>/<key>``.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import SparkSession

from basketry.session import checkpoint_dir, write_table


def data_version(spark: SparkSession, paths: list[str]) -> str:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for p in sorted(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            parts.append(f"{p}:missing")
            continue
        for st in fs.listStatus(path):
            parts.append(f"{st.getPath().toString()}:{st.getLen()}:{st.getModificationTime()}")
    return hashlib.sha1("|".join(parts).encode()).hexdigest()


def memo_key(spark: SparkSession, name: str, inputs: list[str], params: dict) -> str:
    payload = json.dumps({"name": name, "data": data_version(spark, inputs), "params": params},
                         sort_keys=True, default=str)
    return f"{name}-{hashlib.sha1(payload.encode()).hexdigest()[:16]}"


def memo_path(spark: SparkSession, key: str) -> str:
    """Memo entries live per Spark application (like a per-process cache):
    queries of one application hand tables to each other, a new application
    recomputes.  Set ``basketry.memo.shared=true`` to share across
    applications (the key already carries the data version)."""
    shared = spark.conf.get("basketry.memo.shared", "false").lower() == "true"
    scope = "shared" if shared else spark.sparkContext.applicationId
    return f"{checkpoint_dir(spark).rstrip('/')}/memo/{scope}/{key}"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached_model(spark: SparkSession, name: str, inputs: list[str], params: dict, fit):
    """Load the fitted PipelineModel for (data, params) or fit and save it."""
    from pyspark.ml import PipelineModel
    path = memo_path(spark, memo_key(spark, name, inputs, params))
    if exists(spark, f"{path}/_SUCCESS_MODEL"):
        return PipelineModel.load(path)
    model = fit()
    model.write().overwrite().save(path)
    spark.createDataFrame([(1,)], "ok int").coalesce(1).write.mode("overwrite").parquet(f"{path}/_SUCCESS_MODEL")
    return model


def cached_table(spark: SparkSession, name: str, inputs: list[str], params: dict, build):
    """A result table written once per (data, params) and read back by
    every later query that needs it (parquet in the shared folder)."""
    path = memo_path(spark, memo_key(spark, name, inputs, params))
    if not exists(spark, f"{path}/_SUCCESS"):
        write_table(build(), path)
    return spark.read.parquet(path)
