"""Live churn model (T1-T3, T6): an incrementally updated logistic model.

Re-aimed from per-sample SGD: each micro-batch takes ``steps`` damped
Newton steps of L2-regularised log loss (alpha 1e-4) starting from the
current weights; gradient and Hessian are one Spark aggregate over the
batch (the weights, a vector of feature-count length, travel as literals).  After each batch the model is scored on the fixed
hold-out (accuracy, F1, log loss) and both the weights and the metrics are
written to their ``batch_id`` partition.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import evaluate, features, stats
from basketry.operators.clean import CATEGORICAL_COLS, ID_COL, LABEL_COL, NUMERIC_COLS
from basketry.session import scratch_path
from basketry.streaming.common import read_or_empty, run_file_stream, write_partition
from basketry.streaming.deltas import DeltaLog, in_order, stage_ordered

FEATURES = CATEGORICAL_COLS + NUMERIC_COLS


def _cut(df: DataFrame) -> DataFrame:
    from basketry.session import stage
    return stage(df, "churn-prep")


def _margin(w, b):
    m = F.lit(float(b))
    for c, wi in zip(FEATURES, w):
        m = m + F.lit(float(wi)) * F.col(c)
    return m


def _prob(w, b):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_margin(w, b)))


def newton_steps(batch: DataFrame, w, b, steps: int, alpha: float, damping: float = 1.0):
    """Damped Newton (IRLS) steps of L2-regularised log loss on one batch.
    Each step is ONE Spark aggregate returning the gradient and the upper
    triangle of the Hessian (d + d(d+1)/2 numbers for d features + bias);
    the d x d solve happens on the driver."""
    names = FEATURES + ["__one"]
    d = len(names)
    x = [F.col(c) for c in FEATURES] + [F.lit(1.0)]
    for _ in range(steps):
        p = _prob(w, b)
        err = p - F.col(LABEL_COL)
        wt = p * (F.lit(1.0) - p)
        aggs = [F.sum(err * x[i]).alias(f"g{i}") for i in range(d)]
        aggs += [F.sum(wt * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]
        row = batch.agg(*aggs, F.count(F.lit(1)).alias("__n")).first()
        n = max(row["__n"], 1)
        theta = np.array(list(w) + [b], dtype=float)
        reg = np.full(d, alpha * n)
        reg[-1] = 0.0                      # no penalty on the intercept
        g = np.array([row[f"g{i}"] or 0.0 for i in range(d)]) + reg * theta
        h = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                h[i, j] = h[j, i] = row[f"h{i}_{j}"] or 0.0
        h += np.diag(reg) + np.eye(d) * 1e-9 * n
        theta = theta - damping * np.linalg.solve(h, g)
        w, b = [float(v) for v in theta[:-1]], float(theta[-1])
    return w, b


def prepare(customers: DataFrame, n_batches: int = 15):
    """Encode (F1), split (F3), scale with train statistics (F4) and cut the
    training rows into ordered mini-batches (W14).  Returns (train, test)."""
    enc = features.label_encode(customers, features.label_mapping(customers))
    sp = _cut(features.stratified_split(enc))   # stage boundary: short plans below
    train_raw = sp.filter(F.col("split") == "train")
    scaled = _cut(stats.standardize(sp, FEATURES, fit_on=train_raw, keep=[ID_COL, LABEL_COL, "split"]))
    train = features.minibatches(scaled.filter(F.col("split") == "train"), n_batches=n_batches)
    test = scaled.filter(F.col("split") == "test")
    return train, test


def run(spark: SparkSession, customers: DataFrame, n_batches: int = 15, initial_steps: int = 6,
        steps: int = 1, alpha: float = 1e-4, stream_damping: float = 0.2,
        out: str | None = None) -> str:
    """Stream the training batches and maintain the model.  Returns the
    output folder holding ``weights/``, ``metrics/`` and ``confusion/``."""
    out = out or scratch_path(spark, "churn-live")
    train, test = prepare(customers, n_batches)
    keys = [ID_COL, LABEL_COL, *FEATURES]
    train = train.select(*keys, F.lit(1).cast("bigint").alias("n"), "batch_id")
    test = _cut(test.select(*keys))
    src = f"{out}/source"
    stage_ordered(train, src)
    schema = spark.read.parquet(src).schema
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name in [*keys, "n"])
    log = DeltaLog(spark, out, columns, keys, "n")

    def done() -> int:
        last = read_or_empty(spark, f"{out}/confusion", "batch_id int").agg(F.max("batch_id")).first()[0]
        return -1 if last is None else last  # the confusion table is a step's last write

    def step(bid: int) -> None:
        prev = read_or_empty(spark, f"{out}/weights", "w array<double>, b double, batch_id int") \
            .filter(F.col("batch_id") == bid - 1).first()
        w, b = (list(prev["w"]), prev["b"]) if prev else ([0.0] * len(FEATURES), 0.0)
        rows = _cut(log.batch(bid, bid).select(*keys))
        # full steps on the large initial batch, damped steps on the small
        # streamed batches so one batch of a few dozen rows cannot swing the model
        w, b = newton_steps(rows, w, b, initial_steps if bid == 0 else steps, alpha,
                            damping=1.0 if bid == 0 else stream_damping)
        write_partition(spark.createDataFrame([(w, float(b))], "w array<double>, b double"),
                        f"{out}/weights", bid)
        p = _prob(w, b)
        scored = test.select(F.col(LABEL_COL).alias("label"), p.alias("score"),
                             F.when(p >= 0.5, 1).otherwise(0).alias("prediction"))
        m = evaluate.classification_metrics(scored).select("accuracy", "f1")
        ll = evaluate.log_loss(scored).select("log_loss")
        n_rows = rows.count()
        row = m.select("*", ll.select("log_loss").scalar().alias("log_loss"),
                       F.lit(n_rows).cast("bigint").alias("batch_rows"))
        write_partition(row, f"{out}/metrics", bid)
        write_partition(evaluate.confusion(scored), f"{out}/confusion", bid)

    run_file_stream(spark, src, schema, in_order(log, done, step, compact=False), f"{out}/_checkpoint",
                    files=spark.sparkContext.defaultParallelism)
    missing = log.waiting(done())
    if missing:
        raise RuntimeError(f"batches {missing} came without all of batch {done() + 1}")
    return out


def metrics_history(spark: SparkSession, out: str) -> DataFrame:
    """T2 + T6: one row per batch with metrics and samples processed."""
    from pyspark.sql import Window
    m = spark.read.parquet(f"{out}/metrics")
    return m.withColumn("samples_processed",
                        F.sum("batch_rows").over(Window.orderBy("batch_id"))) \
            .select("batch_id", "accuracy", "f1", "log_loss", "batch_rows", "samples_processed")


def confusion_before_after(spark: SparkSession, out: str) -> DataFrame:
    """Confusion counts of the first and the last model version."""
    c = spark.read.parquet(f"{out}/confusion")
    lo = c.select(F.min("batch_id")).scalar()
    hi = c.select(F.max("batch_id")).scalar()
    return (c.filter((F.col("batch_id") == lo) | (F.col("batch_id") == hi))
             .withColumn("model", F.when(F.col("batch_id") == lo, "before").otherwise("after")))


