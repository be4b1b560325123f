"""Customer segments: KMeans with restarts (M5, M6), cluster profiles
(A23, A24), rule ladders (X17, X18), centroids (M7, F7), 2-D projection
(M8, re-aimed from UMAP to PCA), extremes (W15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import checkpoint_dir

# Segment names of the two rule ladders, in ladder order.
CHURN_SEGMENTS = ["New & High-Risk", "Loyal Veterans", "Premium At-Risk",
                  "Budget Customers", "Senior Segment", "Mid-Tier"]
RFM_SEGMENTS = ["VIP / Champions", "At-Risk (were active)", "One-Timers",
                "Loyal Regulars", "Big Spenders", "Casual Shoppers"]

CHURN_SEGMENT_FEATURES = ["tenure", "MonthlyCharges", "TotalCharges", "debt_flag"]
RFM_FEATURES = ["Recency", "Frequency", "Monetary"]


def _r(c, d=6):
    return F.round(c, d) + F.lit(0.0)


def scaled_vectors(df: DataFrame, columns: Sequence[str], out: str = "scaled") -> DataFrame:
    """Standard scaling with the population std (as the reference's scaler),
    built from one aggregate; the result is an ML vector column."""
    from basketry.operators.stats import column_stats
    st = column_stats(df, columns)
    exprs = []
    for c in columns:
        mean, std = F.lit(st[c][0]), F.lit(st[c][1])
        exprs.append(F.when(std == 0, F.lit(0.0)).otherwise((F.col(c) - mean) / std).alias(f"__z_{c}"))
    z = df.select("*", *exprs)
    asm = VectorAssembler(inputCols=[f"__z_{c}" for c in columns], outputCol=out)
    return asm.transform(z).drop(*[f"__z_{c}" for c in columns])


def kmeans_best_of(df: DataFrame, k: int = 4, restarts: int = 10, seed: int = 42,
                   features: str = "scaled", max_iter: int = 300):
    """M5/M6: ``restarts`` KMeans fits (k-means|| init, different seeds);
    keep the lowest training cost.  Each fit is a distributed job; the loop
    is over a fixed number of restarts, not over data.  The vectors are
    checkpointed, so that the many small tasks carry (and report the metrics
    of) a scan and not the plan that made the vectors."""
    best = None
    checkpoint_dir(df.sparkSession)
    kept = df.select(features).persist()  # a checkpoint reads its rows twice
    data = kept.checkpoint().persist()
    kept.unpersist()
    try:
        for r in range(restarts):
            m = KMeans(k=k, seed=seed + r, featuresCol=features, maxIter=max_iter,
                       initMode="k-means||").fit(data)
            if best is None or m.summary.trainingCost < best.summary.trainingCost:
                best = m
    finally:
        data.unpersist()
    return best


def assign_clusters(model, df: DataFrame, features: str = "scaled") -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", "cluster")


def centroids(model, columns: Sequence[str]) -> list:
    return [list(map(float, c)) for c in model.clusterCenters()]


def member_means(assigned: DataFrame, columns: Sequence[str], features: str = "scaled") -> DataFrame:
    """M7 (oracle form): centroid = mean of the members' scaled features."""
    arr = vector_to_array(F.col(features))
    return (assigned.groupBy("cluster")
                    .agg(*[_r(F.avg(arr[i])).alias(c) for i, c in enumerate(columns)]))


def churn_profile(assigned: DataFrame) -> DataFrame:
    """A23 + X17: size, churn rate, means, senior (debt) share per cluster,
    and the ordered rule ladder."""
    p = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.avg("Churn").alias("churn_rate"),
        F.avg("tenure").alias("avg_tenure"), F.avg("MonthlyCharges").alias("avg_monthly"),
        F.avg("TotalCharges").alias("avg_total"), F.avg("debt_flag").alias("senior_pct"))
    t, m, c, s = F.col("avg_tenure"), F.col("avg_monthly"), F.col("churn_rate"), F.col("senior_pct")
    label = (F.when((t < 20) & (c > 0.3), CHURN_SEGMENTS[0])
              .when((t > 40) & (c < 0.15), CHURN_SEGMENTS[1])
              .when((m > 70) & (c > 0.25), CHURN_SEGMENTS[2])
              .when(m < 40, CHURN_SEGMENTS[3])
              .when(s > 0.3, CHURN_SEGMENTS[4])
              .otherwise(CHURN_SEGMENTS[5]))
    return p.select("cluster", "size", *[_r(F.col(x)).alias(x) for x in
                                         ["churn_rate", "avg_tenure", "avg_monthly", "avg_total", "senior_pct"]],
                    label.alias("label"))


def rfm_profile(assigned: DataFrame) -> DataFrame:
    """A24 + X18: size and mean R/F/M per cluster; the ladder compares them
    with the global medians (exact, scalar subqueries)."""
    from basketry.functions.quantile import exact_median
    med = {c: F.lit(exact_median(assigned, c)) for c in RFM_FEATURES}
    p = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.avg("Recency").alias("recency"),
        F.avg("Frequency").alias("frequency"), F.avg("Monetary").alias("monetary"))
    r, f, m = F.col("recency"), F.col("frequency"), F.col("monetary")
    label = (F.when((f > med["Frequency"] * 2) & (m > med["Monetary"] * 2), RFM_SEGMENTS[0])
              .when((r > med["Recency"] * 1.5) & (f > med["Frequency"]), RFM_SEGMENTS[1])
              .when((f <= 2) & (m < med["Monetary"]), RFM_SEGMENTS[2])
              .when((r < med["Recency"]) & (f > med["Frequency"]), RFM_SEGMENTS[3])
              .when(m > med["Monetary"], RFM_SEGMENTS[4])
              .otherwise(RFM_SEGMENTS[5]))
    return p.select("cluster", "size", _r(r).alias("recency"), _r(f).alias("frequency"),
                    _r(m).alias("monetary"), label.alias("label"))


def churn_extremes(profile: DataFrame) -> DataFrame:
    """Highest and lowest churn cluster; the first cluster wins ties."""
    return profile.agg(
        F.min_by("cluster", F.struct(-F.col("churn_rate"), F.col("cluster"))).alias("highest_churn_cluster"),
        F.min_by("cluster", F.struct(F.col("churn_rate"), F.col("cluster"))).alias("lowest_churn_cluster"))


def rfm_extremes(profile: DataFrame) -> DataFrame:
    """Most valuable (monetary) and most dormant (recency) segment."""
    return profile.agg(
        F.min_by("cluster", F.struct(-F.col("monetary"), F.col("cluster"))).alias("most_valuable_cluster"),
        F.min_by("cluster", F.struct(-F.col("recency"), F.col("cluster"))).alias("highest_risk_cluster"))


def projection_2d(df: DataFrame, features: str = "scaled") -> DataFrame:
    """M8 (re-aimed): 2-D PCA projection for plotting; distributed fit."""
    model = PCA(k=2, inputCol=features, outputCol="__p").fit(df)
    arr = vector_to_array(F.col("__p"))
    return model.transform(df).withColumn("dim1", arr[0]).withColumn("dim2", arr[1]).drop("__p")
