"""Additive per-feature attributions and their read-outs.

E9 for the linear model (the boosted trees are in ``treeshap``) is exact:
contribution_f = w_f * (x_f - mean_f), written as column expressions over
the whole table; base value = intercept + sum_f w_f * mean_f, so
base + sum(contributions) = margin for every row.  Read-outs work on the
long table (id, feature, value, contribution).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _r(c, d=6):
    return F.round(c, d) + F.lit(0.0)


def linear_contributions(df: DataFrame, id_col: str, columns: Sequence[str],
                         weights: Sequence[float], intercept: float,
                         means: DataFrame | None = None) -> DataFrame:
    """Long table (id, feature, value, contribution, base, margin).
    ``means`` defaults to the column means of ``df`` (scalar subqueries)."""
    src = means if means is not None else df
    row = src.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(columns)]).first()
    mean_vals = {c: F.lit(row[f"m_{i}"]) for i, c in enumerate(columns)}
    base = F.lit(float(intercept))
    for c, w in zip(columns, weights):
        base = base + F.lit(float(w)) * mean_vals[c]
    margin = F.lit(float(intercept))
    for c, w in zip(columns, weights):
        margin = margin + F.lit(float(w)) * F.col(c).cast("double")
    structs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                        (F.lit(float(w)) * (F.col(c).cast("double") - mean_vals[c])).alias("contribution"))
               for c, w in zip(columns, weights)]
    return (df.select(id_col, base.alias("base"), margin.alias("margin"), F.explode(F.array(*structs)).alias("__s"))
              .select(id_col, "__s.feature", "__s.value", "__s.contribution", "base", "margin"))


def global_importance(contrib: DataFrame, top: int = 15) -> DataFrame:
    """Mean absolute contribution per feature, the ``top`` largest."""
    return (contrib.groupBy("feature").agg(_r(F.avg(F.abs("contribution"))).alias("mean_abs"))
                   .orderBy(F.desc("mean_abs"), "feature").limit(top))


def contribution_spread(contrib: DataFrame, top: int = 15) -> DataFrame:
    """Per feature (top by mean |contribution|): exact quartiles of the
    contribution and mean feature value (the beeswarm in numbers)."""
    from basketry.functions.quantile import grouped_quantiles
    sub = contrib.join(global_importance(contrib, top).select("feature"), "feature", "left_semi")
    q = grouped_quantiles(sub, "feature", "contribution", [0.25, 0.5, 0.75], ["p25", "median", "p75"])
    other = sub.groupBy("feature").agg(_r(F.min("contribution")).alias("min"), _r(F.max("contribution")).alias("max"),
                                       _r(F.avg("value")).alias("mean_value"))
    return q.select("feature", *[_r(F.col(c)).alias(c) for c in ["p25", "median", "p75"]]).join(other, "feature")


def waterfall(contrib: DataFrame, id_col: str, top: int = 12) -> DataFrame:
    """For the rows of one id (filter first), the ``top`` features by
    |contribution| and one remainder row with the rest summed.  One pass:
    ``contrib`` may be costly to make."""
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs("contribution")), "feature")
    ranked = contrib.withColumn("rank", F.row_number().over(w).cast("bigint"))
    shown = ranked.select(id_col, F.when(F.col("rank") > top, "other features").otherwise(F.col("feature")).alias("feature"),
                          "contribution", F.least("rank", F.lit(top + 1).cast("bigint")).alias("rank"))
    return (shown.groupBy(id_col, "feature", "rank").agg(_r(F.sum("contribution")).alias("contribution"))
                 .select(id_col, "feature", "contribution", "rank"))
