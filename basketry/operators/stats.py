"""Descriptive statistics over the customer table.

Global one-row values (min, max, mean, std, medians) are scalar subqueries:
computed once by a distributed aggregate, inlined as literals, never joined.
Multi-column statistics use ``unpivot`` so one aggregate pass serves every
column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.exprs import churn_label


def _r(c, d=6):
    # "+ 0.0" turns a rounded -0.0 into 0.0
    return F.round(c, d) + F.lit(0.0)


def churn_kpis(customers: DataFrame, reduction_pct: float = 10.0) -> DataFrame:
    """A1 + X19: customers, churn rate, churned, average monthly charge,
    annual revenue at risk, savings at ``reduction_pct`` and the flat
    65 x 12 per-churner cost."""
    y = F.col("Churn")
    k = customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        _r(F.avg(y)).alias("churn_rate"),
        F.sum(y).cast("bigint").alias("churned"),
        _r(F.avg("MonthlyCharges")).alias("avg_monthly"),
        F.sum(F.when(y == 1, F.col("MonthlyCharges"))).alias("__risk"))
    return k.select("total_customers", "churn_rate", "churned", "avg_monthly",
                    _r(F.col("__risk") * 12).alias("revenue_at_risk"),
                    _r(F.col("__risk") * 12 * (reduction_pct / 100.0)).alias("savings"),
                    (F.col("churned") * 65 * 12).alias("flat_churn_cost"))


def churn_distribution(customers: DataFrame) -> DataFrame:
    """A3 + X4: count and share per churn code, with display label."""
    total = customers.select(F.count(F.lit(1))).scalar()
    return (customers.groupBy("Churn").agg(F.count(F.lit(1)).alias("Count"))
                     .select("Churn", churn_label("Churn").alias("Label"), "Count",
                             _r(F.col("Count") / total).alias("share")))


def churn_rate_by(customers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A4: churn rate x 100, rounded to 1, for every value of every listed
    categorical, in one pass (unpivot then one aggregate)."""
    long = customers.select("Churn", *[F.col(c).cast("string").alias(c) for c in columns]) \
                    .unpivot("Churn", list(columns), "feature", "value")
    return (long.groupBy("feature", "value")
                .agg(F.round(F.avg("Churn") * 100, 1).alias("churn_rate_pct")))


def histogram(df: DataFrame, column: str, bins: int, by: str | None = None) -> DataFrame:
    """Fixed-width histogram over [min, max] with ``bins`` bins (the
    max falls in the last bin); optional split column."""
    v = F.col(column).cast("double")
    lo_v, hi_v = df.agg(F.min(v), F.max(v)).first()   # one aggregate, two literals
    lo, hi = F.lit(lo_v).cast("double"), F.lit(hi_v).cast("double")
    width = (hi - lo) / F.lit(bins)
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((v - lo) / width), F.lit(bins - 1))).cast("int")
    keys = [b.alias("bin")] + ([F.col(by)] if by else [])
    return (df.filter(v.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
              .withColumn("bin_start", _r(lo + F.col("bin") * width))
              .withColumn("bin_end", _r(lo + (F.col("bin") + 1) * width)))


def standardize(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None,
                keep: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / population std, statistics from ``fit_on``
    (default: ``df`` itself).  A zero std leaves the centred value."""
    src = fit_on if fit_on is not None else df
    st = column_stats(src, columns)
    out = []
    for c in columns:
        mean, std = F.lit(st[c][0]), F.lit(st[c][1])
        out.append(F.when(std == 0, F.col(c) - mean)
                    .otherwise((F.col(c) - mean) / std).alias(c))
    return df.select(*keep, *out)


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict:
    """Mean and population std of each column from ONE distributed
    aggregate; the result (2 numbers per column) comes back as literals.
    One aggregate instead of a scalar subquery per statistic keeps the plan
    from embedding the upstream plan 2k times."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(columns)}


def scaling_histograms(customers: DataFrame, column: str = "TotalCharges", bins: int = 40) -> DataFrame:
    """Histogram of a column before and after standard scaling."""
    scaled = standardize(customers, [column])
    raw = histogram(customers, column, bins).withColumn("stage", F.lit("raw"))
    sc = histogram(scaled, column, bins).withColumn("stage", F.lit("scaled"))
    return raw.unionByName(sc)


def correlation(customers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation for every ordered pair, one aggregate."""
    pairs = [(a, b) for a in columns for b in columns]
    row = customers.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}")
                          for a, b in pairs])
    long = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    return long.select(F.split("pair", r"\|").getItem(0).alias("col_a"),
                       F.split("pair", r"\|").getItem(1).alias("col_b"),
                       _r(F.col("corr")).alias("corr"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, sample std, min, max per column, rounded to 2."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]) \
             .unpivot([], list(columns), "feature", "value")
    return long.groupBy("feature").agg(
        _r(F.avg("value"), 2).alias("mean"), _r(F.stddev_samp("value"), 2).alias("std"),
        _r(F.min("value"), 2).alias("min"), _r(F.max("value"), 2).alias("max"))


def mean_std(df: DataFrame, column: str) -> DataFrame:
    """Mean and population std of one column."""
    return df.agg(_r(F.avg(column)).alias("mean"), _r(F.stddev_pop(column)).alias("std"))


def split_summary(split: DataFrame) -> DataFrame:
    """Rows and churn rate per side of the split."""
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"),
                                      _r(F.avg("Churn")).alias("churn_rate"))


def category_inventory(customers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per categorical and the sorted class list.
    The per-feature set is bounded by the feature's cardinality."""
    long = customers.select(*[F.col(c).cast("string").alias(c) for c in columns]) \
                    .unpivot([], list(columns), "feature", "value")
    return (long.groupBy("feature")
                .agg(F.countDistinct("value").alias("unique_values"),
                     F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("classes")))
