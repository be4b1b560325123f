"""Exact quantiles without gathering a column into one task.

``percentile``/``median`` merge a value -> count map of every distinct value
in a single task.  Here the k-th smallest value is found by narrowing:
count the values per range bucket (a distributed aggregate; at most
``n_buckets`` rows come back), keep the bucket that holds rank k, repeat on
that bucket until it holds at most ``final_rows`` values, then sort just
those.  Each pass cuts the candidate set by up to ``n_buckets``; skewed
values need at most a few more passes.  Interpolation follows the usual
linear rule (pos = q (n - 1)), the same as Spark's ``percentile`` and
DuckDB's ``quantile_cont``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_BUCKETS = 4096
FINAL_ROWS = 100_000


def kth_smallest(values: DataFrame, k: int, n_buckets: int = N_BUCKETS,
                 final_rows: int = FINAL_ROWS) -> float:
    """0-based k-th smallest of the single double column ``v``."""
    cur = values
    offset = 0
    lo, hi, n = cur.agg(F.min("v"), F.max("v"), F.count("v")).first()
    for _ in range(64):
        if n <= final_rows or lo == hi:
            if lo == hi:
                return float(lo)
            row = cur.orderBy("v").offset(k - offset).limit(1).first()
            return float(row["v"])
        width = (hi - lo) / n_buckets
        b = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(n_buckets - 1)).cast("int")
        tagged = cur.withColumn("__b", b)
        stats = (tagged.groupBy("__b").agg(F.count("v").alias("n"), F.min("v").alias("lo"),
                                           F.max("v").alias("hi"))
                       .orderBy("__b").collect())            # <= n_buckets rows
        cum = offset
        for s in stats:
            if k < cum + s["n"]:
                cur = tagged.filter(F.col("__b") == s["__b"]).drop("__b")
                offset, lo, hi, n = cum, s["lo"], s["hi"], s["n"]
                break
            cum += s["n"]
    raise RuntimeError("quantile search did not converge")


def exact_quantiles(df: DataFrame, column: str, qs: Sequence[float]) -> list:
    """Exact linear-interpolated quantiles of ``column`` (nulls ignored);
    None for an empty column."""
    from basketry.session import stage
    # the upstream plan runs once; the narrowing passes scan one column
    values = stage(df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull()))
    n = values.count()
    if n == 0:
        return [None for _ in qs]
    out = []
    cache: dict[int, float] = {}

    def kth(k):
        if k not in cache:
            cache[k] = kth_smallest(values, k)
        return cache[k]

    for q in qs:
        pos = q * (n - 1)
        lo_i, hi_i = math.floor(pos), math.ceil(pos)
        lo_v = kth(lo_i)
        hi_v = lo_v if hi_i == lo_i else kth(hi_i)
        out.append(lo_v + (pos - lo_i) * (hi_v - lo_v))
    return out


def exact_median(df: DataFrame, column: str):
    return exact_quantiles(df, column, [0.5])[0]


def grouped_quantiles(df: DataFrame, group: str, column: str, qs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(group, names...): exact linear-interpolated quantiles of ``column``
    per group, all groups in one sample sort (``ordinal.range_ordinal``): a
    group is spread over ranges whatever its size.  Nulls are ignored."""
    from basketry.functions.ordinal import range_ordinal
    v = df.select(group, F.col(column).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    ranked = range_ordinal(v, [group, "__v"], "__at")
    n = ranked.groupBy(group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    at = F.col("__at") - F.col("__first")
    pos = [F.lit(float(q)) * (F.col("__n") - 1) for q in qs]
    placed = ranked.join(n, group)
    wanted = None
    for p in pos:
        here = (at == F.floor(p)) | (at == F.ceil(p))
        wanted = here if wanted is None else wanted | here
    picks = placed.filter(wanted).groupBy(group).agg(*[
        e for p, name in zip(pos, names) for e in (
            F.max(F.when(at == F.floor(p), F.col("__v"))).alias(f"__lo_{name}"),
            F.max(F.when(at == F.ceil(p), F.col("__v"))).alias(f"__hi_{name}"),
            F.max(p - F.floor(p)).alias(f"__f_{name}"))])
    return picks.select(group, *[(F.col(f"__lo_{m}") + F.col(f"__f_{m}") * (F.col(f"__hi_{m}") - F.col(f"__lo_{m}"))).alias(m)
                                 for m in names])
