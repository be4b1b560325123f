"""Exact ranks and running totals that never put a whole group in one task.

A plain ``row_number() OVER (PARTITION BY g ORDER BY k)`` sends every row of
group ``g`` to one task; with one key holding a third of the rows that task
is the whole job.  Here the order key is cut into buckets by a caller-given
expression that is monotone in the order (a hex-hash prefix, or an integer
range).  Then

1. rows are counted per (group, bucket) -- a partial aggregate, so hot groups
   are combined map-side and spread over many buckets;
2. bucket offsets come from a window over at most ``n_buckets`` rows per
   group (bounded, independent of the data size);
3. each row's rank is its bucket offset plus its row_number inside the
   (group, bucket) partition, a 1/n_buckets slice of the group.

The result is the same exact ordinal a single window would give.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX_DIGITS = 4  # 65,536 buckets per group


def hash_bucket(hex_col: Column | str, digits: int = BUCKET_HEX_DIGITS) -> Column:
    """Bucket of a lower-case hex hash, monotone in the hash's string order."""
    c = F.col(hex_col) if isinstance(hex_col, str) else hex_col
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("int")


def ordinal(df: DataFrame, order_cols: Sequence[Column | str], bucket: Column,
            group_cols: Sequence[str] = (), name: str = "ordinal",
            total_name: str | None = None) -> DataFrame:
    """Add ``name``: the exact 1-based row_number within ``group_cols`` by
    ``order_cols`` (ascending; give a total order).  ``bucket`` must be
    non-decreasing along ``order_cols`` within a group.  ``total_name``
    optionally adds the group's row count."""
    g = list(group_cols)
    b = "__bucket"
    tagged = df.withColumn(b, bucket)
    counts = tagged.groupBy(*g, b).agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*g).orderBy(b)
    offsets = counts.withColumn(
        "__off", F.coalesce(F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total_name:
        offsets = offsets.withColumn(total_name, F.sum("__cnt").over(Window.partitionBy(*g)))
    offsets = offsets.drop("__cnt")
    inner = Window.partitionBy(*g, b).orderBy(*order_cols)
    return (tagged.join(offsets, [*g, b])
                  .withColumn(name, (F.col("__off") + F.row_number().over(inner)).cast("bigint"))
                  .drop("__off", b))


def running_totals(df: DataFrame, order_col: str, bucket: Column, value_cols: Sequence[str],
                   group_cols: Sequence[str] = (), suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``value_cols`` along ``order_col`` (unique
    within a group), computed with bounded per-group windows as above."""
    g = list(group_cols)
    b = "__bucket"
    tagged = df.withColumn(b, bucket)
    sums = tagged.groupBy(*g, b).agg(*[F.sum(v).alias(f"__s_{v}") for v in value_cols])
    w = Window.partitionBy(*g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*g, b, *[F.coalesce(F.sum(f"__s_{v}").over(w), F.lit(0)).alias(f"__o_{v}")
                                   for v in value_cols])
    inner = Window.partitionBy(*g, b).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.join(offsets, [*g, b])
    for v in value_cols:
        out = out.withColumn(f"{v}{suffix}", F.col(f"__o_{v}") + F.sum(v).over(inner))
    return out.drop(b, *[f"__o_{v}" for v in value_cols])


def int_range_bucket(col: str | Column, lo: Column, hi: Column, n: int = 65536) -> Column:
    """Monotone bucket of an integer-like column over [lo, hi] (scalar
    subquery columns).  Distinct values per bucket <= ceil((hi-lo+1)/n)."""
    c = F.col(col) if isinstance(col, str) else col
    width = F.greatest(F.ceil((hi - lo + F.lit(1)) / F.lit(n)), F.lit(1))
    return F.floor((c - lo) / width).cast("int")


def unit_bucket(col: str | Column, n: int = 65536) -> Column:
    """Monotone bucket of a value in [0, 1] (probabilities)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.least(F.greatest(F.floor(c * F.lit(n)), F.lit(0)), F.lit(n - 1)).cast("int")


def _ranged(df: DataFrame, order_cols: Sequence[Column | str]) -> DataFrame:
    """``df`` in even sorted ranges, as a stage table with each row's range
    (__ro_part) and place (__ro_at)."""
    from basketry.session import stage
    placed = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
              .withColumn("__ro_at", F.monotonically_increasing_id()))
    return stage(placed, "ranges").withColumn("__ro_part", F.shiftright("__ro_at", 33))


def range_ordinal(df: DataFrame, order_cols: Sequence[Column | str], name: str = "ordinal") -> DataFrame:
    """Add ``name``: the exact 0-based rank over the whole table along
    ``order_cols`` (a total order, or ties between equal rows), by sample
    sort: Spark draws splitters from a sample of the rows, each range is
    sorted by itself, and a rank is the row's place in its range plus the
    sizes of the ranges before.  The ranges are even whatever the
    distribution of the keys, and are written as a stage table, so that a
    rank never changes once given."""
    placed = _ranged(df, order_cols)
    sizes = placed.groupBy("__ro_part").agg(F.count(F.lit(1)).alias("__ro_n"))  # one row per range
    w = Window.orderBy("__ro_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__ro_part", F.coalesce(F.sum("__ro_n").over(w), F.lit(0)).alias("__ro_before"))
    return (placed.join(before, "__ro_part")
            .withColumn(name, F.col("__ro_before") + F.col("__ro_at").bitwiseAND((1 << 33) - 1))
            .drop("__ro_part", "__ro_at", "__ro_before"))


def range_running_totals(df: DataFrame, order_cols: Sequence[Column | str], value_cols: Sequence[str],
                         suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``value_cols`` over the whole table along
    ``order_cols`` (unique), by the same sample sort: sums within a range
    plus the sums of the ranges before."""
    placed = _ranged(df, order_cols)
    sums = placed.groupBy("__ro_part").agg(*[F.sum(v).alias(f"__ro_s_{v}") for v in value_cols])
    w = Window.orderBy("__ro_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__ro_part", *[F.coalesce(F.sum(f"__ro_s_{v}").over(w), F.lit(0)).alias(f"__ro_b_{v}") for v in value_cols])
    inner = Window.partitionBy("__ro_part").orderBy("__ro_at").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(before, "__ro_part")
    for v in value_cols:
        out = out.withColumn(f"{v}{suffix}", F.col(f"__ro_b_{v}") + F.sum(v).over(inner))
    return out.drop("__ro_part", "__ro_at", *[f"__ro_b_{v}" for v in value_cols])
