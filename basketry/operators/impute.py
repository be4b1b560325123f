"""Filling of missing values: means and modes with indicators, fills along a
series, and chained regressions.

A missing value is a null.  Other columns pass through unchanged; names that
start with two underscores are the operators' own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.ordinal import _ranged
from basketry.session import stage


# -- one value for all gaps of a column --------------------------------------------------

def mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent known value of ``column``, the smallest on ties (one
    row, none if no value is known)."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
            .orderBy(F.desc("__n"), F.asc(column)).limit(1).select(column))


def constant_fill(df: DataFrame, means: Sequence[str] = (), modes: Sequence[str] = ()) -> DataFrame:
    """Mean and mode imputation with ``<column>_was_missing`` (0/1) beside
    each filled column.  A column without any known value stays null."""
    known = {c: df.select(F.avg(c)).scalar() for c in means} | {c: mode(df, c).scalar() for c in modes}
    return df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in known}
                          | {c: F.coalesce(F.col(c), v) for c, v in known.items()})


def drop_missing(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with every one of ``columns``, and one row of counts
    (total_rows, dropped_rows, dropped_pct; 0 % of an empty table)."""
    gap = F.lit(False)
    for c in columns:
        gap = gap | F.col(c).isNull()
    dropped = F.count(F.when(gap, 1))
    total = F.count(F.lit(1))
    report = df.agg(total.alias("total_rows"), dropped.alias("dropped_rows"),
                    F.coalesce(F.round(F.try_divide(dropped * 100.0, total), 4), F.lit(0.0)).alias("dropped_pct"))
    return df.filter(~gap), report


# -- along a series ----------------------------------------------------------------------

def series_fill(df: DataFrame, order_cols: Sequence[str], value: str, x: Column,
                group_cols: Sequence[str] = ()) -> DataFrame:
    """Adds ``<value>_ffill`` (the last known value before a gap),
    ``<value>_bfill`` (the first after it) and ``<value>_linear`` (on the line
    between the two, by the position ``x``; between equal positions the value
    before).  A gap at an end of a series has no line, and no value from
    beyond the end.  ``order_cols`` is a total order within ``group_cols``; a
    null group is a group.

    The rows are cut into even sorted ranges (sample sort), so that one long
    series is many tasks.  A window runs inside (series, range); what a range
    hands to the next is one row, and a series has at most as many of those
    as there are ranges."""
    g = F.struct(F.lit(0).alias("__0"), *[F.col(c) for c in group_cols])
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("__sf_x").alias("x"), F.col(value).alias("v")))
    placed = (_ranged(df.withColumn("__sf_x", x), [*group_cols, *order_cols])
              .withColumn("__sf_g", g).withColumn("__sf_k", known))
    at = F.when(F.col("__sf_k").isNotNull(), F.col("__ro_at"))
    edges = placed.groupBy("__sf_g", "__ro_part").agg(F.max_by("__sf_k", at).alias("__last"), F.min_by("__sf_k", at).alias("__first"))
    before, here = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, Window.currentRow)
    parts = Window.partitionBy("__sf_g")
    # "after" is "before" in the opposite order: a frame that grows to the end would be summed anew per row
    carried = edges.select(
        "__sf_g", "__ro_part",
        F.last("__last", ignorenulls=True).over(parts.orderBy("__ro_part").rowsBetween(*before)).alias("__sf_in"),
        F.last("__first", ignorenulls=True).over(parts.orderBy(F.desc("__ro_part")).rowsBetween(*before)).alias("__sf_out"))
    inner = Window.partitionBy("__sf_g", "__ro_part")
    out = (placed.join(carried, ["__sf_g", "__ro_part"])
           .withColumn("__sf_p", F.coalesce(F.last("__sf_k", ignorenulls=True).over(inner.orderBy("__ro_at").rowsBetween(*here)), "__sf_in"))
           .withColumn("__sf_n", F.coalesce(F.last("__sf_k", ignorenulls=True).over(inner.orderBy(F.desc("__ro_at")).rowsBetween(*here)), "__sf_out")))
    p, n = F.col("__sf_p"), F.col("__sf_n")
    share = F.try_divide((F.col("__sf_x") - p["x"]).cast("double"), (n["x"] - p["x"]).cast("double"))
    line = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).otherwise(
        p["v"] + (n["v"] - p["v"]) * F.when(n["x"] == p["x"], F.lit(0.0)).otherwise(share))
    return (out.withColumn(f"{value}_ffill", p["v"]).withColumn(f"{value}_bfill", n["v"]).withColumn(f"{value}_linear", line)
            .drop("__sf_g", "__sf_x", "__sf_k", "__sf_p", "__sf_n", "__sf_in", "__sf_out", "__ro_part", "__ro_at"))


# -- chained regressions -----------------------------------------------------------------

def _gram(rows: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Sums of products of ``cols`` and a column of ones, in one aggregate."""
    x = [F.col(c) for c in cols] + [F.lit(1.0)]
    d = len(x)
    row = rows.agg(*[F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    g = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g


def chained_fill(df: DataFrame, columns: Sequence[str], max_rounds: int = 50, tol: float = 1e-6,
                 ridge: float = 1e-9) -> DataFrame:
    """Round-robin regression imputation of numeric ``columns`` (doubles in
    the result, tens of columns): gaps start at the column's mean; then each
    incomplete column in turn is regressed on all others over the rows where
    it is known, and its gaps take the fitted values, until no filled value
    moves by more than ``tol`` standard deviations in a round, or after
    ``max_rounds``.  Known values never change; ``<column>_was_missing``
    (0/1) marks the others.  A column without any known value stays null and
    predicts nothing; nor does a constant one.  NaN counts as missing.

    A fit needs sums of products only.  Those of the complete rows never
    change and are taken once; a round reads the rows with gaps alone, which
    are a stage table, rewritten once a round."""
    cols = list(columns)
    clean = df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols})
    row = clean.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(cols)
                      for n, f in (("m", F.avg), ("s", F.stddev_pop), ("n", F.count))],
                    F.count(F.lit(1)).alias("rows")).first()
    usable = [i for i in range(len(cols)) if row[f"n_{i}"]]
    mean = {i: row[f"m_{i}"] for i in usable}
    std = {i: row[f"s_{i}"] or 1.0 for i in usable}
    flags = {f"{c}_was_missing": F.col(c).isNull().cast("int") for c in cols}
    order = sorted((i for i in usable if row[f"n_{i}"] < row["rows"]), key=lambda i: (-row[f"n_{i}"], i))
    flagged = clean.withColumns(flags)
    if not order:
        return flagged
    z = {i: f"__z{i}" for i in usable}
    scaled = flagged.withColumns({z[i]: F.coalesce((F.col(cols[i]) - mean[i]) / std[i], F.lit(0.0)) for i in usable})
    gap = F.lit(0)
    for i in order:
        gap = gap + F.col(f"{cols[i]}_was_missing")
    names = [z[i] for i in usable]
    whole = _gram(scaled.filter(gap == 0), names)
    part = stage(scaled.filter(gap > 0), "chained")
    for _ in range(max_rounds):
        new = part.withColumns({f"__old{i}": F.col(z[i]) for i in order})
        for i in order:
            missing = F.col(f"{cols[i]}_was_missing") == 1
            g = whole + _gram(new.filter(~missing), names)
            at = usable.index(i)
            rest = [k for k in range(len(names) + 1) if k != at]
            a = g[np.ix_(rest, rest)]
            beta = np.linalg.solve(a + np.eye(len(rest)) * ridge * max(g[-1, -1], 1.0), g[rest, at])
            fit = F.lit(float(beta[-1]))
            for k, w in zip(rest[:-1], beta):
                fit = fit + F.lit(float(w)) * F.col(names[k])
            new = new.withColumn(z[i], F.when(missing, fit).otherwise(F.col(z[i])))
        part = stage(new, "chained")
        moved = part.select(F.max(F.greatest(*[F.abs(F.col(z[i]) - F.col(f"__old{i}")) for i in order], F.lit(0.0)))).first()[0]
        part = part.drop(*[f"__old{i}" for i in order])
        if moved <= tol:
            break
    filled = part.withColumns({cols[i]: F.coalesce(F.col(cols[i]), F.col(z[i]) * std[i] + mean[i]) for i in order})
    return filled.drop(*names).unionByName(flagged.filter(gap == 0))
