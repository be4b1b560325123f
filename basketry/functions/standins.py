"""Deterministic stand-ins for model outputs.

Operators that consume model output (metrics, verdicts, explanations,
cluster profiles) are checked against SQL by feeding both engines the same
md5-derived input.  The expressions below are reproduced exactly by DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_unit(tag: str, *cols) -> Column:
    """Uniform value in [0, 1) from the first 32 bits of md5(tag|cols)."""
    parts = [F.lit(tag)] + [F.col(c).cast("string") if isinstance(c, str) else c for c in cols]
    h = F.md5(F.concat_ws("|", *parts)) if len(parts) > 2 else F.md5(F.concat(parts[0], F.lit("|"), parts[1]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def demo_score(id_col: str = "customerID", label_col: str = "Churn") -> Column:
    """Label-informed stand-in probability: 0.3 * label + 0.7 * noise."""
    return F.lit(0.3) * F.col(label_col) + F.lit(0.7) * md5_unit("score", id_col)


def given_cluster(id_col: str, k: int = 4) -> Column:
    """Stand-in cluster assignment: numeric id modulo k."""
    return F.pmod(F.col(id_col).cast("bigint"), F.lit(k)).cast("int")
