"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "safe_double", "is_blank", "yes_no_to_int", "churn_label", "risk_band",
    "truncate_label", "hash_key", "days_between", "ratio", "money",
    "RISK_BANDS", "CHURN_LABELS",
]

# Display labels for the churn code and risk band edges.
CHURN_LABELS = {0: "Retained", 1: "Churned"}
RISK_BANDS = ((0.3, "Low"), (0.6, "Medium"), (None, "High"))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_double(c) -> Column:
    """Numeric parse where bad text becomes null (ANSI-safe)."""
    return _c(c).try_cast("double")


def is_blank(c) -> Column:
    """Text that is empty after stripping spaces."""
    return F.trim(_c(c)) == ""


def yes_no_to_int(c) -> Column:
    """Yes -> 1, No -> 0, anything else -> null."""
    col = _c(c)
    return F.when(col == "Yes", 1).when(col == "No", 0)


def churn_label(c) -> Column:
    """Churn code to display label."""
    col = _c(c)
    return F.when(col == 0, CHURN_LABELS[0]).when(col == 1, CHURN_LABELS[1])


def risk_band(c) -> Column:
    """Probability to Low / Medium / High."""
    col = _c(c)
    return F.when(col < RISK_BANDS[0][0], RISK_BANDS[0][1]) \
            .when(col < RISK_BANDS[1][0], RISK_BANDS[1][1]).otherwise(RISK_BANDS[2][1])


def truncate_label(c, width: int = 15) -> Column:
    """Keep ``width`` characters and mark the cut with ``...``."""
    col = _c(c).cast("string")
    return F.when(F.length(col) > width, F.concat(F.substring(col, 1, width), F.lit("..."))) \
            .otherwise(col)


def hash_key(seed, *cols) -> Column:
    """Deterministic pseudo-random order key: md5 over seed and key columns.

    DuckDB computes the same hex string, so random draws are reproducible
    in both engines and stable under task retries.
    """
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(c).cast("string") for c in cols]))


def days_between(later, earlier) -> Column:
    """Whole days of a timestamp difference, floored (not a date difference).
    ``timestamp_diff`` on wall-clock timestamps is independent of the
    session time zone (no DST hour appears or disappears)."""
    us = F.timestamp_diff("MICROSECOND", _c(earlier), _c(later))
    return F.floor(us / F.lit(86_400_000_000)).cast("bigint")


def ratio(num, den, digits: int = 6) -> Column:
    """Guarded ratio: 0 when the denominator is 0 or null, rounded."""
    return F.round(F.coalesce(F.try_divide(_c(num).cast("double"), _c(den).cast("double")),
                              F.lit(0.0)), digits)


def money(c) -> Column:
    """Exact money sum result as double (sum in decimal, convert at the end)."""
    return _c(c).cast("double")
