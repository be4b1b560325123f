"""Cleaning of invoice lines and customer rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.exprs import is_blank, safe_double, yes_no_to_int
from basketry.functions.quantile import exact_median

# The customer table's columns, as in the reference layout.
CATEGORICAL_COLS = ["segment", "region", "top_priority", "has_returns", "has_events"]
NUMERIC_COLS = ["debt_flag", "tenure", "MonthlyCharges", "TotalCharges"]
FEATURE_COLS = CATEGORICAL_COLS + NUMERIC_COLS
ID_COL = "customerID"
LABEL_COL = "Churn"


# -- invoice lines ---------------------------------------------------------

def rule_columns() -> dict:
    """The four cleaning rules as boolean 'row is removed by this rule'."""
    return {
        "null_customer": F.col("CustomerID").isNull(),
        "cancelled": F.coalesce(F.col("InvoiceNo").cast("string").startswith("C"), F.lit(False)),
        "bad_quantity": F.coalesce(F.col("Quantity") <= 0, F.lit(False)),
        "bad_price": F.coalesce(F.col("UnitPrice") <= 0, F.lit(False)),
    }


def clean_transactions(raw: DataFrame) -> DataFrame:
    """X12 = X8 drop null customer, X9 drop cancellations, X10 positive
    quantity and price, X11 TotalPrice.  Catalyst merges the filters into
    one predicate evaluated right after the scan."""
    return (raw.dropna(subset=["CustomerID"])
               .filter(~F.col("InvoiceNo").cast("string").startswith("C"))
               .filter((F.col("Quantity") > 0) & (F.col("UnitPrice") > 0))
               .withColumn("TotalPrice", F.col("Quantity") * F.col("UnitPrice")))


def cleaning_audit(raw: DataFrame) -> DataFrame:
    """Rows hit by each rule, each counted independently on raw."""
    return raw.agg(*[F.count_if(c).alias(name) for name, c in rule_columns().items()],
                   F.count(F.lit(1)).alias("raw_rows"))


def before_after(raw: DataFrame) -> DataFrame:
    """Raw rows, kept rows and removed rows from one scan."""
    r = rule_columns()
    removed = r["null_customer"] | r["cancelled"] | r["bad_quantity"] | r["bad_price"]
    return (raw.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(~removed).alias("clean_rows"))
               .withColumn("removed_rows", F.col("raw_rows") - F.col("clean_rows")))


# -- customers -------------------------------------------------------------

def blank_report(raw_customers: DataFrame, column: str = "TotalCharges", sample: int = 10):
    """(summary, sample).  Summary: blanks, rows, share of blanks.
    Sample: the first ``sample`` blank rows by id."""
    summary = raw_customers.agg(
        F.count_if(is_blank(column)).alias("blank_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    ).withColumn("blank_pct", F.round(F.col("blank_rows") / F.col("total_rows") * 100, 4))
    rows = (raw_customers.filter(is_blank(column))
            .select(ID_COL, "tenure", "MonthlyCharges", column, LABEL_COL)
            .orderBy(ID_COL).limit(sample))
    return summary, rows


def skew_evidence(raw_customers: DataFrame, column: str = "TotalCharges") -> DataFrame:
    """A10: mean, exact median, min, max of the parsed raw column."""
    v = safe_double(column)
    med = exact_median(raw_customers.select(v.alias("__v")), "__v")
    return raw_customers.agg(
        F.round(F.avg(v), 6).alias("mean"), F.round(F.lit(med).cast("double"), 6).alias("median"),
        F.min(v).alias("min"), F.max(v).alias("max"))


def clean_customers(raw_customers: DataFrame) -> DataFrame:
    """X1 safe cast, X5 exact-median fill, X3 Yes/No -> 1/0.

    The median is exact (not approx_percentile) and found by distributed
    narrowing (functions/quantile.py), so no task gathers the column."""
    parsed = raw_customers.withColumn("TotalCharges", safe_double("TotalCharges"))
    med = exact_median(parsed, "TotalCharges")
    return (parsed.withColumn("TotalCharges", F.coalesce(F.col("TotalCharges"), F.lit(med).cast("double")))
                  .withColumn(LABEL_COL, yes_no_to_int(LABEL_COL)))


def churn_filter(customers: DataFrame, which: str = "All", n: int = 200):
    """(rows, counts).  rows: first ``n`` by id of the chosen subset;
    counts: shown vs total in the subset."""
    if which == "Churned":
        sub = customers.filter(F.col(LABEL_COL) == 1)
    elif which == "Retained":
        sub = customers.filter(F.col(LABEL_COL) == 0)
    else:
        sub = customers
    counts = sub.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "shown", F.least(F.col("total"), F.lit(n)))
    return sub.orderBy(ID_COL).limit(n), counts
