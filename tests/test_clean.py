"""Hand-made fixtures for the cleaning and aggregation traps."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from basketry.operators import clean, retail

TX_SCHEMA = ("InvoiceNo string, StockCode string, Description string, Quantity long, "
             "InvoiceDate timestamp_ntz, UnitPrice decimal(18,2), CustomerID long, Country string, "
             "LineOrder int")
D = dt.datetime(2011, 1, 1)


def tx(spark, rows):
    return spark.createDataFrame(rows, TX_SCHEMA)


def test_dirty_invoices_rules_counted_independently(spark):
    rows = [
        ("1", "A", "a", 2, D, Decimal("1.00"), 10, "UK", 1),
        ("C2", "A", "a", 1, D, Decimal("1.00"), 10, "UK", 2),      # cancelled
        ("3", "A", "a", 1, D, Decimal("1.00"), None, "UK", 3),     # null customer
        ("4", "A", "a", 0, D, Decimal("1.00"), 11, "UK", 4),       # quantity 0
        ("5", "A", "a", -1, D, Decimal("0.00"), 11, "UK", 5),      # two rules at once
    ]
    raw = tx(spark, rows)
    audit = clean.cleaning_audit(raw).first()
    assert (audit.null_customer, audit.cancelled, audit.bad_quantity, audit.bad_price) == (1, 1, 2, 1)
    ba = clean.before_after(raw).first()
    assert (ba.raw_rows, ba.clean_rows, ba.removed_rows) == (5, 1, 4)
    kept = clean.clean_transactions(raw).collect()
    assert len(kept) == 1 and kept[0].TotalPrice == Decimal("2.00")


def test_blank_charges_safe_cast_and_median(spark):
    rows = [("a", "29.85", "Yes", 0, 1.0), ("b", " ", "No", 0, 1.0), ("c", "", "No", 0, 1.0),
            ("d", "abc", "Yes", 0, 1.0), ("e", None, "No", 0, 1.0), ("f", "10.15", "No", 0, 1.0)]
    raw = spark.createDataFrame(rows, "customerID string, TotalCharges string, Churn string, "
                                      "tenure int, MonthlyCharges double")
    summary, sample = clean.blank_report(raw)
    assert summary.first().blank_rows == 2
    assert [r.customerID for r in sample.collect()] == ["b", "c"]
    out = {r.customerID: (r.TotalCharges, r.Churn) for r in clean.clean_customers(raw).collect()}
    # median of 29.85 and 10.15 fills every unparsable value; Yes/No -> 1/0
    assert out["b"] == (20.0, 0) and out["d"] == (20.0, 1) and out["e"] == (20.0, 0)


def test_null_description_first_non_null_and_last_writer(spark):
    rows = [("1", "X", None, 1, D, Decimal("1.00"), 5, "UK", 1),
            ("2", "X", "late", 1, D, Decimal("1.00"), 5, "UK", 3),
            ("3", "X", "early", 1, D, Decimal("1.00"), 5, "UK", 2),
            ("4", "X", "other", 1, D, Decimal("1.00"), 9, "UK", 4)]
    inter = retail.interactions(tx(spark, rows))
    got = {r.CustomerID: (r.purchase_count, r.description) for r in inter.collect()}
    assert got[5] == (3, "early")            # first non-null in line order
    desc = retail.item_descriptions(inter).first()
    assert desc.Description == "other"       # highest CustomerID wins


def test_recency_floors_timestamp_difference(spark):
    mx = dt.datetime(2011, 12, 9, 12, 0)
    rows = [("1", "A", "a", 1, mx - dt.timedelta(hours=23), Decimal("1.00"), 1, "UK", 1),
            ("2", "A", "a", 1, mx - dt.timedelta(hours=25), Decimal("1.00"), 2, "UK", 2),
            ("3", "A", "a", 1, mx, Decimal("1.00"), 3, "UK", 3)]
    r = {x.CustomerID: x.Recency for x in retail.rfm(clean.clean_transactions(tx(spark, rows))).collect()}
    assert r == {1: 1, 2: 2, 3: 1}


def test_two_countries_count_twice(spark):
    rows = [("1", "A", "a", 1, D, Decimal("1.00"), 1, "UK", 1),
            ("2", "A", "a", 1, D, Decimal("1.00"), 1, "FR", 2),
            ("3", "A", "a", 1, D, Decimal("1.00"), 2, "UK", 3)]
    c = {r.Country: r.share_pct for r in retail.customers_per_country(tx(spark, rows)).collect()}
    assert abs(c["UK"] - 200 / 3) < 1e-4 and abs(c["FR"] - 100 / 3) < 1e-4
