"""Binding of the star-schema test tables onto the two reference layouts.

``raw_transactions``: one row per invoice line (lineitem x orders x part,
plus customer x nation for Country).  ``customers_raw``: one row per
customer, features from orders before a cutoff one year before the last
order, label from orders on or after it.

Scale notes: lineitem x orders is the only big-big join; both sides are
shuffled on the order key (bucket both tables on it to make that join
shuffle-free).  nation and region are fixed 25/5-row dimensions and are
broadcast explicitly; part and customer grow with the data, so AQE decides
at runtime from real shuffle sizes whether they can be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources.tables import read_table


def raw_transactions(spark: SparkSession, sf_dir: str, with_country: bool = True) -> DataFrame:
    """Invoice lines as read: InvoiceNo, StockCode, Description, Quantity,
    InvoiceDate, UnitPrice, CustomerID[, Country], plus ``LineOrder``, a
    struct over the line's own columns that stands in for file order."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                     "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_retailprice"])
    df = (li.join(orders, li.l_orderkey == orders.o_orderkey)
            .join(part, li.l_partkey == part.p_partkey))
    # InvoiceNo is built from lineitem's own order key (equal to o_orderkey
    # under the join), so the cancellation filter only references lineitem
    # columns and Catalyst applies it below the lineitem x orders join.
    cols = [
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("C"), F.col("l_orderkey").cast("string")))
         .otherwise(F.col("l_orderkey").cast("string")).alias("InvoiceNo"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.col("p_name").alias("Description"),
        F.col("l_quantity").cast("bigint").alias("Quantity"),
        F.col("o_orderdate").alias("InvoiceDate"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("UnitPrice"),
        F.col("o_custkey").alias("CustomerID"),
    ]
    if with_country:
        nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
        cust = (read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
                .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))
        df = df.join(cust, F.col("o_custkey") == F.col("c_custkey"))
        cols.append(F.col("n_name").alias("Country"))
    cols.append(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                         "l_shipdate", "l_quantity", "l_extendedprice").alias("LineOrder"))
    return df.select(*cols)


def _months(c):
    return F.year(c) * 12 + F.month(c)


def customers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer table as read (TotalCharges is text, Churn is Yes/No)."""
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"])
    # One-row global values become scalar subqueries, never joins.
    cutoff = orders.select(F.max("o_orderdate") - F.expr("INTERVAL 365 DAYS")).scalar()
    pre = orders.filter(F.col("o_orderdate") < cutoff)

    # One aggregation chain for spend, first order and the most frequent
    # priority (ties alphabetical): (customer, priority) partials first, so a
    # heavy customer is combined map-side, then one row per customer.
    per_prio = pre.groupBy("o_custkey", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_p"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spend_p"))
    spend = per_prio.groupBy("o_custkey").agg(
        F.min("first_p").alias("first_order"), F.sum("spend_p").alias("spend"),
        F.min_by("o_orderpriority", F.struct(-F.col("n"), F.col("o_orderpriority"))).alias("top_priority"))
    returned = (read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag"])
                .filter(F.col("l_returnflag") == "R").select("l_orderkey"))
    has_returns = (pre.join(returned, pre.o_orderkey == returned.l_orderkey, "left_semi")
                      .select(F.col("o_custkey").alias("r_custkey")).distinct())
    has_events = (read_table(spark, sf_dir, "events", ["user_id"]).distinct())
    active = (orders.filter(F.col("o_orderdate") >= cutoff)
                    .select(F.col("o_custkey").alias("a_custkey")).distinct())

    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey)
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])

    df = (cust.join(geo, cust.c_nationkey == geo.n_nationkey)
              .join(spend, cust.c_custkey == spend.o_custkey, "left")
              .join(has_returns, cust.c_custkey == has_returns.r_custkey, "left")
              .join(has_events, cust.c_custkey == has_events.user_id, "left")
              .join(active, cust.c_custkey == active.a_custkey, "left"))

    tenure = F.when(F.col("first_order").isNull(), F.lit(0)).otherwise(
        _months(F.lit(cutoff)) - _months(F.col("first_order"))
        - F.when(F.dayofmonth(F.lit(cutoff)) < F.dayofmonth("first_order"), 1).otherwise(0))
    cents = (F.col("spend") * 100).cast("bigint")
    t = F.greatest(F.col("tenure"), F.lit(1)).cast("bigint")
    monthly = F.when(F.col("spend").isNull(), F.lit(0.0)).otherwise(
        F.expr("(2 * cents + t) div (2 * t)").cast("double") / 100.0)
    return (df.select(
                F.col("c_custkey").cast("string").alias("customerID"),
                F.col("c_mktsegment").alias("segment"),
                F.col("r_name").alias("region"),
                F.coalesce("top_priority", F.lit("none")).alias("top_priority"),
                F.when(F.col("r_custkey").isNotNull(), "Yes").otherwise("No").alias("has_returns"),
                F.when(F.col("user_id").isNotNull(), "Yes").otherwise("No").alias("has_events"),
                (F.col("c_acctbal") < 0).cast("int").alias("debt_flag"),
                tenure.cast("int").alias("tenure"),
                F.col("spend"),
                F.when(F.col("a_custkey").isNull(), "Yes").otherwise("No").alias("Churn"))
            .withColumn("cents", cents).withColumn("t", t)
            .select("customerID", "segment", "region", "top_priority", "has_returns",
                    "has_events", "debt_flag", "tenure",
                    monthly.alias("MonthlyCharges"),
                    F.coalesce(F.col("spend").cast("string"), F.lit("")).alias("TotalCharges"),
                    "Churn"))
