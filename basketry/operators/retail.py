"""Aggregates over cleaned invoice lines (A2, A14-A22, A26, A28, W1-W3,
W6-W10, W13, J1-J4, X15, X20).

Everything stays long-form ``(CustomerID, StockCode, value)``; counts that
a dense matrix would give (users, items, non-zeros) are aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.exprs import days_between, hash_key, truncate_label
from basketry.functions.ordinal import hash_bucket, ordinal, range_ordinal
from basketry.functions.quantile import exact_median

USER, ITEM = "CustomerID", "StockCode"


# -- interaction table -----------------------------------------------------

def interactions(tx: DataFrame, with_description: bool = True) -> DataFrame:
    """Total quantity per (customer, item); with the first
    non-null description in line order.  A hot customer is combined
    map-side by the partial aggregate before the shuffle."""
    aggs = [F.sum("Quantity").alias("purchase_count")]
    if with_description:
        order = F.when(F.col("Description").isNotNull(), F.col("LineOrder"))
        aggs.append(F.min_by("Description", order).alias("description"))
    return tx.groupBy(USER, ITEM).agg(*aggs)


def item_descriptions(inter: DataFrame) -> DataFrame:
    """One description per item; on conflict the row of the highest
    CustomerID wins (last writer in the reference's sorted iteration)."""
    return inter.groupBy(ITEM).agg(F.max_by("description", USER).alias("Description"))


def item_descriptions_from_lines(tx: DataFrame) -> DataFrame:
    """A16 straight from invoice lines, without the per-pair description:
    per item, the row of the highest CustomerID, its first non-null
    description in line order (null if it has none).  Lets the training
    path aggregate quantities only (a hash aggregate) while display lookups
    still get the reference's description."""
    order = F.struct(-F.col(USER), F.col("Description").isNull(), F.col("LineOrder"))
    return tx.groupBy(ITEM).agg(F.min_by("Description", order).alias("Description"))


def user_dim(inter: DataFrame) -> DataFrame:
    """Dense 0-based index by sorted distinct CustomerID."""
    return range_ordinal(inter.select(USER).distinct(), [USER], "user_idx")


def item_dim(inter: DataFrame) -> DataFrame:
    """Dense 0-based item index by order of first appearance in
    (CustomerID, StockCode) order, i.e. by (first buyer, StockCode)."""
    first = inter.groupBy(ITEM).agg(F.min(USER).alias("first_user"))
    return range_ordinal(first, ["first_user", ITEM], "item_idx").select(ITEM, "item_idx")


def index_interactions(inter: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Id -> index.  Dimensions grow with the data, so AQE picks the
    join strategy from runtime sizes rather than a blind broadcast."""
    return inter.join(users, USER).join(items, ITEM)


def keep_known(df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Keep rows whose user and item are in the dimensions."""
    return df.join(users.select(USER), USER, "left_semi").join(items.select(ITEM), ITEM, "left_semi")


def with_description(df: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Description lookup, ``N/A`` when missing."""
    return (df.join(descriptions, ITEM, "left")
              .withColumn("Description", F.coalesce("Description", F.lit("N/A"))))


# -- hold-out split ----------------------------------------------------------

def holdout_flags(inter: DataFrame, test_ratio: float = 0.2, seed: int = 42, min_items: int = 5) -> DataFrame:
    """W3 in one table: the interaction rows with an ``is_test`` flag (see
    ``holdout_split``); write it once, then train and test are filters."""
    h = hash_key(seed, USER, ITEM)
    ranked = ordinal(inter.withColumn("__h", h), ["__h", ITEM], hash_bucket("__h"),
                     group_cols=[USER], name="__rank", total_name="__n")
    n_test = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(test_ratio)).cast("bigint"))
    return (ranked.withColumn("is_test", (F.col("__n") >= min_items) & (F.col("__rank") <= n_test))
                  .select(*inter.columns, "is_test"))


def split_from_flags(flags: DataFrame):
    """(train, test) from a flagged table."""
    cols = [c for c in flags.columns if c != "is_test"]
    train = flags.filter(~F.col("is_test")).select(*cols)
    test = flags.filter(F.col("is_test")).select(USER, ITEM, F.col("purchase_count").alias("score"))
    return train, test


def holdout_split(inter: DataFrame, test_ratio: float = 0.2, seed: int = 42, min_items: int = 5):
    """Per user with >= ``min_items`` items, hold out
    ``max(1, int(n * test_ratio))`` items picked by an md5 order (the same
    draw in Spark and DuckDB, stable under retries).  Returns (train, test)
    with test columns (CustomerID, StockCode, score).  Ranks come from the
    bucketed ordinal, so a hot user is spread over many tasks."""
    h = hash_key(seed, USER, ITEM)
    ranked = ordinal(inter.withColumn("__h", h), ["__h", ITEM], hash_bucket("__h"),
                     group_cols=[USER], name="__rank", total_name="__n")
    n_test = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(test_ratio)).cast("bigint"))
    flagged = ranked.withColumn("__test", (F.col("__n") >= min_items) & (F.col("__rank") <= n_test))
    keep = [c for c in inter.columns]
    train = flagged.filter(~F.col("__test")).select(*keep)
    test = flagged.filter(F.col("__test")).select(USER, ITEM, F.col("purchase_count").alias("score"))
    return train, test


def split_summary(train: DataFrame, test: DataFrame) -> DataFrame:
    """Training non-zeros, test rows, test users."""
    t = train.filter(F.col("purchase_count") > 0)
    return t.agg(F.count(F.lit(1)).alias("train_nnz"),
                 test.select(F.count(F.lit(1))).scalar().alias("test_rows"),
                 test.select(F.countDistinct(USER)).scalar().alias("test_users"))


# -- KPIs --------------------------------------------------------------------

def sparsity(inter: DataFrame) -> DataFrame:
    """Users, items, possible pairs, non-zeros and sparsity."""
    return (inter.agg(F.countDistinct(USER).alias("n_users"), F.countDistinct(ITEM).alias("n_items"),
                      F.count_if(F.col("purchase_count") > 0).alias("n_interactions"))
                 .withColumn("n_possible", F.col("n_users") * F.col("n_items"))
                 .withColumn("sparsity", F.round(1 - F.col("n_interactions") / F.col("n_possible"), 6))
                 .select("n_users", "n_items", "n_possible", "n_interactions", "sparsity"))


def rec_kpis(tx: DataFrame, inter: DataFrame, conversion_pct: float = 5.0) -> DataFrame:
    """A2 + X19: users, items, transactions, sparsity, revenue, average
    order line, and the revenue uplift projection."""
    s = sparsity(inter).select("n_users", "n_items", "sparsity")
    t = tx.agg(F.count(F.lit(1)).alias("n_transactions"),
               F.sum("TotalPrice").alias("__rev"), F.count("TotalPrice").alias("__n"))
    # both sides are one-row aggregates: combine them as scalar subqueries
    return (s.select("*", *[t.select(c).scalar().alias(c) for c in t.columns])
             .select("n_users", "n_items", "n_transactions", "sparsity",
                     F.col("__rev").cast("double").alias("total_revenue"),
                     F.round(F.col("__rev").cast("double") / F.col("__n"), 6).alias("avg_order_line"),
                     F.round(F.col("__rev").cast("double") * (conversion_pct / 100.0), 6)
                      .alias("additional_revenue")))


def storage_estimate(inter: DataFrame) -> DataFrame:
    """Dense (4 bytes per cell) vs sparse (12 bytes per non-zero)."""
    return (sparsity(inter)
            .withColumn("dense_bytes", F.col("n_possible") * 4)
            .withColumn("sparse_bytes", F.col("n_interactions") * 12)
            .withColumn("saving_pct", F.round((1 - F.col("sparse_bytes") / F.col("dense_bytes")) * 100, 4))
            .select("n_users", "n_items", "dense_bytes", "sparse_bytes", "saving_pct"))


# -- distributions -----------------------------------------------------------

def products_per_customer(tx: DataFrame) -> DataFrame:
    """Unique products per customer."""
    return tx.groupBy(USER).agg(F.countDistinct(ITEM).alias("UniqueProducts"))


def products_summary(per_customer: DataFrame) -> DataFrame:
    """Exact median and mean of unique products per customer."""
    med = exact_median(per_customer, "UniqueProducts")
    return per_customer.agg(F.lit(med).cast("double").alias("median_products"),
                            F.round(F.avg("UniqueProducts"), 6).alias("mean_products"))


def buyers_per_description(tx: DataFrame) -> DataFrame:
    """Unique buyers per Description (null descriptions dropped, as a
    pandas groupby does), with the popularity rank (W6)."""
    counts = (tx.filter(F.col("Description").isNotNull())
                .groupBy("Description").agg(F.countDistinct(USER).alias("UniqueBuyers")))
    return counts


def top_products(tx: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` descriptions with most unique buyers (ties by name)."""
    return (buyers_per_description(tx).orderBy(F.desc("UniqueBuyers"), F.asc("Description"))
            .limit(n))


def daily_activity(tx: DataFrame) -> DataFrame:
    """Distinct orders and revenue per calendar day."""
    return (tx.groupBy(F.to_date("InvoiceDate").alias("Date"))
              .agg(F.countDistinct("InvoiceNo").alias("Orders"),
                   F.sum("TotalPrice").cast("double").alias("Revenue")))


def customers_per_country(tx: DataFrame) -> DataFrame:
    """Distinct customers per country and the share of each in the sum
    of the per-country counts (a customer in two countries counts twice)."""
    counts = tx.groupBy("Country").agg(F.countDistinct(USER).alias("UniqueCustomers"))
    total = counts.select(F.sum("UniqueCustomers")).scalar()
    return counts.withColumn("share_pct", F.round(F.col("UniqueCustomers") / total * 100, 6))


def top_countries(tx: DataFrame, n: int = 15) -> DataFrame:
    """Top ``n`` countries by unique customers (ties by name)."""
    return customers_per_country(tx).orderBy(F.desc("UniqueCustomers"), "Country").limit(n)


def rfm(tx: DataFrame) -> DataFrame:
    """Recency (whole days from last purchase to max date + 1 day,
    floored), Frequency (distinct invoices), Monetary (exact sum)."""
    ref = tx.select(F.max("InvoiceDate") + F.expr("INTERVAL 1 DAY")).scalar()
    return (tx.groupBy(USER)
              .agg(F.max("InvoiceDate").alias("__last"),
                   F.countDistinct("InvoiceNo").alias("Frequency"),
                   F.sum("TotalPrice").alias("__m"))
              .select(USER, days_between(ref, F.col("__last")).alias("Recency"),
                      "Frequency", F.col("__m").cast("double").alias("Monetary")))


def monthly_growth(tx: DataFrame) -> DataFrame:
    """Per month, users and (user, item) pairs seen for the first time,
    and their running totals.  The running window runs over one row per
    month, a number that does not grow with the data."""
    month = F.date_trunc("month", "InvoiceDate").cast("date")
    first_user = tx.groupBy(USER).agg(F.min(month).alias("month"))
    first_pair = tx.groupBy(USER, ITEM).agg(F.min(month).alias("month"))
    nu = first_user.groupBy("month").agg(F.count(F.lit(1)).alias("new_users"))
    npairs = first_pair.groupBy("month").agg(F.count(F.lit(1)).alias("new_interactions"))
    months = tx.select(month.alias("month")).distinct()
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return (months.join(nu, "month", "left").join(npairs, "month", "left")
                  .fillna(0, ["new_users", "new_interactions"])
                  .withColumn("active_users", F.sum("new_users").over(w))
                  .withColumn("interactions", F.sum("new_interactions").over(w)))


def month_plan(tx: DataFrame, n_initial: int = 6) -> DataFrame:
    """Distinct months ranked; the first ``n_initial`` are initial
    training, the last is the test month, the rest stream in order."""
    month = F.date_trunc("month", "InvoiceDate").cast("date")
    months = tx.select(month.alias("month")).distinct()
    w = Window.orderBy("month")
    n = months.select(F.count(F.lit(1))).scalar()
    return (months.withColumn("month_rank", F.dense_rank().over(w).cast("bigint"))
                  .withColumn("role", F.when(F.col("month_rank") <= n_initial, "initial")
                                       .when(F.col("month_rank") == n, "test")
                                       .otherwise("stream")))


# -- samples and per-customer views ------------------------------------------

def matrix_sample(inter: DataFrame, n_users: int = 8, n_items: int = 12) -> DataFrame:
    """W8 + X21: quantities of the first ``n_users`` users (by id) on the
    ``n_items`` items with the largest total quantity, zero-filled, with the
    15-character label.  Both sides are explicitly bounded before the grid
    is built."""
    top_items = (inter.groupBy(ITEM).agg(F.sum("purchase_count").alias("__tot"))
                      .orderBy(F.desc("__tot"), ITEM).limit(n_items).select(ITEM))
    first_users = inter.select(USER).distinct().orderBy(USER).limit(n_users)
    # the item list is bounded by n_items, so it travels as one array value
    grid = first_users.withColumn(ITEM, F.explode(top_items.agg(F.collect_list(ITEM)).scalar()))
    return (grid.join(inter.select(USER, ITEM, "purchase_count"), [USER, ITEM], "left")
                .select(USER, ITEM, truncate_label(ITEM).alias("label"),
                        F.coalesce("purchase_count", F.lit(0)).cast("bigint").alias("quantity")))


def customer_history(train: DataFrame, n: int = 15) -> DataFrame:
    """Per customer, the ``n`` items with the largest quantity (ties by
    StockCode).  row_number <= n plans a WindowGroupLimit, which keeps only
    n rows per customer on the map side before the shuffle."""
    w = Window.partitionBy(USER).orderBy(F.desc("purchase_count"), ITEM)
    return (train.filter(F.col("purchase_count") > 0)
                 .withColumn("rank", F.row_number().over(w).cast("bigint"))
                 .filter(F.col("rank") <= n))


def active_customers(train: DataFrame, min_items: int = 10, n: int = 100) -> DataFrame:
    """First ``n`` customers (by id) with at least ``min_items`` items,
    with a display label."""
    return (train.filter(F.col("purchase_count") > 0).groupBy(USER)
                 .agg(F.count(F.lit(1)).alias("n_products"))
                 .filter(F.col("n_products") >= min_items)
                 .orderBy(USER).limit(n)
                 .withColumn("label", F.format_string("Customer %d (%d products purchased)",
                                                      F.col(USER), F.col("n_products"))))
