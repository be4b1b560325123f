"""Queries over invoice lines and the interaction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import clean, retail
from basketry.plans.catalog import register
from basketry.plans.oracle_sql import HOLDOUT, INTER, TX, TX_RAW, with_
from basketry.sources import raw_transactions


def tx(spark, sf, country=False):
    return clean.clean_transactions(raw_transactions(spark, sf, with_country=country))


def inter(spark, sf, with_description=False):
    """Interaction table; quantities only unless the description is shown
    (the quantity-only aggregate is a hash aggregate, no sort)."""
    return retail.interactions(tx(spark, sf), with_description=with_description)


@register("S2_raw_transactions", with_(TX_RAW) + """
SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate,
       CAST(UnitPrice AS DOUBLE) AS UnitPrice, CustomerID, Country FROM tx_raw""")
def s2_raw(spark, sf):
    """Invoice lines as read (binding view)."""
    return (raw_transactions(spark, sf).drop("LineOrder")
            .withColumn("UnitPrice", F.col("UnitPrice").cast("double")))


@register("X12_clean_transactions", with_(TX) + """
SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate,
       CAST(UnitPrice AS DOUBLE) AS UnitPrice, CustomerID, Country,
       CAST(TotalPrice AS DOUBLE) AS TotalPrice FROM tx""")
def x12(spark, sf):
    """Cleaned invoice lines with TotalPrice."""
    return (tx(spark, sf, country=True).drop("LineOrder")
            .withColumn("UnitPrice", F.col("UnitPrice").cast("double"))
            .withColumn("TotalPrice", F.col("TotalPrice").cast("double")))


@register("A12_cleaning_audit", with_(TX_RAW) + """
SELECT count(*) FILTER (WHERE CustomerID IS NULL) AS null_customer,
       count(*) FILTER (WHERE starts_with(InvoiceNo, 'C')) AS cancelled,
       count(*) FILTER (WHERE Quantity <= 0) AS bad_quantity,
       count(*) FILTER (WHERE UnitPrice <= 0) AS bad_price,
       count(*) AS raw_rows FROM tx_raw""")
def a12(spark, sf):
    """Rows hit by each cleaning rule, counted independently."""
    return clean.cleaning_audit(raw_transactions(spark, sf, with_country=False))


@register("A13_before_after", with_(TX) + """
SELECT (SELECT count(*) FROM tx_raw) AS raw_rows, count(*) AS clean_rows,
       (SELECT count(*) FROM tx_raw) - count(*) AS removed_rows FROM tx""")
def a13(spark, sf):
    """Row counts before and after cleaning."""
    return clean.before_after(raw_transactions(spark, sf, with_country=False))


@register("A14_interactions", with_(INTER) + "SELECT * FROM inter")
def a14(spark, sf):
    """Quantity and first description per (customer, item)."""
    return inter(spark, sf, with_description=True)


@register("A15_interaction_quantity", with_(INTER) + """
SELECT CustomerID, StockCode, purchase_count FROM inter""")
def a15(spark, sf):
    """Quantity per (customer, item)."""
    return retail.interactions(tx(spark, sf), with_description=False)


@register("A16_item_descriptions", with_(INTER) + """
SELECT StockCode, arg_max(description, CustomerID) AS Description FROM inter GROUP BY StockCode""")
def a16(spark, sf):
    """One description per item, highest CustomerID wins."""
    return retail.item_descriptions_from_lines(tx(spark, sf))


@register("A17_products_per_customer", with_(TX) + """
SELECT CustomerID, count(DISTINCT StockCode) AS UniqueProducts FROM tx GROUP BY CustomerID""")
def a17(spark, sf):
    """Unique products per customer."""
    return retail.products_per_customer(tx(spark, sf))


@register("A17_products_summary", with_(TX) + """,
pc AS (SELECT CustomerID, count(DISTINCT StockCode) AS UniqueProducts FROM tx GROUP BY CustomerID)
SELECT CAST(median(UniqueProducts) AS DOUBLE) AS median_products,
       round(avg(UniqueProducts), 6) AS mean_products FROM pc""")
def a17s(spark, sf):
    """Median and mean unique products per customer."""
    return retail.products_summary(retail.products_per_customer(tx(spark, sf)))


@register("A18_buyers_per_description", with_(TX) + """
SELECT Description, count(DISTINCT CustomerID) AS UniqueBuyers FROM tx
WHERE Description IS NOT NULL GROUP BY Description""")
def a18(spark, sf):
    """Unique buyers per description (long tail)."""
    return retail.buyers_per_description(tx(spark, sf))


@register("W6_top_products", with_(TX) + """
SELECT Description, count(DISTINCT CustomerID) AS UniqueBuyers FROM tx
WHERE Description IS NOT NULL GROUP BY Description
ORDER BY UniqueBuyers DESC, Description LIMIT 15""")
def w6(spark, sf):
    """Top 15 descriptions by unique buyers."""
    return retail.top_products(tx(spark, sf))


@register("A19_sparsity", with_(INTER) + """
SELECT count(DISTINCT CustomerID) AS n_users, count(DISTINCT StockCode) AS n_items,
       count(DISTINCT CustomerID) * count(DISTINCT StockCode) AS n_possible,
       count(*) FILTER (WHERE purchase_count > 0) AS n_interactions,
       round(1 - count(*) FILTER (WHERE purchase_count > 0)
             / (count(DISTINCT CustomerID) * count(DISTINCT StockCode)), 6) AS sparsity
FROM inter""")
def a19(spark, sf):
    """Users, items, possible pairs, non-zeros, sparsity."""
    return retail.sparsity(inter(spark, sf))


@register("A2_rec_kpis", with_(INTER) + """,
s AS (SELECT count(DISTINCT CustomerID) AS n_users, count(DISTINCT StockCode) AS n_items,
             round(1 - count(*) FILTER (WHERE purchase_count > 0)
                   / (count(DISTINCT CustomerID) * count(DISTINCT StockCode)), 6) AS sparsity FROM inter),
t AS (SELECT count(*) AS n_transactions, CAST(sum(TotalPrice) AS DOUBLE) AS rev, count(TotalPrice) AS n FROM tx)
SELECT n_users, n_items, n_transactions, sparsity, rev AS total_revenue,
       round(rev / n, 6) AS avg_order_line, round(rev * 0.05, 6) AS additional_revenue
FROM s, t""")
def a2(spark, sf):
    """A2 + X19: recommendation KPIs and revenue uplift."""
    t = tx(spark, sf)
    return retail.rec_kpis(t, retail.interactions(t, with_description=False))


@register("X20_storage_estimate", with_(INTER) + """,
s AS (SELECT count(DISTINCT CustomerID) AS n_users, count(DISTINCT StockCode) AS n_items,
             count(*) FILTER (WHERE purchase_count > 0) AS nnz FROM inter)
SELECT n_users, n_items, n_users * n_items * 4 AS dense_bytes, nnz * 12 AS sparse_bytes,
       round((1 - (nnz * 12) / (n_users * n_items * 4)) * 100, 4) AS saving_pct FROM s""")
def x20(spark, sf):
    """Dense vs sparse storage estimate."""
    return retail.storage_estimate(inter(spark, sf))


@register("A20_daily_activity", with_(TX) + """
SELECT CAST(InvoiceDate AS DATE) AS Date, count(DISTINCT InvoiceNo) AS Orders,
       CAST(sum(TotalPrice) AS DOUBLE) AS Revenue FROM tx GROUP BY 1""")
def a20(spark, sf):
    """Daily distinct orders and revenue."""
    return retail.daily_activity(tx(spark, sf))


@register("A21_customers_per_country", with_(TX) + """,
c AS (SELECT Country, count(DISTINCT CustomerID) AS UniqueCustomers FROM tx GROUP BY Country)
SELECT Country, UniqueCustomers,
       round(UniqueCustomers / (SELECT sum(UniqueCustomers) FROM c) * 100, 6) AS share_pct FROM c""")
def a21(spark, sf):
    """Customers per country and share."""
    return retail.customers_per_country(tx(spark, sf, country=True))


@register("W7_top_countries", with_(TX) + """,
c AS (SELECT Country, count(DISTINCT CustomerID) AS UniqueCustomers FROM tx GROUP BY Country)
SELECT Country, UniqueCustomers,
       round(UniqueCustomers / (SELECT sum(UniqueCustomers) FROM c) * 100, 6) AS share_pct
FROM c ORDER BY UniqueCustomers DESC, Country LIMIT 15""")
def w7(spark, sf):
    """Top 15 countries by unique customers."""
    return retail.top_countries(tx(spark, sf, country=True))


@register("A22_rfm", with_(TX) + """
SELECT CustomerID,
       (epoch_us((SELECT max(InvoiceDate) FROM tx) + INTERVAL 1 DAY) - epoch_us(max(InvoiceDate)))
         // 86400000000 AS Recency,
       count(DISTINCT InvoiceNo) AS Frequency, CAST(sum(TotalPrice) AS DOUBLE) AS Monetary
FROM tx GROUP BY CustomerID""")
def a22(spark, sf):
    """Recency / frequency / monetary per customer."""
    return retail.rfm(tx(spark, sf))


@register("A28_monthly_growth", with_(TX) + """,
fu AS (SELECT CustomerID, min(CAST(date_trunc('month', InvoiceDate) AS DATE)) AS month FROM tx GROUP BY 1),
fp AS (SELECT CustomerID, StockCode, min(CAST(date_trunc('month', InvoiceDate) AS DATE)) AS month FROM tx GROUP BY 1, 2),
m AS (SELECT DISTINCT CAST(date_trunc('month', InvoiceDate) AS DATE) AS month FROM tx),
j AS (SELECT m.month,
             (SELECT count(*) FROM fu WHERE fu.month = m.month) AS new_users,
             (SELECT count(*) FROM fp WHERE fp.month = m.month) AS new_interactions FROM m)
SELECT month, new_users, new_interactions,
       CAST(sum(new_users) OVER (ORDER BY month) AS BIGINT) AS active_users,
       CAST(sum(new_interactions) OVER (ORDER BY month) AS BIGINT) AS interactions FROM j""")
def a28(spark, sf):
    """Cumulative active users and interactions per month."""
    return retail.monthly_growth(tx(spark, sf))


@register("W13_month_plan", with_(TX) + """,
m AS (SELECT DISTINCT CAST(date_trunc('month', InvoiceDate) AS DATE) AS month FROM tx)
SELECT month, dense_rank() OVER (ORDER BY month) AS month_rank,
       CASE WHEN dense_rank() OVER (ORDER BY month) <= 6 THEN 'initial'
            WHEN dense_rank() OVER (ORDER BY month) = (SELECT count(*) FROM m) THEN 'test'
            ELSE 'stream' END AS role FROM m""")
def w13(spark, sf):
    """Month roles (initial / stream / test)."""
    return retail.month_plan(tx(spark, sf))


@register("W1_user_dim", with_(INTER) + """
SELECT CustomerID, row_number() OVER (ORDER BY CustomerID) - 1 AS user_idx
FROM (SELECT DISTINCT CustomerID FROM inter)""")
def w1(spark, sf):
    """Dense user index by sorted CustomerID."""
    return retail.user_dim(inter(spark, sf))


@register("W2_item_dim", with_(INTER) + """
SELECT StockCode, row_number() OVER (ORDER BY first_user, StockCode) - 1 AS item_idx
FROM (SELECT StockCode, min(CustomerID) AS first_user FROM inter GROUP BY StockCode)""")
def w2(spark, sf):
    """Dense item index by first appearance."""
    return retail.item_dim(inter(spark, sf))


@register("J1_indexed_interactions", with_(INTER) + """,
u AS (SELECT CustomerID, row_number() OVER (ORDER BY CustomerID) - 1 AS user_idx
      FROM (SELECT DISTINCT CustomerID FROM inter)),
i AS (SELECT StockCode, row_number() OVER (ORDER BY first_user, StockCode) - 1 AS item_idx
      FROM (SELECT StockCode, min(CustomerID) AS first_user FROM inter GROUP BY StockCode))
SELECT inter.StockCode, inter.CustomerID, purchase_count, user_idx, item_idx
FROM inter JOIN u USING (CustomerID) JOIN i USING (StockCode)""")
def j1(spark, sf):
    """Interactions with dense user and item indexes."""
    it = inter(spark, sf)
    return retail.index_interactions(it, retail.user_dim(it), retail.item_dim(it))


@register("W3_holdout_test", with_(HOLDOUT) + "SELECT * FROM test")
def w3(spark, sf):
    """Held-out (customer, item, score) rows."""
    return retail.holdout_split(inter(spark, sf))[1]


@register("W3_holdout_train", with_(HOLDOUT) + "SELECT * FROM train")
def w3t(spark, sf):
    """Training interactions after the hold-out."""
    return retail.holdout_split(inter(spark, sf))[0]


@register("A26_split_summary", with_(HOLDOUT) + """
SELECT (SELECT count(*) FROM train WHERE purchase_count > 0) AS train_nnz,
       (SELECT count(*) FROM test) AS test_rows,
       (SELECT count(DISTINCT CustomerID) FROM test) AS test_users""")
def a26(spark, sf):
    """Train non-zeros, test rows, test users."""
    return retail.split_summary(*retail.holdout_split(inter(spark, sf)))


@register("W8_matrix_sample", with_(INTER) + """,
ti AS (SELECT StockCode FROM inter GROUP BY StockCode ORDER BY sum(purchase_count) DESC, StockCode LIMIT 12),
fu AS (SELECT DISTINCT CustomerID FROM inter ORDER BY CustomerID LIMIT 8)
SELECT fu.CustomerID, ti.StockCode,
       CASE WHEN length(ti.StockCode) > 15 THEN substr(ti.StockCode, 1, 15) || '...' ELSE ti.StockCode END AS label,
       CAST(coalesce(inter.purchase_count, 0) AS BIGINT) AS quantity
FROM fu CROSS JOIN ti LEFT JOIN inter ON inter.CustomerID = fu.CustomerID AND inter.StockCode = ti.StockCode""")
def w8(spark, sf):
    """8 users x top-12 items quantity sample."""
    return retail.matrix_sample(inter(spark, sf))


@register("W9_customer_history", with_(HOLDOUT) + """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY purchase_count DESC, StockCode) AS rank
  FROM train WHERE purchase_count > 0) WHERE rank <= 15""")
def w9(spark, sf):
    """Top-15 items by quantity per customer (training data)."""
    return retail.customer_history(retail.holdout_split(inter(spark, sf))[0])


@register("W10_active_customers", with_(HOLDOUT) + """
SELECT CustomerID, count(*) AS n_products,
       format('Customer {:d} ({:d} products purchased)', CustomerID, count(*)) AS label
FROM train WHERE purchase_count > 0 GROUP BY CustomerID HAVING count(*) >= 10
ORDER BY CustomerID LIMIT 100""")
def w10(spark, sf):
    """First 100 customers with >= 10 items."""
    return retail.active_customers(retail.holdout_split(inter(spark, sf))[0])


# -- item-based collaborative filtering (flagship) ---------------------------

from basketry.operators import evaluate, itemcf  # noqa: E402
from basketry.plans.oracle_sql import ITEMCF, REC_METRICS  # noqa: E402


TX_INPUTS = ["lineitem", "orders", "part", "customer", "nation"]


def memo(spark, sf, name, params, build):
    """S6 hand-over: a table written once per (input data version, params)."""
    from basketry.sources.cache import cached_table
    return cached_table(spark, name, [f"{sf.rstrip('/')}/{t}.parquet" for t in TX_INPUTS], params, build)


def _split(spark, sf, test_ratio=0.2, seed=42):
    """Interactions and their hold-out split, each written once: every
    later step and every later query (co-occurrence, norms, scoring,
    masking, metrics, the factor models) reads these tables instead of
    re-running scan + joins + split."""
    t = tx(spark, sf)
    it = memo(spark, sf, "interactions", {}, lambda: retail.interactions(t, with_description=False))
    p = {"test_ratio": test_ratio, "seed": seed}
    flags = memo(spark, sf, "rec-split", p, lambda: retail.holdout_flags(it, test_ratio, seed))
    train, test = retail.split_from_flags(flags)
    return t, it, train, test


def itemcf_recs(spark, sf, n=10, top_k_similar=20):
    _, _, train, _ = _split(spark, sf)
    return memo(spark, sf, "itemcf-recs", {"n": n, "k": top_k_similar},
                lambda: itemcf.recommend(train, n=n, top_k_similar=top_k_similar))


@register("M12_item_neighbours", with_(ITEMCF) + """
SELECT item_i, item_j, round(sim, 9) AS sim FROM nb""")
def m12_nb(spark, sf):
    """Cosine neighbours, top 20 per item with ties."""
    _, _, train, _ = _split(spark, sf)
    nb = itemcf.neighbours(train)
    return nb.withColumn("sim", F.round("sim", 9))


@register("M12_itemcf_recommendations", with_(ITEMCF) + """
SELECT recs.CustomerID, recs.rank, recs.StockCode, recs.score,
       coalesce(descs.Description, 'N/A') AS Description
FROM recs LEFT JOIN descs ON recs.StockCode = descs.StockCode""")
def m12_recs(spark, sf):
    """Top-10 unseen items per user with descriptions."""
    t = tx(spark, sf)
    recs = itemcf_recs(spark, sf)
    return (retail.with_description(recs, retail.item_descriptions_from_lines(t))
            .select("CustomerID", "rank", "StockCode", "score", "Description"))


@register("E7_itemcf_metrics", with_(ITEMCF, REC_METRICS))
def e7(spark, sf):
    """Precision@10, Recall@10, Hit Rate, Users Evaluated for item-CF."""
    _, _, _, test = _split(spark, sf)
    return evaluate.recommendation_metrics(itemcf_recs(spark, sf), test)
