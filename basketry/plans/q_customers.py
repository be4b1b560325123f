"""Queries over the customer table: cleaning, KPIs, statistics, features,
segment profiles, classification metrics and explanation read-outs."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions.standins import demo_score, given_cluster, md5_unit
from basketry.operators import clean, evaluate, features, retail, segments, stats
from basketry.operators.clean import CATEGORICAL_COLS, NUMERIC_COLS
from basketry.plans.catalog import register
from basketry.plans.oracle_sql import CUST, CUST_RAW, DEMO_SCORE_SQL, SPLIT, TX, with_
from basketry.sources import customers_raw


def raw(spark, sf):
    return customers_raw(spark, sf)


_INPUTS = ["orders", "customer", "nation", "region", "lineitem", "events"]


def memo(spark, sf, name, params, build):
    """A table memoised by (input data version, parameters)."""
    from basketry.sources.cache import cached_table
    return cached_table(spark, name, [f"{sf.rstrip('/')}/{t}.parquet" for t in _INPUTS], params, build)


def cust(spark, sf):
    return memo(spark, sf, "customers", {}, lambda: clean.clean_customers(customers_raw(spark, sf)))


def split(spark, sf):
    return memo(spark, sf, "customer-split", {}, lambda: features.stratified_split(cust(spark, sf)))


@register("S1_customers_raw", with_(CUST_RAW) + "SELECT * FROM cust_raw")
def s1(spark, sf):
    """Customer table as read (TotalCharges text, Churn Yes/No)."""
    return raw(spark, sf)


@register("X1_clean_customers", with_(CUST) + "SELECT * FROM cust")
def x1(spark, sf):
    """Safe cast, exact median fill, Yes/No -> 1/0."""
    return cust(spark, sf)


@register("X2_blank_report", with_(CUST_RAW) + """
SELECT count(*) FILTER (WHERE trim(TotalCharges) = '') AS blank_rows, count(*) AS total_rows,
       round(count(*) FILTER (WHERE trim(TotalCharges) = '') / count(*) * 100, 4) AS blank_pct
FROM cust_raw""")
def x2(spark, sf):
    """Blank TotalCharges count and share."""
    return clean.blank_report(raw(spark, sf))[0]


@register("X2_blank_sample", with_(CUST_RAW) + """
SELECT customerID, tenure, MonthlyCharges, TotalCharges, Churn FROM cust_raw
WHERE trim(TotalCharges) = '' ORDER BY customerID LIMIT 10""")
def x2s(spark, sf):
    """First 10 rows with blank TotalCharges."""
    return clean.blank_report(raw(spark, sf))[1]


@register("A10_skew_evidence", with_(CUST_RAW) + """
SELECT round(avg(TRY_CAST(TotalCharges AS DOUBLE)), 6) AS mean,
       round(median(TRY_CAST(TotalCharges AS DOUBLE)), 6) AS median,
       min(TRY_CAST(TotalCharges AS DOUBLE)) AS min, max(TRY_CAST(TotalCharges AS DOUBLE)) AS max
FROM cust_raw""")
def a10(spark, sf):
    """A10: mean, median, min, max of raw TotalCharges."""
    return clean.skew_evidence(raw(spark, sf))


@register("X13_churn_filter", with_(CUST) + """
SELECT * FROM cust WHERE Churn = 1 ORDER BY customerID LIMIT 200""")
def x13(spark, sf):
    """Churned subset, first 200 by id."""
    return clean.churn_filter(cust(spark, sf), "Churned")[0]


@register("W17_preview", with_(CUST_RAW) + "SELECT * FROM cust_raw ORDER BY customerID LIMIT 5")
def w17(spark, sf):
    """First rows preview (ordered by id)."""
    return raw(spark, sf).orderBy("customerID").limit(5)


@register("A1_churn_kpis", with_(CUST) + """
SELECT count(*) AS total_customers, round(avg(Churn), 6) + 0.0 AS churn_rate,
       CAST(sum(Churn) AS BIGINT) AS churned, round(avg(MonthlyCharges), 6) + 0.0 AS avg_monthly,
       round(sum(CASE WHEN Churn = 1 THEN MonthlyCharges END) * 12, 6) + 0.0 AS revenue_at_risk,
       round(sum(CASE WHEN Churn = 1 THEN MonthlyCharges END) * 12 * 0.1, 6) + 0.0 AS savings,
       CAST(sum(Churn) AS BIGINT) * 65 * 12 AS flat_churn_cost
FROM cust""")
def a1(spark, sf):
    """Churn KPIs and savings projection."""
    return stats.churn_kpis(cust(spark, sf))


@register("A3_churn_distribution", with_(CUST) + """
SELECT Churn, CASE WHEN Churn = 0 THEN 'Retained' WHEN Churn = 1 THEN 'Churned' END AS Label,
       count(*) AS Count, round(count(*) / (SELECT count(*) FROM cust), 6) + 0.0 AS share
FROM cust GROUP BY Churn""")
def a3(spark, sf):
    """Churn counts, shares and labels."""
    return stats.churn_distribution(cust(spark, sf))


_CAT_UNION = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, Churn FROM cust" for c in CATEGORICAL_COLS)


@register("A4_churn_rate_by_category", with_(CUST) + f"""
SELECT feature, value, round(avg(Churn) * 100, 1) AS churn_rate_pct
FROM ({_CAT_UNION}) GROUP BY feature, value""")
def a4(spark, sf):
    """A4: churn rate (%) per value of every categorical."""
    return stats.churn_rate_by(cust(spark, sf), CATEGORICAL_COLS)


def _hist_sql(src: str, col: str, bins: int, by: str | None = None) -> str:
    by_sel = f", {by}" if by else ""
    return f"""
, hb AS (SELECT min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM {src}),
hv AS (SELECT CAST(CASE WHEN (hi - lo) / {bins} = 0 THEN 0
                   ELSE least(floor((CAST({col} AS DOUBLE) - lo) / ((hi - lo) / {bins})), {bins - 1}) END AS INTEGER) AS bin,
              lo, hi{by_sel}
       FROM {src}, hb WHERE {col} IS NOT NULL)
SELECT bin{by_sel}, count(*) AS count,
       round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / {bins}), 6) + 0.0 AS bin_start,
       round(any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / {bins}), 6) + 0.0 AS bin_end
FROM hv GROUP BY bin{by_sel}"""


@register("A5_tenure_histogram_by_churn", with_(CUST) + _hist_sql("cust", "tenure", 20, "Churn"))
def a5(spark, sf):
    """A5: tenure histogram (20 bins) by churn label."""
    return stats.histogram(cust(spark, sf), "tenure", 20, by="Churn")


@register("A6_products_histogram", with_(TX) + """,
pc AS (SELECT CustomerID, count(DISTINCT StockCode) AS UniqueProducts FROM tx GROUP BY CustomerID)"""
          + _hist_sql("pc", "UniqueProducts", 60))
def a6(spark, sf):
    """Histogram of unique products per customer (60 bins)."""
    from basketry.plans.q_retail import tx
    return stats.histogram(retail.products_per_customer(tx(spark, sf)), "UniqueProducts", 60)


def _hist_block(name: str, src: str, col: str, bins: int, stage: str) -> str:
    return f"""
{name}_b AS (SELECT min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM {src}),
{name}_v AS (SELECT CAST(CASE WHEN (hi - lo) / {bins} = 0 THEN 0
                 ELSE least(floor((CAST({col} AS DOUBLE) - lo) / ((hi - lo) / {bins})), {bins - 1}) END AS INTEGER) AS bin,
                 lo, hi FROM {src}, {name}_b WHERE {col} IS NOT NULL),
{name} AS (SELECT '{stage}' AS stage, bin, count(*) AS count,
       round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / {bins}), 6) + 0.0 AS bin_start,
       round(any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / {bins}), 6) + 0.0 AS bin_end
       FROM {name}_v GROUP BY bin)"""


@register("A7_scaling_histograms", with_(CUST) + """,
sc AS (SELECT CASE WHEN stddev_pop(TotalCharges) OVER () = 0 THEN TotalCharges - avg(TotalCharges) OVER ()
              ELSE (TotalCharges - avg(TotalCharges) OVER ()) / stddev_pop(TotalCharges) OVER () END AS TotalCharges
       FROM cust),""" + _hist_block("h_raw", "cust", "TotalCharges", 40, "raw") + ","
          + _hist_block("h_sc", "sc", "TotalCharges", 40, "scaled")
          + "\nSELECT * FROM h_raw UNION ALL SELECT * FROM h_sc")
def a7(spark, sf):
    """TotalCharges histogram before and after standard scaling."""
    return stats.scaling_histograms(cust(spark, sf))


_CORR_COLS = NUMERIC_COLS + ["Churn"]


@register("A8_correlation", with_(CUST) + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) + 0.0 AS corr FROM cust"
    for a in _CORR_COLS for b in _CORR_COLS))
def a8(spark, sf):
    """Pearson correlation matrix (long form)."""
    return stats.correlation(cust(spark, sf), _CORR_COLS)


@register("A9_describe", with_(CUST) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 2) + 0.0 AS mean, "
    f"round(stddev_samp(CAST({c} AS DOUBLE)), 2) + 0.0 AS std, round(min(CAST({c} AS DOUBLE)), 2) + 0.0 AS min, "
    f"round(max(CAST({c} AS DOUBLE)), 2) + 0.0 AS max FROM cust" for c in NUMERIC_COLS))
def a9(spark, sf):
    """Mean, sample std, min, max of the numeric columns."""
    return stats.describe(cust(spark, sf), NUMERIC_COLS)


@register("A11_scaled_mean_std", with_(CUST) + """,
sc AS (SELECT (TotalCharges - avg(TotalCharges) OVER ()) / stddev_pop(TotalCharges) OVER () AS z FROM cust)
SELECT round(avg(z), 6) + 0.0 AS mean, round(stddev_pop(z), 6) + 0.0 AS std FROM sc""")
def a11(spark, sf):
    """Mean and population std after scaling (expect 0 and 1)."""
    return stats.mean_std(stats.standardize(cust(spark, sf), ["TotalCharges"]), "TotalCharges")


# -- features ----------------------------------------------------------------

_LABEL_MAP_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM cust" for c in CATEGORICAL_COLS)
MAPPING = CUST + f""",
mapping AS (SELECT feature, value, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS code
            FROM ({_LABEL_MAP_SQL}))"""


@register("F1_label_mapping", with_(MAPPING) + "SELECT * FROM mapping")
def f1(spark, sf):
    """alphabetical label codes per categorical."""
    return features.label_mapping(cust(spark, sf))


@register("F1_label_encoded", with_(MAPPING) + "SELECT customerID, " + ", ".join(
    f"coalesce((SELECT code FROM mapping m WHERE m.feature = '{c}' AND m.value = CAST(cust.{c} AS VARCHAR)), 0) AS {c}"
    for c in CATEGORICAL_COLS) + ", debt_flag, tenure, MonthlyCharges, TotalCharges, Churn FROM cust")
def f1e(spark, sf):
    """customer table with categoricals replaced by codes."""
    c = cust(spark, sf)
    return features.label_encode(c, features.label_mapping(c)).select(
        "customerID", *CATEGORICAL_COLS, *NUMERIC_COLS, "Churn")


ONEHOT = MAPPING + """,
ohc AS (SELECT feature, value, feature || '_' || value AS dummy,
               CAST(row_number() OVER (ORDER BY feature, value) - 1 AS INTEGER) AS position
        FROM mapping WHERE code > 0)"""


@register("F2_onehot_columns", with_(ONEHOT) + "SELECT * FROM ohc")
def f2(spark, sf):
    """dummy columns, first class of each feature dropped."""
    return features.onehot_columns(features.label_mapping(cust(spark, sf)))


@register("F2_onehot_sample", with_(ONEHOT) + """,
first6 AS (SELECT customerID, top_priority FROM cust ORDER BY customerID LIMIT 6)
SELECT customerID, dummy, CAST(top_priority = value AS INTEGER) AS value
FROM first6, (SELECT value, dummy FROM ohc WHERE feature = 'top_priority')""")
def f2s(spark, sf):
    """one-hot view of top_priority for the first 6 customers."""
    c = cust(spark, sf)
    first6 = c.orderBy("customerID").limit(6)
    return features.onehot_long(first6, features.label_mapping(c), "top_priority")


@register("F3_stratified_split", with_(SPLIT) + "SELECT customerID, Churn, split FROM split")
def f3(spark, sf):
    """stratified 80/20 split by md5 order."""
    return split(spark, sf).select("customerID", "Churn", "split")


@register("A25_split_summary", with_(SPLIT) + """
SELECT split, count(*) AS rows, round(avg(Churn), 6) + 0.0 AS churn_rate FROM split GROUP BY split""")
def a25(spark, sf):
    """Rows and churn rate per split side."""
    return stats.split_summary(split(spark, sf))


def _scaled_sql(fit_filter: str) -> str:
    parts = []
    for c in NUMERIC_COLS:
        m = f"(SELECT avg(CAST({c} AS DOUBLE)) FROM split {fit_filter})"
        s = f"(SELECT stddev_pop(CAST({c} AS DOUBLE)) FROM split {fit_filter})"
        parts.append(f"round(CASE WHEN {s} = 0 THEN {c} - {m} ELSE ({c} - {m}) / {s} END, 6) + 0.0 AS {c}")
    return ", ".join(parts)


@register("F4_scaled_train_test", with_(SPLIT) + "SELECT customerID, split, " +
          _scaled_sql("WHERE split = 'train'") + " FROM split")
def f4(spark, sf):
    """standard scaling fit on the training side, applied to both."""
    sp = split(spark, sf)
    out = stats.standardize(sp, NUMERIC_COLS, fit_on=sp.filter(F.col("split") == "train"),
                            keep=["customerID", "split"])
    return out.select("customerID", "split", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in NUMERIC_COLS])


@register("F5_scaled_preview", with_(SPLIT) + "SELECT customerID, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}_raw" for c in NUMERIC_COLS) + ", " +
          _scaled_sql("").replace(" AS debt_flag", " AS debt_flag_scaled").replace(" AS tenure", " AS tenure_scaled")
          .replace(" AS MonthlyCharges", " AS MonthlyCharges_scaled").replace(" AS TotalCharges", " AS TotalCharges_scaled")
          + " FROM split ORDER BY customerID LIMIT 8")
def f5(spark, sf):
    """scaling fit on all rows; first 8 rows before and after."""
    c = cust(spark, sf)
    sc = stats.standardize(c, NUMERIC_COLS, keep=["customerID"] + [F.col(x).cast("double").alias(f"{x}_raw")
                                                                  for x in NUMERIC_COLS])
    return sc.select("customerID", *[f"{x}_raw" for x in NUMERIC_COLS],
                     *[(F.round(x, 6) + F.lit(0.0)).alias(f"{x}_scaled") for x in NUMERIC_COLS]) \
             .orderBy("customerID").limit(8)


MINIBATCH = SPLIT + """,
tr AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'stream', customerID)), customerID) AS stream_order,
              count(*) OVER () AS n FROM split WHERE split = 'train'),
mb AS (SELECT customerID, stream_order,
              CAST(CASE WHEN stream_order <= CAST(floor(n * 0.6) AS BIGINT) THEN 0
                   ELSE least(floor((stream_order - CAST(floor(n * 0.6) AS BIGINT) - 1)
                              / greatest(floor((n - CAST(floor(n * 0.6) AS BIGINT)) / 15), 1)), 14) + 1 END AS INTEGER) AS batch_id
       FROM tr)"""


@register("W14_minibatches", with_(MINIBATCH) + "SELECT * FROM mb")
def w14(spark, sf):
    """Stream order and batch of every training row."""
    train = split(spark, sf).filter(F.col("split") == "train")
    return features.minibatches(train).select("customerID", "stream_order", "batch_id")


@register("T6_minibatch_progress", with_(MINIBATCH) + """
SELECT batch_id, count(*) AS batch_rows,
       CAST(sum(count(*)) OVER (ORDER BY batch_id) AS BIGINT) AS samples_processed
FROM mb GROUP BY batch_id""")
def t6(spark, sf):
    """Batch sizes and samples processed so far (bounded window over
    one row per batch)."""
    from pyspark.sql import Window
    train = split(spark, sf).filter(F.col("split") == "train")
    per = features.minibatches(train).groupBy("batch_id").agg(F.count(F.lit(1)).alias("batch_rows"))
    return per.withColumn("samples_processed",
                          F.sum("batch_rows").over(Window.orderBy("batch_id")))


@register("W16_demo_picks", with_(SPLIT) + """
SELECT * EXCLUDE (split), split FROM (
  (SELECT * FROM split WHERE split = 'test' AND Churn = 1
   ORDER BY md5(concat_ws('|', '42', customerID)), customerID LIMIT 3)
  UNION ALL
  (SELECT * FROM split WHERE split = 'test' AND Churn = 0
   ORDER BY md5(concat_ws('|', '42', customerID)), customerID LIMIT 2))""")
def w16(spark, sf):
    """First 3 churned and first 2 retained test customers."""
    return features.demo_picks(split(spark, sf))


# -- stand-in model output: metrics ------------------------------------------

SCORED = SPLIT + f""",
scored AS (SELECT customerID, Churn AS label, {DEMO_SCORE_SQL} AS score,
                  CASE WHEN {DEMO_SCORE_SQL} >= 0.5 THEN 1 ELSE 0 END AS prediction
           FROM split WHERE split = 'test')"""


def scored(spark, sf):
    s = demo_score()
    return (split(spark, sf).filter(F.col("split") == "test")
            .select("customerID", F.col("Churn").alias("label"), s.alias("score"),
                    F.when(s >= 0.5, 1).otherwise(0).alias("prediction")))


@register("E1_classification_metrics", with_(SCORED) + """,
c AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
             count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
             count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
             count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM scored)
SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM c""")
def e1(spark, sf):
    """Accuracy, precision, recall, F1 of a scored test set."""
    return evaluate.classification_metrics(scored(spark, sf))


@register("E2_auc", with_(SCORED) + """,
sc AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
       FROM scored GROUP BY score),
cum AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS below FROM sc)
SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM cum""")
def e2(spark, sf):
    """Tie-aware ROC AUC."""
    return evaluate.auc(scored(spark, sf))


@register("E3_roc_points", with_(SCORED) + """,
sc AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
       FROM scored GROUP BY score)
SELECT score,
       round(sum(pos) OVER (ORDER BY score DESC) / (SELECT count(*) FILTER (WHERE label = 1) FROM scored), 6) AS tpr,
       round(sum(neg) OVER (ORDER BY score DESC) / (SELECT count(*) FILTER (WHERE label = 0) FROM scored), 6) AS fpr
FROM sc""")
def e3(spark, sf):
    """ROC curve, one point per distinct score."""
    return evaluate.roc_points(scored(spark, sf))


@register("E4_confusion", with_(SCORED) + """
SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS actual_0_pred_0,
       count(*) FILTER (WHERE label = 0 AND prediction = 1) AS actual_0_pred_1,
       count(*) FILTER (WHERE label = 1 AND prediction = 0) AS actual_1_pred_0,
       count(*) FILTER (WHERE label = 1 AND prediction = 1) AS actual_1_pred_1 FROM scored""")
def e4(spark, sf):
    """2x2 confusion counts."""
    return evaluate.confusion(scored(spark, sf))


@register("E5_log_loss", with_(SCORED) + """
SELECT round(avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15))
                 + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))), 6) AS log_loss
FROM scored""")
def e5(spark, sf):
    """E5: log loss of a scored test set."""
    return evaluate.log_loss(scored(spark, sf))


@register("X16_risk_bands", with_(SCORED) + """
SELECT customerID, round(score, 6) AS score,
       CASE WHEN score < 0.3 THEN 'Low' WHEN score < 0.6 THEN 'Medium' ELSE 'High' END AS band
FROM scored""")
def x16(spark, sf):
    """Churn probability to risk band."""
    from basketry.functions.exprs import risk_band
    s = scored(spark, sf)
    return s.select("customerID", F.round("score", 6).alias("score"), risk_band("score").alias("band"))


_MODELS = ["Logistic Regression", "Random Forest", "Gradient Boosted Trees"]
_PRED_UNION = " UNION ALL ".join(
    f"SELECT customerID, '{m}' AS model, label, CASE WHEN 0.5 * label + 0.5 * "
    f"(CAST(('0x' || substr(md5('{m}|' || customerID), 1, 8)) AS BIGINT) / 4294967296.0) >= 0.5 "
    f"THEN 1 ELSE 0 END AS prediction FROM scored" for m in _MODELS)


def long_preds(spark, sf):
    s = scored(spark, sf)
    parts = []
    for m in _MODELS:
        p = F.lit(0.5) * F.col("label") + F.lit(0.5) * md5_unit(m, "customerID")
        parts.append(s.select("customerID", F.lit(m).alias("model"), "label",
                              F.when(p >= 0.5, 1).otherwise(0).alias("prediction")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("A29_verdict_counts", with_(SCORED) + f""",
lp AS ({_PRED_UNION}),
per AS (SELECT customerID, min(CAST(label = prediction AS INTEGER)) AS mn,
               max(CAST(label = prediction AS INTEGER)) AS mx FROM lp GROUP BY customerID)
SELECT CASE WHEN mn = 1 THEN 'all correct' WHEN mx = 0 THEN 'all wrong' ELSE 'mixed' END AS verdict,
       count(*) AS customers FROM per GROUP BY 1""")
def a29(spark, sf):
    """All-correct / mixed / all-wrong counts across models."""
    return evaluate.verdicts(long_preds(spark, sf))


@register("E8_prediction_grid", with_(SCORED) + f""",
lp AS ({_PRED_UNION})
SELECT customerID, label, """ + ", ".join(
    f"max(CASE WHEN model = '{m}' THEN prediction END) AS \"{m}\"" for m in _MODELS) + """
FROM lp GROUP BY customerID, label""")
def e8(spark, sf):
    """Per-customer prediction of each model beside the label."""
    return evaluate.prediction_grid(long_preds(spark, sf), _MODELS)


# -- stand-in cluster assignments: profiles and ladders ------------------------

from basketry.operators import explain  # noqa: E402
from basketry.plans.oracle_sql import TX as _TX  # noqa: E402


def churn_given(spark, sf):
    return cust(spark, sf).withColumn("cluster", given_cluster("customerID"))


_CHURN_PROFILE_SQL = CUST + """,
cp AS (SELECT CAST(CAST(customerID AS BIGINT) % 4 AS INTEGER) AS cluster, count(*) AS size,
              avg(Churn) AS churn_rate, avg(tenure) AS avg_tenure, avg(MonthlyCharges) AS avg_monthly,
              avg(TotalCharges) AS avg_total, avg(debt_flag) AS senior_pct
       FROM cust GROUP BY 1)"""


@register("A23_churn_cluster_profile", with_(_CHURN_PROFILE_SQL) + """
SELECT cluster, size, round(churn_rate, 6) + 0.0 AS churn_rate, round(avg_tenure, 6) + 0.0 AS avg_tenure,
       round(avg_monthly, 6) + 0.0 AS avg_monthly, round(avg_total, 6) + 0.0 AS avg_total,
       round(senior_pct, 6) + 0.0 AS senior_pct,
       CASE WHEN avg_tenure < 20 AND churn_rate > 0.3 THEN 'New & High-Risk'
            WHEN avg_tenure > 40 AND churn_rate < 0.15 THEN 'Loyal Veterans'
            WHEN avg_monthly > 70 AND churn_rate > 0.25 THEN 'Premium At-Risk'
            WHEN avg_monthly < 40 THEN 'Budget Customers'
            WHEN senior_pct > 0.3 THEN 'Senior Segment' ELSE 'Mid-Tier' END AS label
FROM cp""")
def a23(spark, sf):
    """Churn cluster profile and segment label (given clusters)."""
    return segments.churn_profile(churn_given(spark, sf))


@register("W15_churn_extremes", with_(_CHURN_PROFILE_SQL) + """
SELECT arg_min(cluster, (-churn_rate, cluster)) AS highest_churn_cluster,
       arg_min(cluster, (churn_rate, cluster)) AS lowest_churn_cluster FROM cp""")
def w15c(spark, sf):
    """Highest / lowest churn cluster, first wins ties."""
    p = churn_given(spark, sf).groupBy("cluster").agg(F.avg("Churn").alias("churn_rate"))
    return segments.churn_extremes(p)


def rfm_given(spark, sf):
    from basketry.plans.q_retail import tx
    return retail.rfm(tx(spark, sf)).withColumn("cluster", given_cluster("CustomerID"))


_RFM_SQL = _TX + """,
rfm AS (SELECT CustomerID,
          (epoch_us((SELECT max(InvoiceDate) FROM tx) + INTERVAL 1 DAY) - epoch_us(max(InvoiceDate))) // 86400000000 AS Recency,
          count(DISTINCT InvoiceNo) AS Frequency, CAST(sum(TotalPrice) AS DOUBLE) AS Monetary
        FROM tx GROUP BY CustomerID),
med AS (SELECT median(Recency) AS mr, median(Frequency) AS mf, median(Monetary) AS mm FROM rfm),
rp AS (SELECT CAST(CustomerID % 4 AS INTEGER) AS cluster, count(*) AS size, avg(Recency) AS recency,
              avg(Frequency) AS frequency, avg(Monetary) AS monetary FROM rfm GROUP BY 1)"""


@register("A24_rfm_cluster_profile", with_(_RFM_SQL) + """
SELECT cluster, size, round(recency, 6) + 0.0 AS recency, round(frequency, 6) + 0.0 AS frequency,
       round(monetary, 6) + 0.0 AS monetary,
       CASE WHEN frequency > mf * 2 AND monetary > mm * 2 THEN 'VIP / Champions'
            WHEN recency > mr * 1.5 AND frequency > mf THEN 'At-Risk (were active)'
            WHEN frequency <= 2 AND monetary < mm THEN 'One-Timers'
            WHEN recency < mr AND frequency > mf THEN 'Loyal Regulars'
            WHEN monetary > mm THEN 'Big Spenders' ELSE 'Casual Shoppers' END AS label
FROM rp, med""")
def a24(spark, sf):
    """RFM cluster profile and segment label (given clusters)."""
    return segments.rfm_profile(rfm_given(spark, sf))


@register("W15_rfm_extremes", with_(_RFM_SQL) + """
SELECT arg_min(cluster, (-monetary, cluster)) AS most_valuable_cluster,
       arg_min(cluster, (-recency, cluster)) AS highest_risk_cluster FROM rp""")
def w15r(spark, sf):
    """Most valuable and most dormant RFM cluster."""
    r = rfm_given(spark, sf)
    p = r.groupBy("cluster").agg(F.avg("Monetary").alias("monetary"), F.avg("Recency").alias("recency"))
    return segments.rfm_extremes(p)


_SEG = segments.CHURN_SEGMENT_FEATURES
_Z = ", ".join(f"CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) OVER () = 0 THEN 0.0 ELSE "
               f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / stddev_pop(CAST({c} AS DOUBLE)) OVER () END AS {c}"
               for c in _SEG)
_CENTROID_SQL = CUST + f""",
z AS (SELECT CAST(CAST(customerID AS BIGINT) % 4 AS INTEGER) AS cluster, {_Z} FROM cust),
cz AS (SELECT cluster, {", ".join(f"avg({c}) AS {c}" for c in _SEG)} FROM z GROUP BY cluster)"""


def _centroids_given(spark, sf):
    c = churn_given(spark, sf)
    return c, segments.member_means(segments.scaled_vectors(c, _SEG), _SEG)


@register("M7_centroids_given", with_(_CENTROID_SQL) + "SELECT cluster, " + ", ".join(
    f"round({c}, 6) + 0.0 AS {c}" for c in _SEG) + " FROM cz")
def m7(spark, sf):
    """M7: scaled-space centroids as member means (given clusters)."""
    return _centroids_given(spark, sf)[1]


@register("F7_centroids_original", with_(_CENTROID_SQL) + "SELECT cluster, " + ", ".join(
    f"round(round({c}, 6) * (SELECT stddev_pop(CAST({c} AS DOUBLE)) FROM cust) + "
    f"(SELECT avg(CAST({c} AS DOUBLE)) FROM cust), {dict(tenure=1, TotalCharges=0).get(c, 2)}) + 0.0 AS {c}" for c in _SEG) + " FROM cz")
def f7(spark, sf):
    """centroids back in original units, rounded per column."""
    c, cz = _centroids_given(spark, sf)
    return features.inverse_scale(cz, c, _SEG)


# -- explanation read-outs over linear attributions ----------------------------

_UNIT_W = [1.0, 1.0, 1.0, 1.0]
_CONTRIB_SQL = SPLIT + """,
te AS (SELECT * FROM split WHERE split = 'test'),
contrib AS (""" + " UNION ALL ".join(
    f"SELECT customerID, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, "
    f"1.0 * (CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM te)) AS contribution FROM te"
    for c in NUMERIC_COLS) + ")"


def contributions(spark, sf):
    te = split(spark, sf).filter(F.col("split") == "test")
    return explain.linear_contributions(te, "customerID", NUMERIC_COLS, _UNIT_W, 0.0)


@register("E10_global_importance", with_(_CONTRIB_SQL) + """
SELECT feature, round(avg(abs(contribution)), 6) + 0.0 AS mean_abs FROM contrib
GROUP BY feature ORDER BY mean_abs DESC, feature LIMIT 15""")
def e10(spark, sf):
    """Mean |contribution| per feature (unit-weight linear scorer)."""
    return explain.global_importance(contributions(spark, sf))


@register("E11_contribution_spread", with_(_CONTRIB_SQL) + """
SELECT feature, round(quantile_cont(contribution, 0.25), 6) + 0.0 AS p25,
       round(median(contribution), 6) + 0.0 AS median, round(quantile_cont(contribution, 0.75), 6) + 0.0 AS p75,
       round(min(contribution), 6) + 0.0 AS min, round(max(contribution), 6) + 0.0 AS max,
       round(avg(value), 6) + 0.0 AS mean_value
FROM contrib GROUP BY feature""")
def e11(spark, sf):
    """Contribution quartiles per feature."""
    return explain.contribution_spread(contributions(spark, sf))


@register("E12_waterfall", with_(_CONTRIB_SQL) + """,
one AS (SELECT * FROM contrib WHERE customerID = (SELECT min(customerID) FROM te)),
rk AS (SELECT *, row_number() OVER (ORDER BY abs(contribution) DESC, feature) AS rank FROM one)
SELECT customerID, feature, round(contribution, 6) + 0.0 AS contribution, rank FROM rk WHERE rank <= 3
UNION ALL
SELECT any_value(customerID), 'other features', round(sum(contribution), 6) + 0.0, 4 FROM rk WHERE rank > 3""")
def e12(spark, sf):
    """Waterfall of the first test customer: top 3 + remainder."""
    te = split(spark, sf).filter(F.col("split") == "test")
    first = te.select(F.min("customerID")).scalar()
    c = contributions(spark, sf).filter(F.col("customerID") == first)
    return explain.waterfall(c, "customerID", top=3)


# -- run read-outs over the monthly growth history -----------------------------

_GROWTH_SQL = _TX + """,
fu AS (SELECT CustomerID, min(CAST(date_trunc('month', InvoiceDate) AS DATE)) AS month FROM tx GROUP BY 1),
fp AS (SELECT CustomerID, StockCode, min(CAST(date_trunc('month', InvoiceDate) AS DATE)) AS month FROM tx GROUP BY 1, 2),
m AS (SELECT DISTINCT CAST(date_trunc('month', InvoiceDate) AS DATE) AS month FROM tx),
j AS (SELECT m.month, (SELECT count(*) FROM fu WHERE fu.month = m.month) AS new_users,
             (SELECT count(*) FROM fp WHERE fp.month = m.month) AS new_interactions FROM m),
g AS (SELECT month, CAST(sum(new_users) OVER (ORDER BY month) AS DOUBLE) AS active_users,
             CAST(sum(new_interactions) OVER (ORDER BY month) AS DOUBLE) AS interactions FROM j)"""


def growth(spark, sf):
    from basketry.plans.q_retail import tx
    return (retail.monthly_growth(tx(spark, sf))
            .select("month", F.col("active_users").cast("double").alias("active_users"),
                    F.col("interactions").cast("double").alias("interactions")))


@register("W11_monthly_deltas", with_(_GROWTH_SQL) + """
SELECT month, active_users, interactions,
       round(active_users - lag(active_users) OVER (ORDER BY month), 6) AS active_users_delta,
       round(interactions - lag(interactions) OVER (ORDER BY month), 6) AS interactions_delta FROM g""")
def w11(spark, sf):
    """Change against the previous step of a metric history."""
    return evaluate.metric_deltas(growth(spark, sf), "month", ["active_users", "interactions"])


@register("E13_growth_readout", with_(_GROWTH_SQL) + """
SELECT arg_min(active_users, month) AS active_users_initial, arg_max(active_users, month) AS active_users_final,
       arg_min(interactions, month) AS interactions_initial, arg_max(interactions, month) AS interactions_final,
       round(arg_max(active_users, month) - arg_min(active_users, month), 6) AS active_users_change,
       round(arg_max(interactions, month) - arg_min(interactions, month), 6) AS interactions_change FROM g""")
def e13(spark, sf):
    """Initial, final and change over a metric history."""
    return evaluate.run_readout(growth(spark, sf), "month", ["active_users", "interactions"])


@register("J6_customer_lookup", with_(SPLIT) + """
SELECT customerID, CASE WHEN split = 'test' THEN 'test' WHEN split = 'train' THEN 'train' ELSE 'all' END AS source,
       tenure, MonthlyCharges, TotalCharges, Churn FROM split""")
def j6(spark, sf):
    """Customer lookup with precedence test -> train -> all rows."""
    sp = split(spark, sf)
    src = (F.when(F.col("split") == "test", "test").when(F.col("split") == "train", "train")
            .otherwise("all"))
    return sp.select("customerID", src.alias("source"), "tenure", "MonthlyCharges", "TotalCharges", "Churn")
