"""Model queries (rows-only checks): classifiers, segments, recommenders.

These fit iterative Spark ML / DataFrame algorithms, so there is no SQL
oracle; the tests check invariants instead (see tests/test_models.py).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import churn, evaluate, explain, factor, features, itemcf, retail, segments
from basketry.plans.catalog import register
from basketry.plans.oracle_sql import SPLIT, with_
from basketry.plans.q_customers import cust, memo as customer_memo, split
from basketry.plans.q_retail import tx

NMF_ITERS = 200  # most rounds; a tolerance ends it earlier


def _train_test(spark, sf):
    sp = split(spark, sf)
    return sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test")


_CUSTOMER_INPUTS = ["orders", "customer", "nation", "region", "lineitem", "events"]


def _model(spark, sf, name, fit, **params):
    """Fitted model memoised by (input data version, parameters).  Codes
    come from the whole table, as the reference fits its encoders before the
    split."""
    from basketry.sources.cache import cached_model
    inputs = [f"{sf.rstrip('/')}/{t}.parquet" for t in _CUSTOMER_INPUTS]
    return cached_model(spark, name, inputs, params, lambda: fit(
        _train_test(spark, sf)[0], features.class_lists(cust(spark, sf)), **params))


def lr_model(spark, sf):
    return _model(spark, sf, "lr", churn.logistic_regression, max_iter=2000)


def rf_model(spark, sf):
    """Not memoised: its only reader, ``predictions``, is."""
    return churn.random_forest(_train_test(spark, sf)[0], features.class_lists(cust(spark, sf)),
                               num_trees=200, max_depth=30, seed=42)


def gbt_model(spark, sf):
    return _model(spark, sf, "gbt", churn.gradient_boosting, max_iter=200, max_depth=5, step=0.1, seed=42)


# The classifiers in the reference's order, with their encoding.
MODELS = {"Logistic Regression": "one-hot", "Random Forest": "label", "Gradient Boosted Trees": "label"}
_FITTED = {"Logistic Regression": lr_model, "Random Forest": rf_model, "Gradient Boosted Trees": gbt_model}


def predictions(spark, sf, model):
    """M4: (customerID, label, prediction, score) of the test side, kept for
    the read-outs that share it."""
    return customer_memo(spark, sf, f"predictions-{list(MODELS).index(model)}", {},
                         lambda: churn.predict(_FITTED[model](spark, sf), _train_test(spark, sf)[1]))


def long_predictions(spark, sf):
    out = None
    for name in MODELS:
        one = predictions(spark, sf, name).select("customerID", F.lit(name).alias("model"), "label", "prediction", "score")
        out = one if out is None else out.unionByName(one)
    return out


@register("M1_lr_predictions")
def m1(spark, sf):
    """M1/M4: logistic regression (one-hot) predictions on the test side."""
    return predictions(spark, sf, "Logistic Regression")


@register("M2_rf_predictions")
def m2(spark, sf):
    """M2/M4: random forest (200 trees) predictions on the test side."""
    return predictions(spark, sf, "Random Forest")


@register("M3_gbt_predictions")
def m3(spark, sf):
    """M3/M4: gradient-boosted trees (200 x depth 5) on the test side."""
    return predictions(spark, sf, "Gradient Boosted Trees")


@register("E6_model_comparison")
def e6(spark, sf):
    """Metrics of the three classifiers with their encoding."""
    return churn.compare({m: predictions(spark, sf, m) for m in MODELS}, MODELS)


@register("W15_best_model")
def w15m(spark, sf):
    """The best classifier by AUC; the first listed wins ties."""
    return churn.best_model(e6(spark, sf), list(MODELS))


@register("E3_model_roc")
def e3m(spark, sf):
    """ROC points of the three fitted classifiers, (0, 0) first."""
    out = None
    for m in MODELS:
        one = evaluate.roc_points(predictions(spark, sf, m), start=True).select(F.lit(m).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("E4_model_confusion")
def e4m(spark, sf):
    """Confusion counts of the three fitted classifiers."""
    out = None
    for m in MODELS:
        one = evaluate.confusion(predictions(spark, sf, m)).select(F.lit(m).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("A29_model_verdicts")
def a29m(spark, sf):
    """Customers that all, some or none of the fitted classifiers
    get right."""
    return evaluate.verdicts(long_predictions(spark, sf))


@register("E8_model_grid")
def e8m(spark, sf):
    """Predictions of the fitted classifiers side by side, with verdict."""
    return evaluate.verdict_grid(long_predictions(spark, sf), list(MODELS))


@register("E9_lr_contributions")
def e9(spark, sf):
    """Exact linear attributions per customer and one-hot slot."""
    tr, te = _train_test(spark, sf)
    return churn.lr_contributions(lr_model(spark, sf), te, tr)


@register("E10_lr_importance")
def e10lr(spark, sf):
    """E10 over the fitted model's attributions: top-15 mean |contribution|."""
    return explain.global_importance(e9(spark, sf))


def gbt_contributions(spark, sf):
    """E9 of the boosted trees over all customers, with their split."""
    return customer_memo(spark, sf, "gbt-contributions", {}, lambda: churn.gbt_contributions(
        gbt_model(spark, sf), split(spark, sf), ["customerID", "split"]))


@register("E9_gbt_contributions")
def e9g(spark, sf):
    """Exact path-dependent tree attributions per customer and feature."""
    return gbt_contributions(spark, sf)


@register("E10_gbt_importance")
def e10g(spark, sf):
    """Top-15 mean |contribution| of the boosted trees, training side."""
    return explain.global_importance(gbt_contributions(spark, sf).filter("split = 'train'"))


@register("E11_gbt_spread")
def e11g(spark, sf):
    """Quartiles of the boosted trees' contributions, training side."""
    return explain.contribution_spread(gbt_contributions(spark, sf).filter("split = 'train'"))


@register("E12_gbt_waterfall")
def e12g(spark, sf):
    """For every customer the 12 largest contributions of the boosted
    trees and the rest summed."""
    return explain.waterfall(gbt_contributions(spark, sf), "customerID", top=12)


def _scenarios(spark, sf):
    te = _train_test(spark, sf)[1]
    return churn.what_if(te, [("as is", {}), ("one year longer", {"tenure": F.col("tenure") + 12}),
                              ("half the monthly charges", {"MonthlyCharges": F.col("MonthlyCharges") / 2}),
                              ("unseen segment", {"segment": F.lit("(none of the known)")})])


@register("X22_scenarios")
def x22(spark, sf):
    """Boosted-tree scores and risk bands of what-if rows of every
    test customer."""
    return churn.scenario_scores(gbt_model(spark, sf), _scenarios(spark, sf))


@register("X22_scenario_drivers")
def x22d(spark, sf):
    """The ten largest drivers of every what-if row, the rest summed."""
    c = churn.gbt_contributions(gbt_model(spark, sf), _scenarios(spark, sf), ["customerID", "scenario"])
    key = F.concat_ws("|", "customerID", "scenario")
    out = explain.waterfall(c.withColumn("row", key), "row", top=10)
    return out.select(F.substring_index("row", "|", 1).alias("customerID"), F.expr("substring_index(row, '|', -1)").alias("scenario"),
                      "feature", "contribution", "rank")


@register("J5_aligned_rows", with_(SPLIT) + """
SELECT r.customerID, r.TotalCharges AS TotalCharges_raw, s.TotalCharges AS TotalCharges_clean, s.split
FROM cust_raw r JOIN split s ON r.customerID = s.customerID""")
def j5(spark, sf):
    """Raw, cleaned and split rows aligned on customerID."""
    from basketry.sources import customers_raw
    raw = customers_raw(spark, sf).select("customerID", F.col("TotalCharges").alias("TotalCharges_raw"))
    sp = split(spark, sf).select("customerID", F.col("TotalCharges").alias("TotalCharges_clean"), "split")
    return raw.join(sp, "customerID")


# -- segments ------------------------------------------------------------------

def _churn_segments(spark, sf, k=4):
    c = cust(spark, sf)
    sc = segments.scaled_vectors(c, segments.CHURN_SEGMENT_FEATURES).persist()
    model = segments.kmeans_best_of(sc, k=k)
    return sc, model, segments.assign_clusters(model, sc)


@register("M5_churn_segments")
def m5(spark, sf):
    """KMeans (best of 10) on 4 scaled features, profiled."""
    _, _, assigned = _churn_segments(spark, sf)
    return segments.churn_profile(assigned)


@register("M7_churn_centroids")
def m7r(spark, sf):
    """Fitted centroids in scaled units and in original units."""
    c = cust(spark, sf)
    sc, model, _ = _churn_segments(spark, sf)
    cols = segments.CHURN_SEGMENT_FEATURES
    rows = [(i, *map(float, v)) for i, v in enumerate(model.clusterCenters())]
    cz = spark.createDataFrame(rows, ["cluster", *cols])  # k rows, from the fitted model
    return features.inverse_scale(cz, c, cols)


@register("M8_projection")
def m8(spark, sf):
    """M8 (re-aimed): 2-D PCA coordinates with the cluster of each customer."""
    _, _, assigned = _churn_segments(spark, sf)
    return segments.projection_2d(assigned).select("customerID", "cluster", "dim1", "dim2")


@register("M6_rfm_segments")
def m6(spark, sf):
    """KMeans on scaled R/F/M, profiled with medians."""
    r = retail.rfm(tx(spark, sf))
    sc = segments.scaled_vectors(r, segments.RFM_FEATURES).persist()
    model = segments.kmeans_best_of(sc, k=4)
    return segments.rfm_profile(segments.assign_clusters(model, sc))


# -- recommenders ----------------------------------------------------------------

def _rec_split(spark, sf):
    from basketry.plans.q_retail import _split
    return _split(spark, sf)


def _with_desc(recs, t):
    return (retail.with_description(recs, retail.item_descriptions_from_lines(t))
            .select("CustomerID", "rank", "StockCode", F.round("score", 6).alias("score"), "Description"))


def svd_recs(spark, sf, k=50):
    from basketry.plans.q_retail import memo
    _, _, train, _ = _rec_split(spark, sf)

    def build():
        u, v, _ = factor.train_svd(train, k)
        return factor.top_k_from_factors(u, v, train, 10)
    return memo(spark, sf, "svd-recs", {"k": k}, build)


def als_recs(spark, sf, k=50):
    from basketry.plans.q_retail import memo
    _, it, train, _ = _rec_split(spark, sf)

    def build():
        _, uf, itf = factor.train_als(train, retail.user_dim(it), retail.item_dim(it), n_factors=k)
        return factor.top_k_from_factors(uf, itf, train, 10)
    return memo(spark, sf, "als-recs", {"k": k}, build)


def nmf_recs(spark, sf, k=50, max_iter=NMF_ITERS):
    from basketry.plans.q_retail import memo
    _, _, train, _ = _rec_split(spark, sf)

    def build():
        w, h, _ = factor.train_nmf(train, k, max_iter=max_iter)
        return factor.top_k_from_factors(w, h, train, 10)
    return memo(spark, sf, "nmf-recs", {"k": k, "max_iter": max_iter}, build)


@register("M9_svd_recommendations")
def m9(spark, sf):
    """Truncated SVD (k=50) top-10 unseen items per user."""
    return _with_desc(svd_recs(spark, sf), tx(spark, sf))


@register("M10_folded_user_factors")
def m10f(spark, sf):
    """Factors of every training user folded in from the fitted item
    factors, as for a user who arrives after the fit."""
    _, it, train, _ = _rec_split(spark, sf)
    _, _, itf = factor.train_als(train, retail.user_dim(it), retail.item_dim(it), n_factors=50)
    return factor.fold_in(train, itf, 50)


@register("M10_als_recommendations")
def m10(spark, sf):
    """Implicit ALS (rank 50, 15 iterations) top-10 per user."""
    return _with_desc(als_recs(spark, sf), tx(spark, sf))


@register("M11_nmf_recommendations")
def m11(spark, sf):
    """NMF (k=50) top-10 unseen items per user."""
    return _with_desc(nmf_recs(spark, sf), tx(spark, sf))


@register("M13_recommender_comparison")
def m13(spark, sf):
    """Precision@10, Recall@10, Hit Rate of the four recommenders
    (reads the recommendation tables the M9-M12 queries hand over)."""
    from basketry.plans.q_retail import itemcf_recs
    _, _, _, test = _rec_split(spark, sf)
    out = [("SVD", svd_recs(spark, sf)), ("ALS", als_recs(spark, sf)),
           ("NMF", nmf_recs(spark, sf)), ("Item-CF", itemcf_recs(spark, sf))]
    res = None
    for name, recs in out:
        m = evaluate.recommendation_metrics(recs, test).select(F.lit(name).alias("model"), "*")
        res = m if res is None else res.unionByName(m)
    return res
