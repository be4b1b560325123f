"""Queries of what the reference describes in prose: imputation, encodings
without their own fold, k-fold validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import crossval, features, impute
from basketry.operators.clean import CATEGORICAL_COLS
from basketry.plans.catalog import register
from basketry.plans.oracle_sql import CUST, CUST_RAW, with_
from basketry.plans.q_customers import cust, memo, raw
from basketry.functions.exprs import safe_double
from basketry.sources.tables import read_table


def readings(spark, sf):
    """Events as a series of readings: an error event has none."""
    return read_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"]).withColumn(
        "value", F.when(F.col("event_type") != "error", F.col("value")))


def _filled(spark, sf, group_cols):
    df = impute.series_fill(readings(spark, sf), ["ts", "event_id"], "value",
                            F.unix_micros(F.col("ts").cast("timestamp")), group_cols)
    return df.select("event_id", "value_ffill", "value_bfill", F.round("value_linear", 6).alias("value_linear"))


def _fill_sql(group: str) -> str:
    return f"""
WITH r AS (SELECT event_id, ts, user_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events),
k AS (SELECT *, epoch_us(ts) AS x, CASE WHEN v IS NOT NULL THEN epoch_us(ts) END AS kx FROM r),
n AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(kx IGNORE NULLS) OVER b AS px,
             first_value(v IGNORE NULLS) OVER a AS nv, first_value(kx IGNORE NULLS) OVER a AS nx
      FROM k WINDOW b AS ({group} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    a AS ({group} ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, pv AS value_ffill, nv AS value_bfill,
       round(CASE WHEN v IS NOT NULL THEN v WHEN nx = px THEN pv
                  ELSE pv + (nv - pv) * (CAST(x - px AS DOUBLE) / CAST(nx - px AS DOUBLE)) END, 6) AS value_linear
FROM n"""


@register("fill_series_whole", _fill_sql(""))
def fill_whole(spark, sf):
    """Forward, backward and linear fill of all readings as one series."""
    return _filled(spark, sf, [])


@register("fill_series_per_user", _fill_sql("PARTITION BY user_id"))
def fill_user(spark, sf):
    """Forward, backward and linear fill of each user's readings."""
    return _filled(spark, sf, ["user_id"])


def _gappy(spark, sf):
    """Customers with text charges as numbers, blank as null, and 'none' as no priority."""
    return (raw(spark, sf).withColumn("TotalCharges", safe_double("TotalCharges"))
            .withColumn("top_priority", F.when(F.col("top_priority") != "none", F.col("top_priority"))))


_GAPPY = with_(CUST_RAW) + ", g AS (SELECT * REPLACE (TRY_CAST(TotalCharges AS DOUBLE) AS TotalCharges, nullif(top_priority, 'none') AS top_priority) FROM cust_raw)"


@register("fill_mean_mode", _GAPPY + """
SELECT customerID, round(coalesce(TotalCharges, (SELECT avg(TotalCharges) FROM g)), 6) AS TotalCharges,
       coalesce(top_priority, (SELECT top_priority FROM g WHERE top_priority IS NOT NULL
                               GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS top_priority,
       CAST(TotalCharges IS NULL AS INT) AS TotalCharges_was_missing,
       CAST(top_priority IS NULL AS INT) AS top_priority_was_missing
FROM g""")
def fill_mean_mode(spark, sf):
    """Mean and mode imputation with indicators."""
    out = impute.constant_fill(_gappy(spark, sf), means=["TotalCharges"], modes=["top_priority"])
    return out.select("customerID", F.round("TotalCharges", 6).alias("TotalCharges"), "top_priority",
                      "TotalCharges_was_missing", "top_priority_was_missing")


@register("fill_drop_report", _GAPPY + """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE TotalCharges IS NULL OR top_priority IS NULL) AS dropped_rows,
       coalesce(round(count(*) FILTER (WHERE TotalCharges IS NULL OR top_priority IS NULL) * 100.0 / count(*), 4), 0.0) AS dropped_pct
FROM g""")
def fill_drop_report(spark, sf):
    """Rows lost if rows with gaps are dropped."""
    return impute.drop_missing(_gappy(spark, sf), ["TotalCharges", "top_priority"])[1]


_PROFILE_COLS = ["balance", "spend", "returned", "reading"]


def _profiles(spark, sf):
    """Customers with measures that not all of them have: spend (orders),
    returned pieces (returns), mean reading (events)."""
    orders = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    spend = orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"))
    back = read_table(spark, sf, "lineitem", ["l_orderkey", "l_returnflag", "l_quantity"]).filter("l_returnflag = 'R'")
    returned = (back.join(orders, back.l_orderkey == orders.o_orderkey)
                .groupBy(F.col("o_custkey").alias("r_custkey")).agg(F.sum("l_quantity").cast("double").alias("returned")))
    reading = readings(spark, sf).groupBy("user_id").agg(F.avg("value").alias("reading"))
    c = read_table(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    return (c.join(spend, c.c_custkey == spend.o_custkey, "left").join(returned, c.c_custkey == returned.r_custkey, "left")
            .join(reading, c.c_custkey == reading.user_id, "left")
            .select("c_custkey", F.col("c_acctbal").cast("double").alias("balance"), "spend", "returned", "reading"))


_PROFILE_SQL = """
WITH s AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM orders GROUP BY 1),
q AS (SELECT o_custkey, CAST(sum(l_quantity) AS DOUBLE) AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE l_returnflag = 'R' GROUP BY 1),
e AS (SELECT user_id, avg(CASE WHEN event_type <> 'error' THEN value END) AS reading FROM events GROUP BY 1),
p AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS balance, spend, returned, reading FROM customer
      LEFT JOIN s ON c_custkey = s.o_custkey LEFT JOIN q ON c_custkey = q.o_custkey LEFT JOIN e ON c_custkey = user_id)
"""


def chained(spark, sf):
    return memo(spark, sf, "chained-profiles", {}, lambda: impute.chained_fill(_profiles(spark, sf), _PROFILE_COLS))


@register("fill_chained")
def fill_chained(spark, sf):
    """Chained regressions over all measures of the customers."""
    return chained(spark, sf)


@register("fill_chained_known", _PROFILE_SQL + "SELECT c_custkey, " + ", ".join(
    f"round({c}, 6) AS {c}, CAST({c} IS NULL AS INT) AS {c}_was_missing" for c in _PROFILE_COLS)
    + ", CAST(0 AS BIGINT) AS gaps_left FROM p")
def fill_chained_known(spark, sf):
    """Chained regressions: known cells are as they were, gaps are marked,
    none is left."""
    left = sum((F.col(c).isNull().cast("bigint") for c in _PROFILE_COLS), F.lit(0).cast("bigint"))
    cells = [F.round(F.when(F.col(f"{c}_was_missing") == 0, F.col(c)), 6).alias(c) for c in _PROFILE_COLS]
    return chained(spark, sf).select("c_custkey", *cells, *[f"{c}_was_missing" for c in _PROFILE_COLS], left.alias("gaps_left"))


@register("fill_regression", _PROFILE_SQL + """
SELECT c_custkey, round(coalesce(reading, (SELECT regr_intercept(reading, balance) FROM p)
                                          + (SELECT regr_slope(reading, balance) FROM p) * balance), 4) AS reading
FROM p""")
def fill_regression(spark, sf):
    """Regression imputation of one measure from one other."""
    out = impute.chained_fill(_profiles(spark, sf).select("c_custkey", "balance", "reading"), ["balance", "reading"])
    return out.select("c_custkey", F.round("reading", 4).alias("reading"))


FOLDS = 5
_FOLD_SQL = f"CAST(CAST('0x' || substr(md5(concat_ws('|', '42', 'fold', customerID)), 1, 8) AS BIGINT) % {FOLDS} AS INT)"


def folded(spark, sf):
    return crossval.with_fold(cust(spark, sf), k=FOLDS)


@register("kfold_target_encoding", with_(CUST) + f", f AS (SELECT *, {_FOLD_SQL} AS fold FROM cust)\nSELECT a.customerID, a.fold, " + ", ".join(
    f"""round(((SELECT coalesce(sum(Churn), 0) FROM f b WHERE b.fold <> a.fold AND b.{c} IS NOT DISTINCT FROM a.{c})
               + 20.0 * (SELECT avg(Churn) FROM f b WHERE b.fold <> a.fold))
              / ((SELECT count(*) FROM f b WHERE b.fold <> a.fold AND b.{c} IS NOT DISTINCT FROM a.{c}) + 20.0), 9) AS {c}_target"""
    for c in CATEGORICAL_COLS) + " FROM f a")
def kfold_target_encoding(spark, sf):
    """Target encodings of all categories, each without the row's own fold."""
    f = folded(spark, sf)
    out = crossval.encode(f, crossval.target_encodings(f, CATEGORICAL_COLS), CATEGORICAL_COLS)
    return out.select("customerID", "fold", *[F.round(f"{c}_target", 9).alias(f"{c}_target") for c in CATEGORICAL_COLS])


def oof_scores(spark, sf):
    return memo(spark, sf, "kfold-scores", {"k": FOLDS}, lambda: crossval.out_of_fold(
        folded(spark, sf), crossval.target_encoded_logistic(CATEGORICAL_COLS), FOLDS))


@register("kfold_scores")
def kfold_scores(spark, sf):
    """Every customer scored once by the model of the other folds."""
    return oof_scores(spark, sf)


@register("kfold_scored_once", with_(CUST) + f"SELECT customerID, {_FOLD_SQL} AS fold, CAST(Churn AS INT) AS label, CAST(1 AS BIGINT) AS times FROM cust")
def kfold_scored_once(spark, sf):
    """Each customer's fold and label, and how often it was scored."""
    return oof_scores(spark, sf).groupBy("customerID", "fold", "label").agg(F.count("score").alias("times"))


@register("kfold_metrics")
def kfold_metrics(spark, sf):
    """Accuracy, precision, recall and F1 per fold, their mean and deviation."""
    return crossval.fold_metrics(oof_scores(spark, sf))


@register("kfold_regularisation")
def kfold_regularisation(spark, sf):
    """Regularisation of the logistic model by k-fold validation."""
    classes = features.class_lists(cust(spark, sf))
    return crossval.regularisation_grid(folded(spark, sf), classes, [0.001, 0.01, 0.1], FOLDS)
