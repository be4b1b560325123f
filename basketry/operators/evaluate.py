"""Evaluation: classification metrics (E1-E5), ranking metrics (E7),
per-model verdicts (E8, A29), run read-outs (E13, W11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.ordinal import range_running_totals

USER, ITEM = "CustomerID", "StockCode"


def _r(c, d=6):
    return F.round(c, d)


# -- ranking metrics ---------------------------------------------------------

def recommendation_metrics(recs: DataFrame, test: DataFrame, k: int = 10) -> DataFrame:
    """Precision@K (hits / K, even with fewer candidates), Recall@K,
    Hit Rate and Users Evaluated over the test users (J8 intersection)."""
    truth = test.groupBy(USER).agg(F.count(F.lit(1)).alias("n_true"))
    hits = (recs.select(USER, ITEM).join(test.select(USER, ITEM), [USER, ITEM])
                .groupBy(USER).agg(F.count(F.lit(1)).alias("hits")))
    per_user = truth.join(hits, USER, "left").fillna(0, ["hits"])
    return per_user.agg(
        _r(F.avg(F.col("hits") / F.lit(float(k)))).alias("precision_at_k"),
        _r(F.avg(F.col("hits") / F.col("n_true"))).alias("recall_at_k"),
        _r(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0))).alias("hit_rate"),
        F.count(F.lit(1)).alias("users_evaluated"))


# -- classification metrics --------------------------------------------------

def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1; 0 on a zero denominator."""
    y, p = F.col(label), F.col(prediction)
    c = pred.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp").cast("double"),
                                 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    acc = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    return c.select(_r(acc).alias("accuracy"), _r(prec).alias("precision"),
                    _r(rec).alias("recall"), _r(f1).alias("f1"))


def score_counts(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score."""
    return pred.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def roc_points(pred: DataFrame, label: str = "label", score: str = "score", start: bool = False) -> DataFrame:
    """One ROC point per distinct score threshold (score desc): tpr and
    fpr with ties grouped.  Running totals use even ranges of a sample sort.  ``start``
    adds the curve's origin (0, 0), whose threshold is above all scores
    (null)."""
    sc = score_counts(pred, label, score)
    cum = range_running_totals(sc, [F.desc("score")], ["pos", "neg"])
    P = pred.select(F.count_if(F.col(label) == 1)).scalar()
    N = pred.select(F.count_if(F.col(label) == 0)).scalar()
    points = cum.select("score", _r(F.col("pos_cum") / P).alias("tpr"), _r(F.col("neg_cum") / N).alias("fpr"))
    if not start:
        return points
    origin = sc.agg(F.count("*")).select(F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return origin.unionByName(points)


def auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Tie-aware ROC AUC (Mann-Whitney): for each distinct score,
    pos * (negatives below + neg / 2), divided by P * N."""
    sc = score_counts(pred, label, score)
    cum = range_running_totals(sc, ["score"], ["neg"])
    below = F.col("neg_cum") - F.col("neg")
    u = cum.agg(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)).alias("u"),
                F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return u.select(_r(F.col("u") / (F.col("P") * F.col("N"))).alias("auc"))


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Zero-filled 2x2 counts, rows actual, columns predicted."""
    y, p = F.col(label), F.col(prediction)
    return pred.agg(*[F.count_if((y == a) & (p == b)).alias(f"actual_{a}_pred_{b}")
                      for a in (0, 1) for b in (0, 1)])


def log_loss(pred: DataFrame, label: str = "label", prob: str = "score", eps: float = 1e-15) -> DataFrame:
    """E5: mean binary cross-entropy with clipped probabilities."""
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label)
    return pred.agg(_r(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))).alias("log_loss"))


# -- multi-model views -------------------------------------------------------

def verdicts(long_preds: DataFrame, id_col: str = "customerID") -> DataFrame:
    """E8 + A29: per customer, how many models are right; verdict all
    correct / mixed / all wrong; then counts per verdict.  Input is long:
    (id, model, label, prediction)."""
    per = (long_preds.withColumn("__ok", (F.col("label") == F.col("prediction")).cast("int"))
                     .groupBy(id_col).agg(F.min("__ok").alias("__min"), F.max("__ok").alias("__max")))
    v = (F.when(F.col("__min") == 1, "all correct").when(F.col("__max") == 0, "all wrong")
          .otherwise("mixed"))
    return per.groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("customers"))


def prediction_grid(long_preds: DataFrame, models: Sequence[str], id_col: str = "customerID") -> DataFrame:
    """One row per customer, one prediction column per model (the model
    list is a fixed parameter, so the pivot needs no collect)."""
    return (long_preds.groupBy(id_col, "label").pivot("model", list(models))
                      .agg(F.first("prediction")))


def verdict_grid(long_preds: DataFrame, models: Sequence[str], id_col: str = "customerID") -> DataFrame:
    """Per customer each model's label and score side by side, the actual
    outcome and the verdict."""
    shown = F.struct(F.when(F.col("prediction") == 1, "Churned").otherwise("Retained").alias("label"), "score",
                     (F.col("prediction") == F.col("label")).alias("ok"))
    wide = long_preds.groupBy(id_col, "label").pivot("model", list(models)).agg(F.first(shown))
    right = sum((F.coalesce(F.col(f"`{m}`.ok"), F.lit(False)).cast("int") for m in models), F.lit(0))
    cols = [F.col(f"`{m}`.{part}").alias(f"{m} {part}") for m in models for part in ("label", "score")]
    return wide.select(id_col, F.when(F.col("label") == 1, "Churned").otherwise("Retained").alias("actual"), *cols,
                       F.when(right == len(models), "all correct").when(right == 0, "all wrong").otherwise("mixed").alias("verdict"))


def metric_deltas(history: DataFrame, order_col: str = "batch_id",
                  metrics: Sequence[str] = ("accuracy", "f1")) -> DataFrame:
    """Change of each metric against the previous batch.  The history
    has one row per batch, a small table."""
    w = Window.orderBy(order_col)
    out = history
    for m in metrics:
        out = out.withColumn(f"{m}_delta", _r(F.col(m) - F.lag(m).over(w)))
    return out


def run_readout(history: DataFrame, order_col: str = "batch_id",
                metrics: Sequence[str] = ("accuracy", "f1")) -> DataFrame:
    """Initial, final and change of each metric over a run."""
    aggs = []
    for m in metrics:
        aggs += [F.min_by(m, order_col).alias(f"{m}_initial"), F.max_by(m, order_col).alias(f"{m}_final")]
    out = history.agg(*aggs)
    for m in metrics:
        out = out.withColumn(f"{m}_change", _r(F.col(f"{m}_final") - F.col(f"{m}_initial")))
    return out
