"""Churn classifiers on Spark ML.

The fits are distributed Spark ML estimators inside a Pipeline (codes or 0/1
columns of the categories, ``features.class_lists`` -> assembler ->
estimator); the random forest of deep trees is ``forest``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators import evaluate, forest, treeshap
from basketry.operators.clean import FEATURE_COLS, ID_COL, LABEL_COL
from basketry.operators.features import label_pipeline, onehot_pipeline
from basketry.session import spread

BOOST_ROWS = 32_768  # rows to a task of a boosting round


def _with_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.col(LABEL_COL).cast("double"))


def logistic_regression(train: DataFrame, classes: dict[str, list[str]], max_iter: int = 2000):
    """M1: unscaled one-hot features; L2 with C=1 maps to regParam=1/n."""
    n = train.count()
    lr = LogisticRegression(maxIter=max_iter, regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                            standardization=False, featuresCol="features", labelCol="label")
    return Pipeline(stages=[*onehot_pipeline(classes).getStages(), lr]).fit(_with_label(train))


def random_forest(train: DataFrame, classes: dict[str, list[str]], num_trees: int = 200, max_depth: int = 30, seed: int = 42):
    """M2: 200 trees, sqrt feature subsets, deep trees (depth 30 at most)."""
    return forest.fit(train, label_pipeline(classes).fit(train), F.col(LABEL_COL), num_trees, max_depth, seed)


def gradient_boosting(train: DataFrame, classes: dict[str, list[str]], max_iter: int = 200, max_depth: int = 5,
                      step: float = 0.1, seed: int = 42):
    """M3: gradient-boosted trees, 200 rounds of depth 5, learning rate 0.1."""
    gbt = GBTClassifier(maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed,
                        featuresCol="features", labelCol="label", maxBins=64)
    return Pipeline(stages=[*label_pipeline(classes).getStages(), gbt]).fit(_with_label(spread(train, BOOST_ROWS)))


def predict(model, df: DataFrame) -> DataFrame:
    """M4: (id, label, prediction, score = P(churn))."""
    if isinstance(model, forest.Forest):
        out = forest.predict(model, _with_label(df).select(*FEATURE_COLS, ID_COL, "label"), [ID_COL, "label"])
        return out.select(ID_COL, F.col("label").cast("int").alias("label"),
                          (F.col("score") > 0.5).cast("int").alias("prediction"), "score")
    out = model.transform(_with_label(df))
    return out.select(ID_COL, F.col("label").cast("int").alias("label"),
                      F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability")[1].alias("score"))


def compare(preds: dict[str, DataFrame], encodings: dict[str, str]) -> DataFrame:
    """E6 + J7: one row per model: metrics rounded to 3 and the encoding."""
    rows = None
    for name, p in preds.items():
        m = evaluate.classification_metrics(p).select(
            *[F.round(c, 3).alias(c) for c in ["accuracy", "precision", "recall", "f1"]],
            F.round(evaluate.auc(p).select("auc").scalar(), 3).alias("auc"))
        m = m.select(F.lit(name).alias("model"), "*", F.lit(encodings[name]).alias("encoding"))
        rows = m if rows is None else rows.unionByName(m)
    return rows


def best_model(comparison: DataFrame, order: Sequence[str]) -> DataFrame:
    """Best model by AUC; the first of ``order`` wins ties."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    return comparison.agg(F.max_by("model", F.struct("auc", -place)).alias("best_model"), F.max("auc").alias("auc"))


def lr_contributions(model, df: DataFrame, background: DataFrame) -> DataFrame:
    """E9 for the linear model: exact additive attributions per one-hot slot,
    contribution = w * (x - mean(x)), with the means of ``background`` (the
    training rows), so a single customer is explained like any other; base +
    sum = margin for every row."""
    lr = model.stages[-1]
    scored = model.transform(_with_label(df))
    feats = scored.select(ID_COL, vector_to_array("features").alias("x"))
    # slot names come from the assembler metadata (bounded by the slot count)
    names = _slot_names(scored.schema["features"].metadata, lr.numFeatures)
    w = [float(v) for v in lr.coefficients.toArray()]
    known = model.transform(_with_label(background)).select(vector_to_array("features").alias("x"))
    means = known.select(*[F.coalesce(F.avg(F.col("x")[i]), F.lit(0.0)).alias(f"m{i}") for i in range(len(w))]).first()
    mvals = [float(means[f"m{i}"]) for i in range(len(w))]
    base = float(lr.intercept) + sum(wi * mi for wi, mi in zip(w, mvals))
    structs = [F.struct(F.lit(names[i]).alias("feature"), F.col("x")[i].alias("value"),
                        (F.lit(w[i]) * (F.col("x")[i] - F.lit(mvals[i]))).alias("contribution"))
               for i in range(len(w))]
    margin = F.lit(float(lr.intercept))
    for i in range(len(w)):
        margin = margin + F.lit(w[i]) * F.col("x")[i]
    return (feats.select(ID_COL, F.lit(base).alias("base"), margin.alias("margin"),
                         F.explode(F.array(*structs)).alias("s"))
                 .select(ID_COL, "s.feature", "s.value", "s.contribution", "base", "margin"))


def gbt_contributions(model, df: DataFrame, keys: Sequence[str] = (ID_COL,)) -> DataFrame:
    """E9 for the boosted trees: exact path-dependent attributions of every
    row, in log-odds (``treeshap``)."""
    trees = treeshap.boosted_trees(df.sparkSession, model.stages[-1])
    scored = model.transform(_with_label(spread(df, treeshap.TASK_ROWS)))
    return treeshap.contributions(trees, scored, FEATURE_COLS, list(keys))


def _slot_names(meta: dict, n: int) -> list[str]:
    names = [f"f{i}" for i in range(n)]
    attrs = meta.get("ml_attr", {}).get("attrs", {})
    for group in attrs.values():
        for a in group:
            if a["idx"] < n:
                names[a["idx"]] = a.get("name", names[a["idx"]])
    return names


def what_if(base_rows: DataFrame, changes: Sequence[tuple[str, dict[str, Column]]]) -> DataFrame:
    """Every row of ``base_rows`` once per scenario, a name and the
    columns it sets (expressions over the row or literals)."""
    types = dict(base_rows.dtypes)
    out = None
    for name, new in changes:
        one = base_rows.withColumns({c: e.cast(types[c]) for c, e in new.items()}).withColumn("scenario", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def scenario_scores(model, scenarios: DataFrame) -> DataFrame:
    """X22 + X16: (id, scenario, score, band) of rows with the model's
    features.  A category the table never held has code 0."""
    from basketry.functions.exprs import risk_band
    out = model.transform(scenarios.withColumn("label", F.lit(0.0)))
    return (out.select(ID_COL, "scenario", vector_to_array("probability")[1].alias("score"))
            .withColumn("band", risk_band("score")))
