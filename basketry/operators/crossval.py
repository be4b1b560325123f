"""K-fold validation with encodings that never see their own fold.

A row's fold comes from a hash of its key, so it never changes with the
layout of the table and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.exprs import hash_key
from basketry.operators import churn
from basketry.operators.clean import ID_COL, LABEL_COL, NUMERIC_COLS
from basketry.operators.features import checked_broadcast, onehot_pipeline
from basketry.session import stage

FOLD = "fold"


def with_fold(df: DataFrame, key: str = ID_COL, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0 .. k-1 from md5 of seed and key."""
    head = F.conv(F.substring(hash_key(seed, F.lit("fold"), key), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(FOLD, F.pmod(head, F.lit(k)).cast("int"))


def target_encodings(folded: DataFrame, columns: Sequence[str], label: str = LABEL_COL,
                     smoothing: float = 20.0) -> DataFrame:
    """(feature, value, fold, n, target): the smoothed mean of ``label`` over
    the rows of a category outside ``fold``, (sum + s * prior) / (n + s), the
    prior being the mean of all rows outside the fold; null fold: over all
    rows, for rows that are new.  Null is a category.  Counts per (category,
    fold) come from one map-side aggregate; the windows see at most one row
    per fold."""
    y = F.col(label).cast("double")
    long = (folded.select(F.col(FOLD), y.alias("__y"), *[F.col(c).cast("string").alias(c) for c in columns])
            .unpivot([FOLD, "__y"], list(columns), "feature", "value"))
    cells = long.groupBy("feature", "value", FOLD).agg(F.count("__y").alias("__n"), F.coalesce(F.sum("__y"), F.lit(0.0)).alias("__s"))
    one = Window.partitionBy("feature", "value")
    outside = cells.select("feature", "value", FOLD, (F.sum("__n").over(one) - F.col("__n")).alias("n"),
                           (F.sum("__s").over(one) - F.col("__s")).alias("__so"))
    total = cells.groupBy("feature", "value").agg(F.sum("__n").alias("n"), F.sum("__s").alias("__so")) \
                 .select("feature", "value", F.lit(None).cast("int").alias(FOLD), "n", "__so")
    sizes = folded.groupBy(FOLD).agg(F.count(y).alias("__fn"), F.coalesce(F.sum(y), F.lit(0.0)).alias("__fs"))  # k rows
    every = Window.partitionBy(F.lit(0))
    priors = sizes.select(FOLD, F.try_divide(F.sum("__fs").over(every) - F.col("__fs"), F.sum("__fn").over(every) - F.col("__fn")).alias("__p"))
    priors = priors.unionByName(folded.agg(F.avg(y).alias("__p")).select(F.lit(None).cast("int").alias(FOLD), "__p"))
    p = priors.withColumnRenamed(FOLD, "__f")
    return (outside.unionByName(total).join(p, F.col(FOLD).eqNullSafe(F.col("__f")))
            .select("feature", "value", FOLD, "n",
                    F.try_divide(F.col("__so") + F.lit(smoothing) * F.col("__p"), F.col("n") + F.lit(smoothing)).alias("target")))


def encode(df: DataFrame, encodings: DataFrame, columns: Sequence[str], new_rows: bool = False,
           prior: float | None = None) -> DataFrame:
    """Adds ``<column>_target``: the encoding of a row's category outside the
    row's own fold, or over all rows of the encodings if the rows are new to
    them (``new_rows``).  A category without encoding gets ``prior``."""
    out = df
    for c in columns:
        e = encodings.filter(F.col("feature") == c)
        e = e.filter(F.col(FOLD).isNull()) if new_rows else e.filter(F.col(FOLD).isNotNull())
        e = checked_broadcast(e.select(F.col("value").alias("__ev"), F.col(FOLD).alias("__ef"), F.col("target").alias(f"{c}_target")))
        cond = F.col(c).cast("string").eqNullSafe(F.col("__ev"))
        cond = cond if new_rows else cond & (F.col(FOLD) == F.col("__ef"))
        out = (out.join(e, cond, "left").drop("__ev", "__ef")
               .withColumn(f"{c}_target", F.coalesce(F.col(f"{c}_target"), F.lit(prior).cast("double"))))
    return out


def target_encoded_logistic(columns: Sequence[str], label: str = LABEL_COL, smoothing: float = 20.0,
                            reg_param: float = 0.01, numeric: Sequence[str] = NUMERIC_COLS) -> Callable:
    """A fit for ``out_of_fold``: logistic regression on target encodings.
    Rows to learn from are encoded without their own fold, rows to score from
    all rows learned from; labels of the scored fold enter neither."""
    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        table = stage(target_encodings(train, columns, label, smoothing), "encodings")  # read per column and per use
        prior = train.select(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
        names = [f"{c}_target" for c in columns] + list(numeric)
        lr = LogisticRegression(maxIter=100, regParam=reg_param, featuresCol="features", labelCol="label")
        stages = [VectorAssembler(inputCols=names, outputCol="__raw"),
                  StandardScaler(inputCol="__raw", outputCol="features", withMean=True), lr]
        model = Pipeline(stages=stages).fit(encode(train, table, columns, prior=prior).withColumn("label", F.col(label).cast("double")))
        return lambda rows: churn.predict(model, encode(rows, table, columns, new_rows=True, prior=prior))
    return fit


def out_of_fold(folded: DataFrame, fit: Callable, k: int = 5) -> DataFrame:
    """(id, label, prediction, score, fold): every row scored once, by the
    model fitted on the other folds.  ``fit`` takes the rows to learn from
    and returns the function that scores others."""
    out = None
    for f in range(k):
        score = fit(folded.filter(F.col(FOLD) != f))
        one = score(folded.filter(F.col(FOLD) == f)).withColumn(FOLD, F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out


def fold_metrics(scored: DataFrame) -> DataFrame:
    """One row per fold (accuracy, precision, recall, f1, rows) and their
    mean and sample deviation over the folds, as ``mean`` and ``std``.  A
    ratio without cases is 0."""
    def cases(label: int, prediction: int):
        return F.count(F.when((F.col("label") == label) & (F.col("prediction") == prediction), 1))

    def ratio(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))

    c = scored.groupBy(FOLD).agg(cases(1, 1).alias("tp"), cases(0, 1).alias("fp"), cases(1, 0).alias("fn"),
                                 cases(0, 0).alias("tn"), F.count(F.lit(1)).alias("rows"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    per = c.select(F.col(FOLD).cast("string").alias(FOLD), F.coalesce(F.try_divide((tp + tn).cast("double"), F.col("rows")), F.lit(0.0)).alias("accuracy"),
                   ratio("tp", tp + fp).alias("precision"), ratio("tp", tp + fn).alias("recall"),
                   F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), "rows")
    names = ["accuracy", "precision", "recall", "f1"]
    both = per.agg(*[f(x).alias(f"{x}_{n}") for x in names for n, f in (("mean", F.avg), ("std", F.stddev_samp))], F.sum("rows").alias("rows"))
    for n in ("mean", "std"):
        per = per.unionByName(both.select(F.lit(n).alias(FOLD), *[F.col(f"{x}_{n}").alias(x) for x in names], "rows"))
    return per


def regularisation_grid(folded: DataFrame, classes: dict[str, list[str]], reg_params: Sequence[float], k: int = 5) -> DataFrame:
    """(reg_param, auc, auc_std, best) of logistic regressions by k-fold
    validation over the given ``fold`` column; the first of equals is best."""
    lr = LogisticRegression(maxIter=100, featuresCol="features", labelCol="label")
    grid = ParamGridBuilder().addGrid(lr.regParam, [float(r) for r in reg_params]).build()
    cv = CrossValidator(estimator=Pipeline(stages=[*onehot_pipeline(classes).getStages(), lr]), estimatorParamMaps=grid,
                        evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=k, foldCol=FOLD)
    m = cv.fit(folded.withColumn("label", F.col(LABEL_COL).cast("double")))
    best = max(range(len(grid)), key=lambda i: (m.avgMetrics[i], -i))
    rows = [(float(reg_params[i]), float(m.avgMetrics[i]), float(m.stdMetrics[i]), i == best) for i in range(len(grid))]
    return folded.sparkSession.createDataFrame(rows, "reg_param double, auc double, auc_std double, best boolean")
