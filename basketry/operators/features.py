"""Feature engineering.

Label and one-hot codes are plain mapping tables (feature, value, code):
the number of classes is a property of the schema, so these stay small and
are broadcast only after their size is checked.  Model pipelines carry the
same codes, taken from the whole table, as a SQL stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.exprs import hash_key
from basketry.functions.ordinal import hash_bucket, ordinal
from basketry.operators.clean import CATEGORICAL_COLS, ID_COL, LABEL_COL, NUMERIC_COLS

MAX_BROADCAST_ROWS = 100_000


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows; otherwise
    leave the join strategy to the planner (shuffle join)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def label_mapping(customers: DataFrame, columns: Sequence[str] = CATEGORICAL_COLS) -> DataFrame:
    """alphabetical codes from 0 per categorical: (feature, value, code).
    The window runs over the distinct classes of one feature."""
    long = customers.select(*[F.col(c).cast("string").alias(c) for c in columns]) \
                    .unpivot([], list(columns), "feature", "value").distinct()
    w = Window.partitionBy("feature").orderBy("value")
    return long.withColumn("code", (F.dense_rank().over(w) - 1).cast("int"))


def label_encode(customers: DataFrame, mapping: DataFrame,
                 columns: Sequence[str] = CATEGORICAL_COLS) -> DataFrame:
    """replace each categorical by its code (unseen -> 0, as in X22)."""
    m = checked_broadcast(mapping)
    out = customers
    for c in columns:
        mc = m.filter(F.col("feature") == c).select(F.col("value").alias(f"__v_{c}"),
                                                    F.col("code").alias(f"__c_{c}"))
        out = (out.join(mc, F.col(c).cast("string") == F.col(f"__v_{c}"), "left")
                  .withColumn(c, F.coalesce(F.col(f"__c_{c}"), F.lit(0)))
                  .drop(f"__v_{c}", f"__c_{c}"))
    return out


def onehot_columns(mapping: DataFrame) -> DataFrame:
    """dummy columns with the first class of each feature dropped:
    (feature, value, dummy, position)."""
    w = Window.orderBy("feature", "value")
    return (mapping.filter(F.col("code") > 0)
                   .select("feature", "value", F.concat_ws("_", "feature", "value").alias("dummy"))
                   .withColumn("position", (F.row_number().over(w) - 1).cast("int")))


def onehot_long(customers: DataFrame, mapping: DataFrame, feature: str) -> DataFrame:
    """long-form dummies of one feature: (customerID, dummy, value 0/1)."""
    cols = checked_broadcast(onehot_columns(mapping).filter(F.col("feature") == feature)
                             .select("value", "dummy"))
    arr = cols.agg(F.collect_list(F.struct("value", "dummy"))).scalar()
    return (customers.select(ID_COL, F.col(feature).cast("string").alias("__x"))
                     .withColumn("__d", F.explode(arr))
                     .select(ID_COL, F.col("__d.dummy").alias("dummy"),
                             (F.col("__x") == F.col("__d.value")).cast("int").alias("value")))


def stratified_split(customers: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """per label, the round(n * test_size) customers first in md5 order
    are test; adds ``split`` and ``split_order`` (the md5 rank within the
    label).  The ranking is the bucketed ordinal, so each of the two label
    groups (half the data each) is spread over many tasks."""
    h = hash_key(seed, ID_COL)
    ranked = ordinal(customers.withColumn("__h", h), ["__h", ID_COL], hash_bucket("__h"),
                     group_cols=[LABEL_COL], name="__rk", total_name="__n")
    n_test = F.round(F.col("__n") * F.lit(test_size)).cast("bigint")
    return (ranked.withColumn("split", F.when(F.col("__rk") <= n_test, "test").otherwise("train"))
                  .drop("__rk", "__n"))


def minibatches(train: DataFrame, n_batches: int = 15, initial_frac: float = 0.6,
                seed: int = 42) -> DataFrame:
    """Training rows in md5 order; the first int(n * 0.6) are the
    initial batch 0, the rest are cut into ``n_batches`` equal batches with
    the remainder in the last."""
    h = hash_key(seed, F.lit("stream"), ID_COL)
    ranked = ordinal(train.withColumn("__h", h), ["__h", ID_COL], hash_bucket("__h"), name="stream_order")
    n = train.select(F.count(F.lit(1))).scalar()
    n_init = F.floor(n * F.lit(initial_frac)).cast("bigint")
    size = F.greatest(F.floor((n - n_init) / F.lit(n_batches)), F.lit(1)).cast("bigint")
    batch = F.when(F.col("stream_order") <= n_init, F.lit(0)).otherwise(
        F.least(F.floor((F.col("stream_order") - n_init - 1) / size), F.lit(n_batches - 1)) + 1)
    return ranked.withColumn("batch_id", batch.cast("int")).drop("__h")


def demo_picks(split: DataFrame, n_churned: int = 3, n_retained: int = 2) -> DataFrame:
    """The first churned and retained test rows in split order."""
    test = split.filter(F.col("split") == "test").withColumn("__h", hash_key(42, ID_COL))
    a = test.filter(F.col(LABEL_COL) == 1).orderBy("__h", ID_COL).limit(n_churned)
    b = test.filter(F.col(LABEL_COL) == 0).orderBy("__h", ID_COL).limit(n_retained)
    return a.unionByName(b).drop("__h")


# Decimals shown per column of the centroid table, 2 for others.
CENTROID_DIGITS = {"tenure": 1, "MonthlyCharges": 2, "TotalCharges": 0}


def inverse_scale(centroids: DataFrame, stats_src: DataFrame, columns: Sequence[str]) -> DataFrame:
    """scaled centroid coordinates back to original units, rounded."""
    from basketry.operators.stats import column_stats
    st = column_stats(stats_src, columns)
    out = []
    for c in columns:
        mean, std = F.lit(st[c][0]), F.lit(st[c][1])
        out.append((F.round(F.col(c) * std + mean, CENTROID_DIGITS.get(c, 2)) + F.lit(0.0)).alias(c))
    return centroids.select("cluster", *out)


MAX_CLASSES = 10_000  # classes over all categoricals; more are a key, not a category


def class_lists(customers: DataFrame, columns: Sequence[str] = CATEGORICAL_COLS) -> dict[str, list[str]]:
    """The classes of each categorical in alphabetical order, from the whole
    table (F1).  They become columns and codes of a fitted model, so their
    number is checked."""
    rows = label_mapping(customers, columns).filter("value IS NOT NULL").limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes: leave out columns that are keys")
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in sorted(rows, key=lambda r: (r["feature"], r["code"])):
        out[r["feature"]].append(r["value"])
    return out


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def label_pipeline(classes: dict[str, list[str]], features: Sequence[str] = CATEGORICAL_COLS + NUMERIC_COLS) -> Pipeline:
    """F1 + F6 for tree models: the codes of ``class_lists`` as numbers, then
    one vector in the order of ``features``.  An unseen or null category has
    code 0."""
    def code(c: str) -> str:
        cases = " ".join(f"WHEN {_quoted(v)} THEN {i}.0D" for i, v in enumerate(classes[c]))
        return f"{'CASE CAST(`' + c + '` AS STRING) ' + cases + ' ELSE 0.0D END' if cases else '0.0D'} AS `{c}__code`"

    sql = SQLTransformer(statement=f"SELECT *, {', '.join(map(code, classes))} FROM __THIS__")
    cols = [f"{c}__code" if c in classes else c for c in features]
    return Pipeline(stages=[sql, VectorAssembler(inputCols=cols, outputCol="features")])


def onehot_pipeline(classes: dict[str, list[str]]) -> Pipeline:
    """F2 + F6 for linear models: numerics, then one 0/1 column per class but
    the first of each categorical.  A categorical of one class gives no
    column, an unseen or null category zeros."""
    dummies = [(c, v) for c in classes for v in classes[c][1:]]
    sql = "".join(f", CAST(coalesce(CAST(`{c}` AS STRING) = {_quoted(v)}, false) AS DOUBLE) AS `{c}_{v}`" for c, v in dummies)
    names = NUMERIC_COLS + [f"{c}_{v}" for c, v in dummies]
    return Pipeline(stages=[SQLTransformer(statement=f"SELECT *{sql} FROM __THIS__"),
                            VectorAssembler(inputCols=names, outputCol="features")])
