"""Random forest of deep trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import churn, evaluate, features, forest
from basketry.operators.clean import LABEL_COL
from basketry.operators.features import label_pipeline
from tests.test_explain import customers


def _scores(spark, df, part, trees=6, depth=30):
    classes = features.class_lists(df)
    model = forest.fit(df, label_pipeline(classes).fit(df), F.col(LABEL_COL), trees, depth, 42, part=part)
    rows = forest.predict(model, df, ["customerID"]).collect()
    return model, sorted((r["customerID"] or "", r["score"]) for r in rows)


def _gini_cut(x, y, w):
    """Best (gain, cut) of one feature by trying every value."""
    imp = lambda m: (lambda n, a: a * a / n + (n - a) ** 2 / n)(w[m].sum(), (w * y)[m].sum())
    return max(((imp(x <= c) + imp(x > c) - imp(x >= 0), -int(c)) for c in np.unique(x)[:-1]), default=(0.0, 0))


def _one_by_one(x, y, w, tree, node, depth, seed):
    """Share of class 1 for each row, grown node by node."""
    p = (w * y).sum() / w.sum()
    best = (1e-12 * w.sum(), None, None)
    if 0 < p < 1 and node < 1 << depth:
        for f in forest._picks(tree, np.array([node]), x.shape[1], seed)[0]:
            gain, cut = _gini_cut(x[:, f], y, w)
            if gain > best[0] + 1e-9:
                best = gain, f, -cut
    if best[1] is None:
        return np.full(len(x), p)
    out, left = np.empty(len(x)), x[:, best[1]] <= best[2]
    out[left] = _one_by_one(x[left], y[left], w[left], tree, 2 * node, depth, seed)
    out[~left] = _one_by_one(x[~left], y[~left], w[~left], tree, 2 * node + 1, depth, seed)
    return out


def test_tree_equals_node_by_node():
    r = np.random.default_rng(3)
    x, y, w = r.integers(0, 9, (250, 5)).astype(np.uint8), r.integers(0, 2, 250).astype(np.uint8), r.integers(1, 4, 250).astype(np.uint8)
    for depth in (0, 3, 30):
        t = forest.grow(x, y, w, 7, 1, depth, 42)
        got = []
        for row in x:
            at = 0
            while t["child"][at] >= 0:
                at = t["child"][at] + int(row[t["feature"][at]] > t["cut"][at])
            got.append(t["value"][at])
        assert np.allclose(got, _one_by_one(x, y.astype(float), w.astype(float), 7, 1, depth, 42))


def test_parts_do_not_change_the_forest(spark):
    """Trees cut by summed histograms first are those grown in one task;
    rows with equal keys and null keys all get a score."""
    df = customers(spark, one_valued=False)
    df = df.unionByName(df.limit(20)).unionByName(df.limit(5).withColumn("customerID", F.lit(None).cast("string")))
    whole, a = _scores(spark, df, 10_000)
    parts, b = _scores(spark, df, 30)
    assert whole.parts.count() == 6 and not any(len(c[0]) for c in whole.cuts)
    assert parts.parts.count() > 40 and all(len(c[0]) for c in parts.cuts)
    assert a == b and len(a) == 325
    shallow, c = _scores(spark, df, 30, depth=2)
    assert c == _scores(spark, df, 10_000, depth=2)[1] and shallow.parts.agg(F.max("part")).first()[0] < 8


def test_forest_scores_are_split_by_rows(spark, monkeypatch):
    df = customers(spark, one_valued=False)
    a = _scores(spark, df, 30)[1]
    monkeypatch.setattr(forest, "SCORED", 70)
    assert _scores(spark, df, 30)[1] == a


def test_forest_learns_and_refuses(spark):
    df = customers(spark, n=600, one_valued=False).withColumn("Churn", (F.col("tenure") < 20).cast("int"))
    classes = features.class_lists(df)
    model = churn.random_forest(df.filter("customerID % 4 <> 0"), classes, num_trees=30)
    p = churn.predict(model, df.filter("customerID % 4 = 0"))
    assert p.columns == ["customerID", "label", "prediction", "score"] and p.count() == 150
    assert evaluate.auc(p).first()["auc"] > 0.9
    assert p.filter("prediction <> cast(score > 0.5 as int) or score not between 0 and 1").count() == 0
    with pytest.raises(ValueError):
        churn.random_forest(df.limit(0), classes, num_trees=2)
    with pytest.raises(ValueError):
        churn.random_forest(df.withColumn("Churn", F.lit(None).cast("int")), classes, num_trees=2)
