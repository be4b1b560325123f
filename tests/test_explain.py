"""Tree attributions, encodings and model read-outs."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import churn, explain, features, treeshap
from basketry.operators.clean import CATEGORICAL_COLS, FEATURE_COLS
from basketry.operators.treeshap import Split


def _small_trees():
    """Three trees of depth 3; a feature may occur twice on a path."""
    r = np.random.default_rng(4)
    trees = []
    for _ in range(3):
        nodes = {}
        for i in range(15):
            inner = i < 7 and not (i == 5)
            nodes[i] = {"value": float(r.normal()), "cover": 0.0, "left": 2 * i + 1 if inner else -1, "right": 2 * i + 2 if inner else -1,
                        "split": Split(int(r.integers(0, 4)), float(r.integers(0, 4)), frozenset({0.0, 2.0}) if i == 3 else frozenset()) if inner else None}

        def cover(i):
            n = nodes[i]
            n["cover"] = cover(n["left"]) + cover(n["right"]) if n["left"] >= 0 else float(r.integers(1, 50))
            return n["cover"]

        cover(0)
        trees.append(nodes)
    return trees


def _expected(nodes, x, known, at=0):
    n = nodes[at]
    if n["left"] < 0:
        return n["value"]
    if n["split"].feature in known:
        return _expected(nodes, x, known, n["left"] if n["split"].goes_left(x[None, :])[0] else n["right"])
    return sum(_expected(nodes, x, known, c) * nodes[c]["cover"] for c in (n["left"], n["right"])) / n["cover"]


def test_tree_attributions_equal_all_subsets():
    raw, weights = _small_trees(), [1.0, 0.1, 0.5]
    trees = [treeshap.paths(n, w) for n, w in zip(raw, weights)]
    worth = lambda x, s: sum(w * _expected(n, x, s) for n, w in zip(raw, weights))
    x = np.random.default_rng(5).integers(0, 5, (40, 4)).astype(float)
    phi, margin = treeshap.attributions(trees, x)
    for row, got, m in zip(x, phi, margin):
        assert m == pytest.approx(worth(row, set(range(4))))
        for i in range(4):
            rest = [j for j in range(4) if j != i]
            want = sum(factorial(len(s)) * factorial(3 - len(s)) / 24 * (worth(row, {*s, i}) - worth(row, set(s)))
                       for k in range(4) for s in combinations(rest, k))
            assert got[i] == pytest.approx(want, abs=1e-12)
    assert np.allclose(treeshap.base_value(trees) + phi.sum(axis=1), margin)


def test_tabled_attributions_equal_direct_ones(monkeypatch):
    trees = [treeshap.paths(n, w) for n, w in zip(_small_trees(), [1.0, 0.1, 0.5])]
    x = np.random.default_rng(6).integers(0, 5, (50, 4)).astype(float)
    phi, margin = treeshap.attributions(trees, x)
    assert all(a is not None for t in treeshap.tables(trees) for a in t)
    monkeypatch.setattr(treeshap, "SHORT", 0)
    assert all(a is None for t in treeshap.tables(trees) for a in t)
    direct, margin2 = treeshap.attributions(trees, x)
    assert np.allclose(phi, direct, atol=1e-14) and np.allclose(margin, margin2)


def test_one_scan_task_is_explained_in_many(spark, monkeypatch):
    """A compact table is one scan task; its rows are dealt out, all of them."""
    df = customers(spark).coalesce(1)
    monkeypatch.setattr(treeshap, "TASK_ROWS", 50)
    monkeypatch.setattr(churn, "BOOST_ROWS", 100)
    model = churn.gradient_boosting(df, features.class_lists(df), max_iter=2, max_depth=3)
    c = churn.gbt_contributions(model, df)
    assert c.rdd.getNumPartitions() == 6
    assert c.count() == 300 * len(FEATURE_COLS) and c.select("customerID").distinct().count() == 300


def test_waterfall_makes_its_input_once(spark):
    """Rows past the top are summed in the same pass; null ids are one group."""
    rows = [(i if i < 3 else None, f"f{k}", float((k * 7 + i) % 5 - 2)) for i in range(5) for k in range(6)]
    made = spark.createDataFrame(rows, "id int, feature string, contribution double").mapInPandas(lambda bs: bs, "id int, feature string, contribution double")
    w = explain.waterfall(made, "id", top=4)
    assert w._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert w.columns == ["id", "feature", "contribution", "rank"]
    got = {(r["id"], r["rank"]): (r["feature"], r["contribution"]) for r in w.collect()}
    want = {}
    for i in {r[0] for r in rows}:
        mine = sorted(((f, c) for j, f, c in rows if j == i), key=lambda p: (-abs(p[1]), p[0]))
        assert {k: c for (j, k), (_, c) in got.items() if j == i and k <= 4} == {k + 1: c for k, (_, c) in enumerate(mine[:4])}
        want[i] = sum(c for _, c in mine[4:])
    assert {j: c for (j, k), (f, c) in got.items() if k == 5 and f == "other features"} == want and len(got) == 20


def customers(spark, n=300, one_valued=True):
    rows = [(str(i), "only" if one_valued else "ab"[i % 2], f"r{i % 3}", ["1-URGENT", "it's \\ odd"][i % 2], "Yes" if i % 5 else None,
             "No" if i % 4 else "Yes", i % 2, i % 60, float(20 + i % 90), float(i * 7 % 1000), int((i % 60 < 20) ^ (i % 7 == 0)))
            for i in range(n)]
    return spark.createDataFrame(rows, "customerID string, segment string, region string, top_priority string, has_returns string, "
                                       "has_events string, debt_flag int, tenure int, MonthlyCharges double, TotalCharges double, Churn int")


def test_boosted_trees_add_up(spark):
    df = customers(spark)
    model = churn.gradient_boosting(df, features.class_lists(df), max_iter=12, max_depth=4)
    c = churn.gbt_contributions(model, df)
    per = c.groupBy("customerID").agg((F.first("base") + F.sum("contribution")).alias("total"), F.first("margin").alias("margin"),
                                      F.count("*").alias("n"))
    scored = churn.predict(model, df).join(per, "customerID")
    worst = scored.agg(F.max(F.abs(F.col("total") - F.col("margin"))), F.max(F.abs(1 / (1 + F.exp(-F.col("margin"))) - F.col("score"))),
                       F.min("n"), F.max("n"), F.count("*")).first()
    assert worst[0] < 1e-9 and worst[1] < 1e-9 and worst[2] == worst[3] == len(FEATURE_COLS) and worst[4] == 300
    w = explain.waterfall(c, "customerID", top=4)
    back = w.groupBy("customerID").agg(F.sum("contribution").alias("s"), F.count("*").alias("k")).join(per, "customerID")
    off = F.abs(F.col("s") - (F.col("total") - c.first()["base"]))
    assert back.select(F.max(off), F.max("k")).first()[0] < 1e-4


def test_unseen_category(spark):
    """One-valued, null and unseen categories in both encodings."""
    df = customers(spark)
    classes = features.class_lists(df)
    assert classes["segment"] == ["only"] and classes["has_returns"] == ["Yes"]
    lr, gbt = churn.logistic_regression(df, classes, max_iter=50), churn.gradient_boosting(df, classes, max_iter=3, max_depth=3)
    new = churn.what_if(df, [("as is", {}), ("new", {"segment": F.lit("never seen"), "region": F.lit(None)}), ("first", {"region": F.lit("r0")})])
    for model in (lr, gbt):
        got = churn.scenario_scores(model, new)
        assert got.count() == 900 and got.filter("score IS NULL OR score NOT BETWEEN 0 AND 1").count() == 0
        # unseen and null count as the first class
        s = got.groupBy("customerID").pivot("scenario", ["new", "first"]).agg(F.first("score"))
        assert s.filter(F.abs(F.col("new") - F.col("first")) > 1e-12).count() == 0


def test_one_customer_is_explained_like_all(spark):
    df = customers(spark, one_valued=False)
    lr = churn.logistic_regression(df, features.class_lists(df), max_iter=50)
    alone = churn.lr_contributions(lr, df.filter("customerID = '17'"), df).select("feature", "contribution", "base")
    among = churn.lr_contributions(lr, df, df).filter("customerID = '17'").select("feature", "contribution", "base")
    a, b = ({r["feature"]: r for r in x.collect()} for x in (alone, among))
    assert a.keys() == b.keys() and any(abs(r["contribution"]) > 1e-6 for r in a.values())
    assert all(a[f]["contribution"] == pytest.approx(b[f]["contribution"]) for f in a)
    assert len(a) == 4 + sum(len(v) - 1 for v in features.class_lists(df).values() if v) and set(CATEGORICAL_COLS) <= set(features.class_lists(df))


def test_best_model_first_wins_ties(spark):
    t = spark.createDataFrame([("b", 0.8), ("a", 0.9), ("c", 0.9)], "model string, auc double")
    assert churn.best_model(t, ["b", "c", "a"]).first()["best_model"] == "c"


def test_grouped_quantiles(spark):
    from basketry.functions.quantile import grouped_quantiles
    r = np.random.default_rng(3)
    data = {"a": r.normal(size=101), "b": np.r_[np.zeros(500), 1.0], "c": np.array([4.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None)], "g string, v double")
    for row in grouped_quantiles(df, "g", "v", [0.25, 0.5, 0.9], ["x", "y", "z"]).collect():
        assert list(row[1:]) == pytest.approx(list(np.quantile(data[row["g"]], [0.25, 0.5, 0.9])))
