"""Fills, chained regressions, folds: small fixtures and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import crossval, impute


def _filled(rows):
    """Forward, backward, linear by a plain walk over one series of (x, v)."""
    out = []
    for i, (x, v) in enumerate(rows):
        p = next(((a, b) for a, b in reversed(rows[:i + 1]) if b is not None), None)
        n = next(((a, b) for a, b in rows[i:] if b is not None), None)
        line = v
        if v is None and p and n:
            line = p[1] if n[0] == p[0] else p[1] + (n[1] - p[1]) * (x - p[0]) / (n[0] - p[0])
        out.append((p and p[1], n and n[1], line))
    return out


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_series_fill_equals_a_plain_walk(spark, hot):
    rnd = random.Random(5)
    names = [None, "a", "b", "c"]
    rows = [("a" if rnd.random() < hot else rnd.choice(names), i, rnd.randint(0, 300),
             None if rnd.random() < 0.6 else round(rnd.random(), 3)) for i in range(600)]
    rows += [("gap", 1000 + i, i, None) for i in range(40)] + [("one", 2000, 5, 1.5), ("one", 2001, 9, None)]
    df = spark.createDataFrame(rows, "g string, id long, x long, v double").repartition(7)
    got = {r.id: (r.v_ffill, r.v_bfill, r.v_linear) for r in
           impute.series_fill(df, ["x", "id"], "v", F.col("x"), ["g"]).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        series = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))
        for r, want in zip(series, _filled([(s[2], s[3]) for s in series])):
            have = got[r[1]]
            assert have[:2] == want[:2], (g, r)
            assert (have[2] is None) == (want[2] is None)
            assert want[2] is None or abs(have[2] - want[2]) < 1e-9


def test_series_fill_spans_many_ranges_and_empty_table(spark):
    n = 5000
    df = spark.range(n).select("id", F.when(F.col("id").isin(0, 2500, n - 1), F.col("id") * 2.0).alias("v"))
    r = impute.series_fill(df, ["id"], "v", F.col("id"))
    assert r.columns == ["id", "v", "v_ffill", "v_bfill", "v_linear"]
    assert r.filter(F.abs(F.col("v_linear") - F.col("id") * 2.0) > 1e-6).count() == 0
    assert r.filter(F.col("v_ffill") != F.when(F.col("id") < 2500, 0.0).when(F.col("id") < n - 1, 5000.0).otherwise(2.0 * n - 2)).count() == 0
    assert impute.series_fill(df.limit(0), ["id"], "v", F.col("id")).count() == 0


def test_constant_fill_ties_nulls_and_no_known_value(spark):
    df = spark.createDataFrame([(1, 1.0, "b", None), (2, None, "a", None), (3, 4.0, None, None), (4, None, "b", None), (5, None, "a", None)],
                               "id int, x double, c string, none double")
    rows = {r.id: r for r in impute.constant_fill(df, ["x", "none"], ["c"]).collect()}
    assert rows[2].x == 2.5 and rows[2].x_was_missing == 1 and rows[1].x == 1.0 and rows[1].x_was_missing == 0
    assert rows[3].c == "a" and rows[3].c_was_missing == 1          # a and b tie: the smaller
    assert rows[1].none is None and rows[1].none_was_missing == 1
    kept, report = impute.drop_missing(df, ["x", "c"])
    assert [r.id for r in kept.collect()] == [1] and tuple(report.first()) == (5, 4, 80.0)
    assert tuple(impute.drop_missing(df.limit(0), ["x"])[1].first()) == (0, 0, 0.0)


def test_chained_fill_recovers_planted_relations(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(10, 3, 800), rng.normal(-2, 1, 800)
    y = 2 * a - 3 * b + 1
    w = 0.5 * y + a
    lost_y, lost_w = rng.random(800) < 0.4, rng.random(800) < 0.3
    rows = [(i, float(a[i]), float(b[i]), None if lost_y[i] else float(y[i]), None if lost_w[i] else float(w[i]), 7.0, None) for i in range(800)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double, w double, same double, none double")
    got = {r.id: r for r in impute.chained_fill(df, ["a", "b", "y", "w", "same", "none"]).collect()}
    assert len(got) == 800
    for i, r in got.items():
        assert abs(r.y - y[i]) < 1e-3 and abs(r.w - w[i]) < 1e-3 and r.same == 7.0 and r.none is None
        assert (r.y_was_missing, r.w_was_missing) == (int(lost_y[i]), int(lost_w[i]))
        assert lost_y[i] or r.y == y[i]


def test_chained_fill_without_gaps_and_empty(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan")), (2, 2.0, 4.0), (3, 3.0, 6.0)], "id int, a double, b double")
    got = {r.id: r.b for r in impute.chained_fill(df, ["a", "b"]).collect()}
    assert abs(got[1] - 2.0) < 1e-6 and got[3] == 6.0               # NaN is a gap
    full = impute.chained_fill(df.filter("id > 1"), ["a", "b"])
    assert full.count() == 2 and full.columns == ["id", "a", "b", "a_was_missing", "b_was_missing"]
    assert impute.chained_fill(df.limit(0), ["a", "b"]).count() == 0


def _folded(spark, n=400):
    rnd = random.Random(11)
    rows = [(str(i), rnd.choice(["x", "y", "z", None]) if i else "only", float(i % 17), rnd.random() < 0.4) for i in range(n)]
    df = spark.createDataFrame(rows, "customerID string, c string, u double, y boolean").withColumn("Churn", F.col("y").cast("int")).drop("y")
    return crossval.with_fold(df, k=4)


def test_target_encodings_never_see_their_fold(spark):
    f = _folded(spark)
    rows = f.collect()
    assert {r.fold for r in rows} == {0, 1, 2, 3}
    got = {r.customerID: r.c_target for r in crossval.encode(f, crossval.target_encodings(f, ["c"], smoothing=5.0), ["c"]).collect()}
    assert len(got) == len(rows)
    for r in rows:
        outside = [q for q in rows if q.fold != r.fold]
        same = [q.Churn for q in outside if q.c == r.c]
        prior = sum(q.Churn for q in outside) / len(outside)
        assert abs(got[r.customerID] - (sum(same) + 5 * prior) / (len(same) + 5)) < 1e-9


def test_scores_do_not_depend_on_the_labels_of_their_fold(spark):
    f = _folded(spark)
    fit = crossval.target_encoded_logistic(["c"], numeric=["u"])
    base = {r.customerID: (r.fold, r.score) for r in crossval.out_of_fold(f, fit, 4).collect()}
    assert len(base) == f.count()
    turned = f.withColumn("Churn", F.when(F.col("fold") == 2, 1 - F.col("Churn")).otherwise(F.col("Churn")))
    again = {r.customerID: r.score for r in crossval.out_of_fold(turned, fit, 4).filter("fold = 2").collect()}
    assert again and all(abs(base[k][1] - s) < 1e-9 for k, s in again.items())
    new = spark.createDataFrame([("n", "never seen", 1.0, 0)], "customerID string, c string, u double, Churn int")
    assert 0 < fit(f)(new).first().score < 1


def test_fold_metrics(spark):
    s = spark.createDataFrame([(0, 1, 1), (0, 0, 1), (1, 0, 0), (1, 1, 0)], "fold int, label int, prediction int")
    m = {r.fold: r for r in crossval.fold_metrics(s).collect()}
    assert m["0"].precision == 0.5 and m["0"].recall == 1.0 and m["1"].f1 == 0.0 and m["1"].precision == 0.0
    assert m["mean"].accuracy == 0.5 and m["mean"].rows == 4 and abs(m["std"].recall - 0.5 ** 0.5) < 1e-12
