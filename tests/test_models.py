"""Invariants of the iterative models (rows-only operators)."""

import numpy as np
from pyspark.sql import functions as F

from basketry.operators import factor, segments


def _matrix(spark, seed=1, users=25, items=18):
    rnd = np.random.default_rng(seed)
    rows = [(u, f"i{i:02d}", int(rnd.integers(1, 6))) for u in range(users) for i in range(items)
            if rnd.random() < 0.3]
    return rows, spark.createDataFrame(rows, "CustomerID long, StockCode string, purchase_count long")


def _dense(rows, users, items):
    m = np.zeros((users, items))
    for u, s, q in rows:
        m[u, int(s[1:])] += q
    return m


def test_top_k_from_factors_matches_brute_force(spark):
    rows, train = _matrix(spark)
    rnd = np.random.default_rng(5)
    uf = spark.createDataFrame([(u, rnd.normal(size=4).tolist()) for u in range(25)],
                               "CustomerID long, vec array<double>")
    iv = {f"i{i:02d}": rnd.normal(size=4) for i in range(18)}
    itf = spark.createDataFrame([(k, v.tolist()) for k, v in iv.items()], "StockCode string, vec array<double>")
    got = factor.top_k_from_factors(uf, itf, train, k=5, block_items=4).collect()
    ufd = {r.CustomerID: np.array(r.vec) for r in uf.collect()}
    seen = {(u, s) for u, s, _ in rows}
    for u in range(25):
        cand = sorted(((-(ufd[u] @ v), s) for s, v in iv.items() if (u, s) not in seen))[:5]
        mine = sorted((-r.score, r.StockCode) for r in got if r.CustomerID == u)
        assert [c[1] for c in cand] == [m[1] for m in mine]


def test_svd_singular_values_sorted_and_close(spark):
    rows, train = _matrix(spark)
    _, _, sig = factor.train_svd(train, n_factors=5)
    exact = np.linalg.svd(_dense(rows, 25, 18), compute_uv=False)[:5]
    assert np.all(np.diff(sig) <= 1e-9)
    assert np.allclose(sig, exact, rtol=1e-6)


def test_nmf_nonnegative_and_error_decreases(spark):
    rows, train = _matrix(spark)
    w, h, hist = factor.train_nmf(train, n_factors=4, max_iter=20)
    errs = [e for _, e in hist]
    assert all(b <= a + 1e-6 for a, b in zip(errs, errs[1:]))
    assert w.select(F.min(F.array_min("vec"))).first()[0] >= 0
    assert h.select(F.min(F.array_min("vec"))).first()[0] >= 0


def test_kmeans_best_of_not_worse_than_single(spark):
    rnd = np.random.default_rng(2)
    pts = np.vstack([rnd.normal(c, 0.3, size=(40, 2)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, y double")
    sc = segments.scaled_vectors(df, ["x", "y"])
    best = segments.kmeans_best_of(sc, k=3, restarts=3)
    single = segments.kmeans_best_of(sc, k=3, restarts=1)
    assert best.summary.trainingCost <= single.summary.trainingCost + 1e-9


def test_linear_attribution_adds_up(spark):
    from basketry.operators import explain
    df = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(20)], "id int, a double, b double")
    c = explain.linear_contributions(df, "id", ["a", "b"], [0.5, -2.0], 0.25)
    chk = c.groupBy("id").agg((F.first("base") + F.sum("contribution") - F.first("margin")).alias("d"))
    assert chk.select(F.max(F.abs("d"))).first()[0] < 1e-9


def test_kmeans_reads_checkpointed_vectors(spark, monkeypatch):
    """The fits see a scan of the vectors, not the plan that made them, and
    give what they give on the plan itself."""
    rnd = np.random.default_rng(7)
    df = spark.createDataFrame([(int(i), *map(float, rnd.normal(size=2) + 4 * (i % 3))) for i in range(300)], "id long, a double, b double")
    data = segments.scaled_vectors(df.groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b")), ["a", "b"])
    seen, plain = [], segments.KMeans

    class Watched(plain):
        def fit(self, dataset):
            seen.append(dataset._jdf.queryExecution().optimizedPlan().toString())
            return super().fit(dataset)
    monkeypatch.setattr(segments, "KMeans", Watched)
    got = segments.kmeans_best_of(data, k=3, restarts=2)
    assert len(seen) == 2 and not [p for p in seen if "HashAggregate" in p or "Aggregate" in p]
    fits = [plain(k=3, seed=42 + r, featuresCol="scaled", maxIter=300, initMode="k-means||").fit(data.select("scaled")) for r in range(2)]
    want = min(fits, key=lambda m: m.summary.trainingCost)
    assert np.allclose(sorted(map(tuple, got.clusterCenters())), sorted(map(tuple, want.clusterCenters())))
