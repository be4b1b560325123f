"""Ordinals, hold-out, neighbour ties, top-N and metric edge cases."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.functions.exprs import hash_key
from basketry.functions.ordinal import hash_bucket, ordinal
from basketry.operators import evaluate, itemcf, retail


def test_bucketed_ordinal_equals_plain_window(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 2, 3]) if i % 3 else 1, f"i{i}") for i in range(2000)]  # group 1 is hot
    df = spark.createDataFrame(rows, "g int, item string").withColumn("h", hash_key(1, "g", "item"))
    got = ordinal(df, ["h", "item"], hash_bucket("h", 2), group_cols=["g"], name="rk", total_name="n")
    ref = df.withColumn("rk2", F.row_number().over(Window.partitionBy("g").orderBy("h", "item")))
    bad = got.join(ref, ["g", "item"]).filter(F.col("rk") != F.col("rk2")).count()
    assert bad == 0


def test_small_users_holdout(spark):
    rows = [(u, f"s{j}", 1) for u, n in [(1, 4), (2, 5), (3, 10)] for j in range(n)]
    inter = spark.createDataFrame(rows, "CustomerID long, StockCode string, purchase_count long")
    train, test = retail.holdout_split(inter)
    per = {r.CustomerID: r["count"] for r in test.groupBy("CustomerID").count().collect()}
    assert per == {2: 1, 3: 2}
    assert train.count() + test.count() == 19
    assert train.join(test, ["CustomerID", "StockCode"]).count() == 0


def test_neighbour_ties_kept(spark):
    rows = [("a", f"n{j:02d}", 0.5 if j >= 15 else 1.0 - j / 100) for j in range(25)]
    sim = spark.createDataFrame(rows, "item_i string, item_j string, sim double")
    kept = itemcf.top_neighbours(sim, 20).count()
    assert kept == 25  # ranks 16..25 tie at the 20th value and are all kept


def test_few_unseen_returns_fewer_rows_but_divides_by_k(spark):
    scores = spark.createDataFrame([(1, f"i{j}", float(j)) for j in range(3)],
                                   "CustomerID long, StockCode string, score double")
    train = spark.createDataFrame([(1, "x", 1)], "CustomerID long, StockCode string, purchase_count long")
    recs = itemcf.top_n_unseen(scores, train, 10)
    assert recs.count() == 3
    test = spark.createDataFrame([(1, "i2", 1.0)], "CustomerID long, StockCode string, score double")
    m = evaluate.recommendation_metrics(recs, test, k=10).first()
    assert m.precision_at_k == 0.1 and m.recall_at_k == 1.0 and m.hit_rate == 1.0


def test_auc_with_ties_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([0, 1]), rnd.choice([0.1, 0.2, 0.2, 0.5, 0.9])) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, score double")
    got = evaluate.auc(df).first().auc
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got - u) < 1e-6


def test_one_class_predictions_give_zero_precision(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "label int, prediction int")
    m = evaluate.classification_metrics(df).first()
    assert m.precision == 0.0 and m.f1 == 0.0 and abs(m.accuracy - 1 / 3) < 1e-6


def test_item_cf_matches_dense_brute_force_with_salting(spark):
    rnd = np.random.default_rng(0)
    rows = []
    for u in range(30):
        n = 25 if u == 0 else rnd.integers(1, 8)       # user 0 is hot: forces S x S blocks
        for it in rnd.choice(40, size=n, replace=False):
            rows.append((u, f"i{it:02d}", int(rnd.integers(1, 5))))
    train = spark.createDataFrame(rows, "CustomerID long, StockCode string, purchase_count long")
    got = {(r.item_i, r.item_j): r.sim for r in itemcf.item_similarity(train, chunk=4).collect()}
    items = sorted({r[1] for r in rows})
    idx = {s: k for k, s in enumerate(items)}
    m = np.zeros((30, len(items)))
    for u, s, q in rows:
        m[u, idx[s]] += q
    norm = np.linalg.norm(m, axis=0)
    dense = (m.T @ m) / np.outer(norm, norm)
    expect = {(items[a], items[b]): dense[a, b] for a in range(len(items)) for b in range(len(items))
              if a != b and dense[a, b] > 0}
    assert set(got) == set(expect)
    assert max(abs(got[k] - expect[k]) for k in expect) < 1e-12


def test_item_cf_shuffles_no_pairs_and_adds_hot_items_in_parts(spark):
    """Recommendations against the plain form over all pairs, with an item
    everybody has bought, users split into blocks and all items hot or none;
    the pair (i, j) is no exchange key unless an item is hot."""
    rnd = np.random.default_rng(4)
    rows = [(u, f"i{it}", int(rnd.integers(1, 5))) for u in range(40)
            for it in [0, *rnd.choice(np.arange(1, 30), size=20 if u == 0 else rnd.integers(1, 7), replace=False)]]
    train = spark.createDataFrame(rows, "CustomerID long, StockCode string, purchase_count long")
    nb = itemcf.top_neighbours(itemcf.item_similarity(train), 5)
    want = {tuple(r) for r in itemcf.top_n_unseen(itemcf.score(train, nb), train, 4)
            .select("CustomerID", "StockCode", "score", "rank").collect()}
    for hot in (10, 10 ** 6):
        got = itemcf.recommend(train, n=4, top_k_similar=5, chunk=6, hot=hot).select("CustomerID", "StockCode", "score", "rank")
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    plan = itemcf.neighbours(train, 5)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert not [x for x in physical.split("\n") if "Exchange hashpartitioning(i#" in x and "j#" in x]


def test_exact_quantile_narrowing_matches_numpy(spark):
    from basketry.functions import quantile
    rnd = np.random.default_rng(11)
    vals = np.concatenate([rnd.lognormal(3, 2, 3000), np.full(2000, 7.25), rnd.normal(0, 1, 500)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    values = df.select(F.col("x").alias("v"))
    for k in [0, 1234, 2500, 4321, len(vals) - 1]:
        got = quantile.kth_smallest(values, k, n_buckets=16, final_rows=50)  # forces several passes
        assert got == float(np.sort(vals)[k])
    qs = quantile.exact_quantiles(df, "x", [0.25, 0.5, 0.9])
    assert np.allclose(qs, np.quantile(vals, [0.25, 0.5, 0.9]), rtol=0, atol=1e-12)


def test_sample_sort_ranges_are_even_and_exact(spark):
    """90 % of the scores lie under 1e-4: ranks and running totals are exact
    and no range is above four times the median."""
    import importlib

    import numpy as np
    o = importlib.import_module("basketry.functions.ordinal")
    r = np.random.default_rng(1)
    v = np.unique(np.r_[r.random(18_000) * 1e-4, r.random(2_000)])
    df = spark.createDataFrame([(float(x), int(i % 3)) for i, x in enumerate(v)], "score double, n long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [x["count"] for x in o._ranged(df, ["score"]).groupBy("__ro_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 4 and max(sizes) <= 4 * sorted(sizes)[len(sizes) // 2]
    ranked = o.range_ordinal(df, ["score"], "at").orderBy("score").collect()
    assert [x["at"] for x in ranked] == list(range(len(v)))
    total = o.range_running_totals(df, ["score"], ["n"]).orderBy("score").collect()
    assert [x["n_cum"] for x in total] == list(np.cumsum([x["n"] for x in total]))
    assert o.range_ordinal(df.limit(0), ["score"], "at").count() == 0
