"""Streaming: one metrics row per batch, and a replay changes nothing."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_churn_stream_replay_is_idempotent(spark):
    from basketry.plans.q_customers import cust
    from basketry.session import scratch_path
    from basketry.streaming import churn_live
    out = scratch_path(spark, "test-churn-live")
    c = cust(spark, SF_SMALL)
    churn_live.run(spark, c, n_batches=5, out=out)
    first = sorted(tuple(r) for r in churn_live.metrics_history(spark, out).collect())
    assert [r[0] for r in first] == list(range(6))            # batch 0 (initial) + 5 batches
    n_train = spark.read.parquet(f"{out}/source").count()
    assert first[-1][-1] == n_train                             # samples processed adds up
    # replay: the same batches arrive again as new files; nothing may change
    churn_live.run(spark, c, n_batches=5, out=out)
    again = sorted(tuple(r) for r in churn_live.metrics_history(spark, out).collect())
    assert again == first
    w = spark.read.parquet(f"{out}/weights")
    assert w.groupBy("batch_id").count().filter(F.col("count") != 1).count() == 0


def test_read_or_empty_raises_on_damage(spark, tmp_path):
    import pytest
    from basketry.streaming.common import read_or_empty
    assert read_or_empty(spark, str(tmp_path / "absent"), "a int").count() == 0
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception):
        read_or_empty(spark, str(bad), "a int").count()


def test_rec_stream_scores_the_users_it_evaluates(spark, tmp_path):
    """Only users of the test period are scored, and the metrics are those
    over everyone's lists."""
    from basketry.operators import evaluate, factor
    from basketry.streaming import rec_live
    tx = spark.range(400).selectExpr("id % 40 AS CustomerID", "concat('i', pmod(xxhash64(id), 25)) AS StockCode", "1 + id % 3 AS Quantity",
                                     "make_timestamp(IF(id % 40 < 8, 2000 + int(id div 140), 2000), 3, 1, 0, 0, 0) AS InvoiceDate")
    asked, whole, top_k = [], [], factor.top_k_from_factors

    def watched(uf, itf, train, k):
        asked.append({r[0] for r in uf.select("CustomerID").collect()})
        return top_k(uf, itf, train, k)
    als = factor.train_als

    def fitted(train, *args, **how):
        out = als(train, *args, **how)
        whole.append(top_k(out[1], out[2], train, 10))
        return out
    factor.top_k_from_factors, factor.train_als = watched, fitted
    try:
        out = rec_live.run(spark, tx, n_initial=2, period="year", n_factors=3, out=str(tmp_path / "s"))
    finally:
        factor.top_k_from_factors, factor.train_als = top_k, als
    test = tx.filter("year(InvoiceDate) = 2002").groupBy("CustomerID", "StockCode").count()
    assert asked == [{r[0] for r in test.select("CustomerID").distinct().collect()}] and 0 < len(asked[0]) <= 8
    want, got = evaluate.recommendation_metrics(whole[0], test).first(), rec_live.metrics_history(spark, out).first()
    assert (got["hit_rate"], got["precision_at_10"]) == (want["hit_rate"], want["precision_at_k"])
