"""Memo keys follow the input data version, not only the parameters."""

from basketry.session import scratch_path
from basketry.sources.cache import cached_table, memo_key


def test_memo_key_changes_with_data_and_params(spark):
    path = scratch_path(spark, "memo-src")
    spark.range(10).write.parquet(path)
    k1 = memo_key(spark, "m", [path], {"a": 1})
    assert k1 == memo_key(spark, "m", [path], {"a": 1})
    assert k1 != memo_key(spark, "m", [path], {"a": 2})
    spark.range(5).write.mode("append").parquet(path)          # new data version
    assert k1 != memo_key(spark, "m", [path], {"a": 1})


def test_cached_table_builds_once(spark):
    path = scratch_path(spark, "memo-src2")
    spark.range(3).write.parquet(path)
    calls = []

    def build():
        calls.append(1)
        return spark.range(7)
    assert cached_table(spark, "t", [path], {}, build).count() == 7
    assert cached_table(spark, "t", [path], {}, build).count() == 7
    assert len(calls) == 1
