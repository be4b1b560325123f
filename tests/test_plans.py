"""Physical-plan properties the scale design relies on."""

import re

from tests.conftest import SF_SMALL


def _formatted(spark, df):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def _build(key, spark):
    from basketry.plans.catalog import load_all
    return load_all()[key].build(spark, SF_SMALL)


def test_top_k_windows_are_limited_before_the_shuffle(spark):
    for key in ["M12_item_neighbours", "W9_customer_history"]:
        plan = _formatted(spark, _build(key, spark))
        assert "WindowGroupLimit" in plan, key


def test_cleaning_filters_sit_on_the_lineitem_scan(spark):
    plan = _formatted(spark, _build("X12_clean_transactions", spark))
    # the filter right above the lineitem scan carries the cancellation and
    # quantity rules, i.e. they run before the lineitem x orders join
    m = re.search(r"\(2\) Filter\nInput \[\d+\]: \[[^\]]*l_returnflag[^\]]*\]\nCondition : ([^\n]*)", plan)
    assert m and "StartsWith" in m.group(1) and "l_quantity" in m.group(1)


def test_scans_read_only_needed_columns(spark):
    plan = _formatted(spark, _build("A22_rfm", spark))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    li = [s for s in schemas if "l_orderkey" in s]
    assert li and all("l_comment" not in s and "l_tax" not in s and "l_discount" not in s for s in li)
    assert all("c_name" not in s for s in schemas)


def test_no_cross_or_nested_loop_joins_in_flagship(spark):
    plan = _formatted(spark, _build("M12_itemcf_recommendations", spark))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
