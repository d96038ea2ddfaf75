"""Physical-plan properties: no Python workers, pruned scans, pushed filters."""

import datetime as dt


from dealscreen.checks import core
from dealscreen.operators import serve
from dealscreen.sources import incremental as inc


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_core_queries_stay_in_the_jvm(spark, sf_dir):
    for q in (core.listings(spark, sf_dir), core.estimates(spark, sf_dir), core.gold(spark, sf_dir)):
        p = plan(q)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_is_pruned(spark, sf_dir):
    p = plan(core.listings(spark, sf_dir))
    assert "o_orderstatus" not in p.split("ReadSchema")[1].split("\n")[0]


def test_serving_filters_reach_the_scan(spark, sf_dir, tmp_path):
    path = str(tmp_path / "gold")
    core.gold(spark, sf_dir).write.parquet(path)
    g = spark.read.parquet(path)
    p = plan(serve.deal_by_apn(g, "000001AB1"))
    assert "PushedFilters: [IsNotNull(apn), EqualTo(apn,000001AB1)]" in p
    p2 = plan(serve.top_deals(g, 10, min_dscr=1.3, passes_only=True))
    assert "GreaterThanOrEqual(dscr,1.3)" in p2 and "TakeOrderedAndProject" in p2


def test_pull_predicate_reaches_the_scan(spark, sf_dir, tmp_path):
    path = str(tmp_path / "src")
    core.bronze(spark, sf_dir).write.parquet(path)
    q = inc.pull_filter(spark.read.parquet(path), dt.datetime(1999, 1, 1), ["ListingKey", "ListPrice"])
    p = plan(q)
    assert "GreaterThan(ModificationTimestamp" in p
    assert "ReadSchema: struct<ListingKey:string,ListPrice:double,ModificationTimestamp:timestamp_ntz>" in p
