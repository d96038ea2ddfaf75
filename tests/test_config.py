import pytest

from dealscreen.config import (LICENSED, PUBLIC, Namespace, assert_single_lane, ensure_namespace)
from dealscreen.schemas import SILVER_LISTINGS_COLS, assert_schema


def test_namespace_names():
    ns = Namespace(tenant="acme", licensed_catalog="lic", public_catalog="pub")
    assert ns.licensed("gold") == "lic.acme_gold"
    assert ns.public("gold") == "pub.acme_gold"
    assert ns.lane_of(ns.licensed("x")) == LICENSED and ns.lane_of(ns.public("x")) == PUBLIC


def test_lanes_never_cross():
    ns = Namespace(tenant="t", licensed_catalog="lic", public_catalog="pub")
    assert not ns.licensed("x").startswith("pub.")
    assert not ns.public("x").startswith("lic.")
    with pytest.raises(ValueError):
        ns.qualified("other", "x")


def test_namespace_from_conf(spark):
    spark.conf.set("dealscreen.tenant", "t9")
    try:
        assert Namespace.from_spark(spark).licensed("g") == "deals_dev_licensed.t9_g"
    finally:
        spark.conf.unset("dealscreen.tenant")


def test_ensure_namespace(spark, tmp_path):
    ns = Namespace(tenant="t", licensed_catalog="lic_test_db", public_catalog="pub_test_db")
    ensure_namespace(spark, ns, str(tmp_path))
    ensure_namespace(spark, ns, str(tmp_path))  # idempotent
    dbs = {d.name for d in spark.catalog.listDatabases()}
    assert {"lic_test_db", "pub_test_db"} <= dbs


def test_assert_single_lane(spark):
    df = spark.createDataFrame([("licensed",), ("public",)], "lane string")
    assert_single_lane(df.filter("lane = 'licensed'"), LICENSED)
    with pytest.raises(ValueError):
        assert_single_lane(df, LICENSED)


def test_assert_schema(spark):
    df = spark.createDataFrame([tuple([None] * 9)], ", ".join(f"{c} string" for c in SILVER_LISTINGS_COLS))
    assert_schema(df, SILVER_LISTINGS_COLS)
    with pytest.raises(ValueError):
        assert_schema(df.drop("apn"), SILVER_LISTINGS_COLS)


def test_cluster_conf_scales_with_input():
    from dealscreen.session import cluster_conf

    small = cluster_conf(10 * 1024**3)
    big = cluster_conf(100 * 1024**4)
    assert int(small["spark.sql.shuffle.partitions"]) == 200
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 1024**4 // (256 * 1024**2)
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert big["spark.sql.session.timeZone"] == "UTC"
