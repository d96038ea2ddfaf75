import pytest

from dealscreen.functions import text as tx


@pytest.mark.parametrize("raw,want", [(" 123-456 ", "123456"), ("123-456-789", "123456789"),
                                      ("abc-def", "ABCDEF"), (None, None), ("   ", ""),
                                      (" 12-3 a\t", "123A")])
def test_normalize_apn(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "r string")
    assert df.select(tx.normalize_apn("r").alias("x")).first().x == want


def test_apn_key_blank_is_null(spark):
    df = spark.createDataFrame([("  ",), (" 1-2 ",)], "r string")
    assert [r.x for r in df.select(tx.apn_key("r").alias("x")).collect()] == [None, "12"]


@pytest.mark.parametrize("t,want", [("$350,000", 350000.0), ("1.2.3", None), ("", None), ("n/a", None),
                                    ("1,234 sqft", 1234.0), ("$1.2M", 1.2)])
def test_number_from_text(spark, t, want):
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(tx.number_from_text("t").alias("x")).first().x == want


def test_batch_label(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2026-06-30 03:30:17' AS ts")
    r = df.select(tx.batch_label("ts").alias("a"), tx.batch_label("ts", tx.PORTAL_LABEL_FORMAT).alias("b"),
                  tx.iso_utc("ts").alias("c")).first()
    assert (r.a, r.b, r.c) == ("20260630_033017", "20260630T033017", "2026-06-30T03:30:17Z")


def test_nullif_zero(spark):
    df = spark.createDataFrame([(0.0,), (None,), (2.5,)], "v double")
    assert [r.x for r in df.select(tx.nullif_zero("v").alias("x")).collect()] == [None, None, 2.5]
