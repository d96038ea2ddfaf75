"""Numeric cases of the deal math, evaluated as Spark column expressions."""

import pytest
from pyspark.sql import functions as F

from dealscreen.config import Assumptions
from dealscreen.functions import deal_math as dm


def one(spark, col, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def test_payment_standard(spark):
    assert one(spark, dm.monthly_payment("loan", 0.075, 30), loan=200000.0) == pytest.approx(1398.43, abs=0.01)


def test_payment_zero_loan(spark):
    assert one(spark, dm.monthly_payment("loan", 0.075, 30), loan=0.0) == 0.0
    assert one(spark, dm.monthly_payment("loan", 0.075, 30), loan=-5.0) == 0.0


def test_payment_zero_rate(spark):
    assert one(spark, dm.monthly_payment("loan", 0.0, 30), loan=120000.0) == pytest.approx(333.33, abs=0.01)


def test_payment_null_loan(spark):
    assert one(spark, dm.monthly_payment(F.lit(None).cast("double"), 0.075, 30)) is None


def test_pitia(spark):
    pi = dm.monthly_payment("loan", 0.075, 30)
    v = one(spark, dm.pitia(pi, "tax", 1200.0, "hoa"), loan=200000.0, tax=3600.0, hoa=100.0)
    assert v > 1798
    v0 = one(spark, dm.pitia(pi, "tax", 1200.0), loan=200000.0, tax=3600.0)
    assert v0 == pytest.approx(v - 100.0)
    vnull = one(spark, dm.pitia(pi, "tax", 1200.0, F.lit(None).cast("double")), loan=200000.0, tax=3600.0)
    assert vnull == pytest.approx(v0)


def test_dscr(spark):
    assert one(spark, dm.dscr("r", "p"), r=2500.0, p=1800.0) == pytest.approx(1.3889, abs=1e-4)
    assert one(spark, dm.dscr("r", "p"), r=2500.0, p=0.0) is None
    assert one(spark, dm.dscr("r", "p"), r=2500.0, p=-1.0) is None
    assert one(spark, dm.dscr("r", "p", 0.25, use_noi=True), r=2500.0, p=1800.0) == pytest.approx(2500 * 0.75 / 1800)


def test_dscr_passes(spark):
    assert one(spark, dm.dscr_passes("v", 1.20), v=1.35) is True
    assert one(spark, dm.dscr_passes("v", 1.20), v=1.0) is False
    assert one(spark, dm.dscr_passes(F.lit(None).cast("double"), 1.20)) is False


@pytest.mark.parametrize("vals,value,conf,n", [
    ([200000.0], 200000.0, "low", 1),
    ([198000.0, 200000.0, 205000.0], 200000.0, "high", 3),
    ([190000.0, 200000.0, 210000.0], 200000.0, "medium", 3),
    ([150000.0, 200000.0, 250000.0], 200000.0, "low", 3),
])
def test_triangulation(spark, vals, value, conf, n):
    from dealscreen.operators.triangulate import value_triangulation

    rows = [("P1", v, f"s{i}") for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "apn string, value_estimate double, estimate_source string")
    r = value_triangulation(df).first()
    assert (r.value_estimate, r.value_confidence, r.n_sources) == (value, conf, n)


def test_triangulation_none(spark):
    from dealscreen.operators.triangulate import value_triangulation

    df = spark.createDataFrame([("P1", 0.0, "a"), ("P1", -1.0, "b"), ("P1", None, "c")],
                               "apn string, value_estimate double, estimate_source string")
    assert value_triangulation(df).count() == 0


def test_median_methods(spark):
    from dealscreen.operators.triangulate import value_triangulation

    df = spark.createDataFrame([("P", float(v), f"s{v}") for v in (1, 2, 3, 4)],
                               "apn string, value_estimate double, estimate_source string")
    assert value_triangulation(df, "exact").first().value_estimate == 2.5
    assert value_triangulation(df, "approx").first().value_estimate == 2.0


def test_equity_and_ltv(spark):
    assert one(spark, dm.instant_equity("v", "p"), v=210000.0, p=200000.0) == 10000.0
    assert one(spark, dm.instant_equity("v", "p"), v=190000.0, p=200000.0) == -10000.0
    assert one(spark, dm.equity_after_close("v", "p", "c", "r"), v=210000.0, p=200000.0, c=6000.0, r=4000.0) == 0.0
    assert one(spark, dm.equity_after_close("v", "p", "c"), v=210000.0, p=200000.0, c=6000.0) == 4000.0
    assert one(spark, dm.ltv("l", "v"), l=150000.0, v=200000.0) == 0.75
    assert one(spark, dm.ltv("l", "v"), l=150000.0, v=0.0) is None


@pytest.mark.parametrize("rent,loan,passes", [(2500.0, 150000.0, True), (1200.0, 150000.0, False),
                                              (3000.0, 190000.0, False)])
def test_screen_property(spark, rent, loan, passes):
    s = dm.screen_property(monthly_rent=F.lit(rent), purchase_price=F.lit(200000.0), loan_amount=F.lit(loan),
                           annual_property_tax=F.lit(3600.0), value_estimates=F.array().cast("array<double>"),
                           annual_rate=0.075, term_years=30, annual_insurance=1200.0)
    r = spark.range(1).select(s.alias("s")).first().s
    assert r.passes is passes
    assert r.value_estimate == 200000.0 and r.value_confidence is None


def test_screen_property_estimates(spark):
    s = dm.screen_property(monthly_rent=F.lit(2500.0), purchase_price=F.lit(200000.0), loan_amount=F.lit(150000.0),
                           annual_property_tax=F.lit(3600.0),
                           value_estimates=F.array(F.lit(198000.0), F.lit(205000.0), F.lit(200000.0), F.lit(0.0)))
    r = spark.range(1).select(s.alias("s")).first().s
    assert (r.value_estimate, r.value_confidence, r.instant_equity) == (200000.0, "high", 0.0)


@pytest.mark.parametrize("d,l,e,expected", [
    (1.35, 0.70, 25000.0, True), (1.0, 0.70, 25000.0, False), (1.35, 0.85, 25000.0, False),
    (1.35, 0.70, -5000.0, False), (1.35, 0.70, 0.0, False), (None, 0.70, 25000.0, False),
    (1.35, None, 25000.0, False), (1.35, 0.70, None, False),
])
def test_investment_grade(spark, d, l, e, expected):
    df = spark.createDataFrame([(d, l, e)], "d double, l double, e double")
    assert df.select(dm.investment_grade("d", "l", "e", Assumptions()).alias("x")).first().x is expected


def test_assumptions_from_conf(spark):
    spark.conf.set("dealscreen.assumption.annual_rate", "0.065")
    spark.conf.set("dealscreen.assumption.term_years", "15")
    try:
        a = Assumptions.from_spark(spark)
        assert a.annual_rate == 0.065 and a.term_years == 15 and a.ltv_target == 0.75
    finally:
        spark.conf.unset("dealscreen.assumption.annual_rate")
        spark.conf.unset("dealscreen.assumption.term_years")
