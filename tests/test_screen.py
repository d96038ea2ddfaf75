"""Deal-screen semantics on small hand-made rows."""

import pytest

from dealscreen.config import Assumptions
from dealscreen.operators.screen import deal_screen
from dealscreen.plans.gold import gold_deal_screen

LISTING_SCHEMA = ("apn string, listing_key string, address string, postal_code string, property_type string, "
                  "list_price double, annual_property_tax double, monthly_hoa double, has_hoa boolean")
VALUE_SCHEMA = "apn string, value_estimate double, n_sources bigint, spread_pct double, value_confidence string"


def screen(spark, listings, values=(), a=None):
    l_df = spark.createDataFrame(listings, LISTING_SCHEMA)
    v_df = spark.createDataFrame(list(values), VALUE_SCHEMA)
    return {r.listing_key: r for r in deal_screen(l_df, v_df, a).collect()}


def test_null_tax_never_passes_null_hoa_is_zero(spark):
    rows = [("P1", "L1", "a", "z", "t", 200000.0, None, 0.0, False),
            ("P2", "L2", "a", "z", "t", 200000.0, 2400.0, None, False),
            ("P3", "L3", "a", "z", "t", 200000.0, 2400.0, 0.0, False)]
    out = screen(spark, rows)
    assert out["L1"].dscr is None and out["L1"].monthly_pitia is None and out["L1"].passes is False
    assert out["L2"].monthly_pitia == out["L3"].monthly_pitia and out["L2"].monthly_hoa == 0.0


def test_value_falls_back_to_price_and_confidence_is_null(spark):
    rows = [("P1", "L1", "a", "z", "t", 250000.0, 3000.0, 0.0, False),
            (None, "L2", "a", "z", "t", 250000.0, 3000.0, 0.0, False)]
    out = screen(spark, rows, [("P1", 300000.0, 3, 0.02, "high")])
    assert out["L1"].value == 300000.0 and out["L1"].value_confidence == "high"
    assert out["L1"].instant_equity == 50000.0
    assert out["L1"].equity_after_close == pytest.approx(300000.0 - 250000.0 * 1.03)
    assert out["L2"].value == 250000.0 and out["L2"].value_confidence is None and out["L2"].instant_equity == 0.0


def test_gold_ltv_is_target_and_rent_ratio(spark):
    out = screen(spark, [("P1", "L1", "a", "z", "t", 100000.0, 1200.0, 0.0, False)])
    r = out["L1"]
    assert r.ltv == 0.75 and r.est_monthly_rent == 800.0


def test_zero_rate_assumption(spark):
    a = Assumptions(annual_rate=0.0, term_years=30)
    r = screen(spark, [("P1", "L1", "a", "z", "t", 120000.0, 0.0, 0.0, False)], a=a)["L1"]
    assert r.monthly_pitia == pytest.approx(120000.0 * 0.75 / 360 + 150.0, abs=0.01)


def test_rank_breaks_ties_by_listing_key(spark):
    rows = [("P", f"L{i}", "a", "z", "t", 100000.0, 1200.0, 0.0, False) for i in (3, 1, 2)]
    l_df = spark.createDataFrame(rows, LISTING_SCHEMA)
    v_df = spark.createDataFrame([], VALUE_SCHEMA)
    out = {r.listing_key: r.rank_score for r in gold_deal_screen(l_df, v_df).collect()}
    assert out == {"L1": 1, "L2": 2, "L3": 3}


def test_several_estimate_feeds(spark):
    from dealscreen.plans.silver import silver_value_estimates

    cols = "ParcelNumber string, value_estimate double, estimate_source string, as_of int, l_orderkey int, " \
           "l_linenumber int, l_partkey int, l_suppkey int"
    f1 = spark.createDataFrame([(" 1-a ", 100.0, "avm", 1, 1, 1, 1, 1), ("2", None, "avm", 1, 2, 1, 1, 1)], cols)
    f2 = spark.createDataFrame([("1A", 110.0, "avm", 2, 3, 1, 1, 1), ("1a", 90.0, "county", 1, 4, 1, 1, 1),
                                ("  ", 5.0, "avm", 1, 5, 1, 1, 1)], cols)
    got = sorted(tuple(r) for r in silver_value_estimates([f1, f2]).collect())
    assert got == [("1A", 90.0, "county"), ("1A", 110.0, "avm")]
