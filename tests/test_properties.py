"""Property tests (hypothesis) on small generated inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st

from dealscreen.functions import deal_math as dm
from dealscreen.functions import text as tx
from dealscreen.operators.dedup import dedup_latest
from dealscreen.operators.screen import join_values
from dealscreen.operators.triangulate import value_triangulation

APN_TEXT = st.text(alphabet=" -\tabcXYZ0123456789", max_size=12)


@settings(max_examples=5, deadline=None)
@given(st.lists(APN_TEXT, min_size=1, max_size=20))
def test_normalize_apn_idempotent(spark, raws):
    df = spark.createDataFrame([(r,) for r in raws], "r string")
    out = df.select(tx.normalize_apn("r").alias("a")).select("a", tx.normalize_apn("a").alias("b")).collect()
    assert all(r.a == r.b for r in out)
    assert all(r.a == r.a.upper() and "-" not in r.a and " " not in r.a for r in out)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 2_000_000), min_size=2, max_size=20, unique=True),
       st.sampled_from([0.0, 0.03, 0.075, 0.12]), st.sampled_from([10, 15, 30]))
def test_payment_increases_with_loan(spark, loans, rate, years):
    df = spark.createDataFrame([(float(x),) for x in sorted(loans)], "loan double")
    pays = [r.p for r in df.select(dm.monthly_payment("loan", rate, years).alias("p")).orderBy("loan").collect()]
    assert all(a <= b for a, b in zip(pays, pays[1:]))


def test_hot_key_dedup_keeps_one_latest(spark):
    # One key holds a third of all rows (spread over every partition).
    rows = [("HOT" if i % 3 == 0 else f"K{i}", i, float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, ts int, v double").repartition(8)
    out = {r.k: r.v for r in dedup_latest(df, ["k"], ["ts"]).collect()}
    assert out["HOT"] == 2997.0 and len(out) == 1 + 2000


def test_hot_parcel_join_and_parcel_less_rows(spark):
    listings = spark.createDataFrame(
        [("HOT" if i % 3 == 0 else (None if i % 3 == 1 else f"P{i}"), f"L{i}") for i in range(900)],
        "apn string, listing_key string")
    values = spark.createDataFrame([("HOT", 1.0, "high")] + [(f"P{i}", 2.0, "low") for i in range(900) if i % 3 == 2],
                                   "apn string, value_estimate double, value_confidence string")
    out = join_values(listings, values).collect()
    assert len(out) == 900
    assert all((r.apn is None) == (r.value_estimate is None) for r in out)
    assert sum(1 for r in out if r.apn == "HOT" and r.value_estimate == 1.0) == 300


def test_hot_parcel_triangulation(spark):
    rows = [("HOT", 100000.0 + (i % 3), f"s{i % 3}") for i in range(3000)] + [("P1", 5.0, "a")]
    est = spark.createDataFrame(rows, "apn string, value_estimate double, estimate_source string")
    got = {r.apn: (r.value_estimate, r.n_sources) for r in value_triangulation(est).collect()}
    assert got == {"HOT": (100001.0, 3), "P1": (5.0, 1)}
