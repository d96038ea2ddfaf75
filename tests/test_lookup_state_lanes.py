"""Indexed lookups, mergeable value states, lanes, contracts, home cards and price texts."""

import random
import threading
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dealscreen.config import Namespace
from dealscreen.functions.text import suspicious_price
from dealscreen.operators.lookup import lookup, write_lookup
from dealscreen.operators.value_state import K, merge_states, state_values, value_state
from dealscreen.operators.triangulate import value_triangulation
from dealscreen.plans import lanes
from dealscreen.plans.lanes import run_lanes
from dealscreen.plans.pipeline import PipelineTables, run_pipeline
from dealscreen.schemas import SILVER_VALUE_ESTIMATES_SCHEMA, enforce
from dealscreen.sources.pages import decoded, homecard_ids


def scanned_rows(df):
    """Rows that the scan of an executed plan gave."""
    rows = df._jdf.queryExecution().executedPlan()
    df.collect()
    node = rows
    while True:
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        elif name.startswith("Scan parquet"):
            return node.metrics().apply("numOutputRows").value()
        elif node.children().isEmpty():
            node = node.plan() if hasattr(node, "plan") else node
        else:
            node = node.children().head()


def test_lookup_skips_row_groups(spark, tmp_path):
    n = 200_000
    rows = spark.range(n).select(F.format_string("%08dAB", F.col("id") * 2).alias("apn"), F.concat(F.lit("L"), "id").alias("listing_key"),
                                 (n - F.col("id")).alias("rank_score"), F.sha2(F.col("id").cast("string"), 256).alias("filler"))
    rows = rows.unionByName(spark.createDataFrame([("00000010AB", "L5b", 1, "x"), (None, "none", 2, "x")], "apn string, listing_key string, rank_score long, filler string"))
    path = f"{tmp_path}/lookup"
    write_lookup(rows, path, row_group_bytes=256 * 1024)
    files = [f for f in (tmp_path / "lookup").iterdir() if f.name.endswith(".parquet")]
    groups = sum(pq.ParquetFile(f).num_row_groups for f in files)
    assert groups > 20
    found = spark.read.parquet(path).where("apn = '00200000AB'")
    assert [r.listing_key for r in found.collect()] == ["L100000"]
    assert 0 < scanned_rows(found) < n / 10  # a few row groups at most
    # An odd number lies between the keys of a row group, but in no bloom filter (but for its error rate).
    absent = [scanned_rows(spark.read.parquet(path).where(F.col("apn") == f"{i:08d}AB")) for i in range(100_001, 100_041, 2)]
    assert sum(a > 0 for a in absent) <= 3
    got = {r.apn: r.listing_key for r in lookup(spark, path, ["00000010AB", "00000020AB", "00000021AB", None]).collect()}
    assert got == {"00000010AB": "L5b", "00000020AB": "L10"}
    assert lookup(spark, path, ["00000010AB"], per_key=5).count() == 2 and lookup(spark, path, []).count() == 0
    assert spark.read.parquet(path).where("apn IS NULL").count() == 0


def test_states_merge_to_the_state_of_all_rows(spark):
    rng = random.Random(2)
    rows = [(f"P{i % 40}", float(rng.randrange(1, 10**6)), rng.choice(["avm", "county", "x"])) for i in range(3000)]
    rows += [("HOT", float(i * 7919 % 30011 + 1), f"s{i % 3}") for i in range(30011)] + [("P1", None, "avm"), (None, 5.0, "avm"), ("P2", -1.0, "avm")]
    df = spark.createDataFrame(rows, "apn string, value_estimate double, estimate_source string").repartition(6)
    part = F.crc32(F.col("value_estimate").cast("string")) % 3
    merged = merge_states(*[value_state(df.where(part == i)) for i in range(3)])
    whole = value_state(df)
    cols = ["apn", "n", "low", "high", "sources"]
    assert sorted(map(str, merged.select(*cols).collect())) == sorted(map(str, whole.select(*cols).collect()))
    small = [c for c in ("apn", "value_estimate", "n_sources", "spread_pct", "value_confidence")]
    assert all(r.n <= K for r in merged.where("apn <> 'HOT'").collect())
    # Up to K estimates the median is that of all rows; beyond it the rank is near the middle.
    exact = value_triangulation(df.where("apn <> 'HOT'"), "approx").select(*small)
    assert sorted(map(str, state_values(merged.where("apn <> 'HOT'")).select(*small).collect())) == sorted(map(str, exact.collect()))
    mid = state_values(merged.where("apn = 'HOT'")).first().value_estimate
    assert abs(mid / 30011 - 0.5) < 0.01


@pytest.fixture
def ns(spark, tmp_path):
    ns = Namespace(tenant="t", licensed_catalog=f"l{uuid.uuid4().hex[:8]}", public_catalog=f"p{uuid.uuid4().hex[:8]}")
    yield ns
    for db in (ns.licensed_catalog, ns.public_catalog):
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def _bronze(spark):
    rows = [("L1", "P1", 100.0, "reso", None), ("L2", "P1", 110.0, "portal_a", 90.0), ("L3", "P2", 120.0, "portal_b", None), ("L4", "P2", 130.0, None, 7.0)]
    return spark.createDataFrame(rows, "ListingKey string, ParcelNumber string, ListPrice double, source string, value_estimate double").withColumn(
        "estimate_source", F.lit("own"))


def test_lanes_are_kept_apart(spark, tmp_path, ns):
    feed = spark.createDataFrame([("P1", 100.0, "county"), ("P1", 200.0, "avm"), ("P2", 300.0, "county")],
                                 "ParcelNumber string, value_estimate double, estimate_source string")
    ranked = run_lanes(spark, _bronze(spark), [feed], ns=ns, location_root=str(tmp_path))
    assert {lane: sorted(r.listing_key for r in df.collect()) for lane, df in ranked.items()} == {"licensed": ["L1", "L4"], "public": ["L2", "L3"]}
    for lane, want in (("licensed", [("P1", "avm"), ("P2", "own")]), ("public", [("P1", "county"), ("P1", "own"), ("P2", "county")])):
        got = spark.read.table(PipelineTables.of(ns, lane).silver_value_estimates)
        assert sorted((r.apn, r.estimate_source) for r in got.collect()) == want
        assert {r.lane for r in ns.read(spark, lane, "bronze_listings").select("lane").distinct().collect()} == {lane}


def test_lanes_run_at_the_same_time(spark, tmp_path, ns, monkeypatch):
    """Each lane waits for the other to begin; an error in one is raised, after the other has ended."""
    both, ended = threading.Barrier(2, timeout=60), []

    def run(spark_, rows, feeds, lane, **kw):
        both.wait()
        if lane == "public":
            raise ValueError("of one lane")
        ended.append(rows.count())
        return rows

    monkeypatch.setattr(lanes, "run_pipeline", run)
    feed = spark.createDataFrame([("1-A", 5.0, "avm"), ("2-A", 6.0, "county")], "ParcelNumber string, value_estimate double, estimate_source string")
    with pytest.raises(ValueError, match="of one lane"):
        run_lanes(spark, _bronze(spark), [feed], ns=ns, location_root=str(tmp_path))
    assert len(ended) == 1 and ended[0] > 0


def test_rows_of_the_other_lane_fail_the_run(spark, tmp_path, ns):
    mixed = _bronze(spark).withColumn("lane", F.when(F.col("ListingKey") == "L1", "licensed").otherwise("public"))
    feed = spark.createDataFrame([], "ParcelNumber string, value_estimate double, estimate_source string")
    with pytest.raises(ValueError, match="lane violation"):
        run_pipeline(spark, mixed, [feed], ns=ns, location_root=str(tmp_path), lane="public")
    assert not spark.catalog.tableExists(ns.public("silver_listings"))


def test_contracts(spark):
    good = spark.createDataFrame([("A", 1.0, "s")], "apn string, value_estimate double, estimate_source string")
    assert enforce(good, "silver_value_estimates", SILVER_VALUE_ESTIMATES_SCHEMA).count() == 1
    with pytest.raises(ValueError, match="schema mismatch"):
        enforce(good.withColumn("value_estimate", F.lit(1)), "silver_value_estimates", SILVER_VALUE_ESTIMATES_SCHEMA)
    with pytest.raises(Exception, match="estimate_source is null"):
        enforce(good.withColumn("estimate_source", F.lit(None).cast("string")), "silver_value_estimates", SILVER_VALUE_ESTIMATES_SCHEMA).collect()


CARDS = [
    ('<div data-rf-test-id="homecard" id="a"></div>', ["a"]), ("<div id='b' data-rf-test-id='homecard'>", ["b"]),
    ("<DIV DATA-RF-TEST-ID=homecard ID=c>", ["c"]), ('<div data-rf-test-id = "homecard"\n id\t=\n"d" />', ["d"]),
    ('<div title="a > b" data-rf-test-id="homecard" id="e">', ["e"]), ("<div title='\"' data-rf-test-id=homecard id=f>", ["f"]),
    ('<div data-rf-test-id="homecard">', [""]), ('<div data-rf-test-id="homecard" id>', [""]),
    ('<div data-rf-test-id="homecard" id="x&amp;y&#39;&#x4e2d;&bogus;&">', ["x&y'中&bogus;&"]),
    ('<div data-rf-test-id="home&#99;ard" id="1" id="2">', ["1"]), ('<!-- <div data-rf-test-id="homecard" id="no"> -->', []),
    ('<script>"<div data-rf-test-id=homecard id=no>"</script><p data-rf-test-id=homecard id=g>', ["g"]),
    ('<div data-rf-test-id="homecards" id="no"><div xdata-rf-test-id="homecard" id="no">', []), ('<div title="data-rf-test-id=homecard" id="no">', []),
    ("a < b and c > d", []), ("", []), (None, None), ("<div " + "x=1 " * 30000 + "data-rf-test-id=homecard id=h>", ["h"]),
    ("<div " + "x='" + ">" * 50000 + "' data-rf-test-id=homecard id=i>", ["i"]), ("<" * 50000 + '<i data-rf-test-id="homecard" id="j">', ["j"]),
]


def test_home_cards_in_every_form(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CARDS)], "i int, html string")
    got = {r.i: r.ids for r in df.select("i", homecard_ids("html").alias("ids")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CARDS)}


def test_decoded(spark):
    df = spark.createDataFrame([("&#128512;&nbsp;&#0;&#xD800;&#9999999;a",)], "t string")
    assert df.select(decoded(F.col("t"))).first()[0] == "😀 &#0;&#xD800;&#9999999;a"


@pytest.mark.parametrize("text,want", [("$1.2M", True), ("450k", True), ("450 K", True), ("$450,000", False), ("$1,250,000.50", False), (None, False),
                                       ("", False), ("1.2.3", True), ("300-400", True), ("$5 million", True), ("$500 monthly", False), ("call", False)])
def test_suspicious_price(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(suspicious_price("t")).first()[0] is want
