"""Incremental refresh: touched buckets only, moves between parcels, repeated and late rows, restarts; atomic publishing."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from dealscreen.config import Namespace, ensure_namespace
from dealscreen.operators.publish import current_snapshot, expire, publish
from dealscreen.operators.screen import SCREEN_COLS, deal_screen
from dealscreen.operators.triangulate import value_triangulation
from dealscreen.plans import refresh as rf
from dealscreen.plans.silver import silver_listings, silver_value_estimates
from dealscreen.schemas import BRONZE_SCHEMA, conform

LISTING = "ListingKey string, ParcelNumber string, ListPrice double, TaxAnnualAmount double, ModificationTimestamp timestamp_ntz, seq long"
ESTIMATE = "ParcelNumber string, value_estimate double, estimate_source string, as_of timestamp_ntz, seq long"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def listing(spark, rows):
    return spark.createDataFrame([(k, p, v, 1000.0, day(d), d) for k, p, v, d in rows], LISTING)


def estimate(spark, rows):
    return spark.createDataFrame([(p, v, s, day(d), d) for p, v, s, d in rows], ESTIMATE)


def rows_of(df):
    return sorted(map(str, df.select(*SCREEN_COLS).collect()))


def full(bronze, estimates):
    values = value_triangulation(silver_value_estimates([estimates]))
    return rows_of(deal_screen(silver_listings(conform(bronze, BRONZE_SCHEMA)), values))


LANDINGS = [
    ([(f"L{i}", f"P{i % 20}", 100000.0 + i, 1) for i in range(60)] + [("N1", None, 5.0, 1), ("N2", "  ", 6.0, 1)],
     [(f"P{i}", 90000.0 + 1000 * i, s, 1) for i in range(20) for s in ("avm", "county")]),
    # L3 moves, L4 loses its parcel, N1 gets one, L5 is an older version, L6 the same again, L60 is new.
    ([("L3", "P99", 7.0, 2), ("L4", None, 8.0, 2), ("N1", "P1", 9.0, 2), ("L5", "P7", 1.0, 0), ("L6", "P6", 100006.0, 1), ("L60", "P3", 3.0, 2)],
     [("P1", 1000.0, "avm", 2), ("P2", 1.0, "avm", 0), ("P99", 55000.0, "x", 2)]),
    ([("L3", "P3", 7.5, 3)], [("P77", 1.0, "avm", 3)]),
]


def test_refreshes_equal_a_full_run(spark, tmp_path):
    tables = rf.RefreshTables(spark, f"{tmp_path}/t", buckets=8)
    seen = None
    for bronze, estimates in LANDINGS:
        b, e = listing(spark, bronze), estimate(spark, estimates)
        rf.refresh(tables, b, [e])
        seen = (b, e) if seen is None else (seen[0].union(b), seen[1].union(e))
        assert rows_of(tables.ranked_input()) == full(*seen)
    # The same rows once more, only listings, only estimates, and nothing.
    rf.refresh(tables, listing(spark, LANDINGS[1][0]), [estimate(spark, LANDINGS[1][1])])
    rf.refresh(tables, listing(spark, LANDINGS[0][0]), [])
    rf.refresh(tables, None, [estimate(spark, LANDINGS[2][1])])
    assert rf.refresh(tables, listing(spark, []), [estimate(spark, [])]) == rf.Refreshed(0, 0, 0, 0)
    assert rows_of(tables.ranked_input()) == full(*seen)


def _stamps(path):
    return {b: sorted(os.listdir(f"{path}/{b}")) for b in os.listdir(path) if b.startswith("bucket=")}


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    tables = rf.RefreshTables(spark, f"{tmp_path}/t", buckets=64)
    rf.refresh(tables, listing(spark, LANDINGS[0][0]), [estimate(spark, LANDINGS[0][1])])
    names = ("listings", "parcels", "estimates", "values", "screen")
    before = {n: _stamps(f"{tmp_path}/t/{n}") for n in names}
    done = rf.refresh(tables, listing(spark, [("L3", "P99", 7.0, 2)]), [])
    after = {n: _stamps(f"{tmp_path}/t/{n}") for n in names}
    written = {n: [b for b in after[n] if after[n][b] != before[n].get(b)] for n in names}
    assert done == rf.Refreshed(1, 2, 0, 2)
    assert {n: len(w) for n, w in written.items()} == {"listings": 1, "parcels": 2, "estimates": 0, "values": 0, "screen": 2}
    part = tables.parcels.read(None, [3, 5])
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    assert {r.bucket for r in part.collect()} <= {3, 5}


def test_a_refresh_that_stopped_is_run_again(spark, tmp_path, monkeypatch):
    """Stopped before each of its writes in turn: the second run ends as one that never stopped."""
    bronze, estimates = LANDINGS[0], LANDINGS[1]
    b, e = listing(spark, bronze[0]), estimate(spark, bronze[1])
    b2, e2 = listing(spark, estimates[0]), estimate(spark, estimates[1])
    want, replace = full(b.union(b2), e.union(e2)), rf.BucketTable.replace
    for stop in (1, 2, 4):
        tables, calls = rf.RefreshTables(spark, f"{tmp_path}/s{stop}", buckets=8), []
        rf.refresh(tables, b, [e])

        def failing(self, rows, touched):
            calls.append(1)
            if len(calls) > stop:
                raise RuntimeError("stopped")
            replace(self, rows, touched)

        monkeypatch.setattr(rf.BucketTable, "replace", failing)
        with pytest.raises(RuntimeError):
            rf.refresh(tables, b2, [e2])
        monkeypatch.setattr(rf.BucketTable, "replace", replace)
        rf.refresh(tables, b2, [e2])
        assert rows_of(tables.ranked_input()) == want


@pytest.fixture
def served(spark, tmp_path):
    ns = Namespace(tenant=f"t{uuid.uuid4().hex[:8]}", licensed_catalog=f"l{uuid.uuid4().hex[:8]}", public_catalog=f"p{uuid.uuid4().hex[:8]}")
    ensure_namespace(spark, ns, str(tmp_path))
    yield ns.licensed("served")
    for db in (ns.licensed_catalog, ns.public_catalog):
        spark.sql(f"DROP DATABASE {db} CASCADE")


def test_failed_write_leaves_the_old_rows(spark, served):
    publish(spark.range(10), served)
    bad = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 999, F.raise_error(F.lit("midway")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="midway"):
        publish(bad, served)
    assert spark.read.table(served).count() == 10


def test_open_reader_finishes_and_old_snapshots_expire(spark, served):
    publish(spark.range(10), served)
    reader, first = spark.read.table(served), current_snapshot(spark, served)
    assert publish(spark.range(3), served).count() == 3
    assert reader.count() == 10 and current_snapshot(spark, served) != first
    publish(spark.range(4), served)
    assert expire(spark, served, keep=1) == []  # too young
    assert len(expire(spark, served, keep=1, min_age_seconds=0)) == 2
    assert spark.read.table(served).count() == 4
    assert publish(spark.range(2).withColumn("more", F.lit("x")), served).columns == ["id", "more"]
    assert expire(spark, served + "_none") == []


def test_table_that_was_not_published_is_taken_over(spark, served):
    spark.range(5).write.saveAsTable(served)
    assert publish(spark.range(6), served).count() == 6


def test_landings_read_inputs_that_were_written_once(spark, sf_dir, monkeypatch):
    """The adapter's join of orders and lineitem isn't part of what each landing reads."""
    from dealscreen.checks import refresh as checks

    seen = []
    monkeypatch.setattr(checks, "refresh", lambda tables, bronze, feeds, **kw: seen.extend([bronze, *feeds]))
    checks._refreshed(spark, sf_dir)
    assert len(seen) == 6 and all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in seen)


def test_a_run_makes_its_estimate_feeds_once(spark, sf_dir, monkeypatch):
    """Quarantine and silver read the feed's rows as they were written, not the join that makes them."""
    from dealscreen import fixtures as fx
    from dealscreen.checks.core import bronze
    from dealscreen.config import Namespace, scratch_path
    from dealscreen.plans import pipeline

    seen, silver = [], pipeline.silver_value_estimates
    monkeypatch.setattr(pipeline, "silver_value_estimates", lambda feeds, order: (seen.extend(feeds), silver(feeds, order))[1])
    pipeline.run_pipeline(spark, bronze(spark, sf_dir), [fx.estimate_feed(spark, sf_dir)], ns=Namespace(tenant="feeds_once"),
                          estimate_order=fx.ESTIMATE_ORDER, location_root=scratch_path(spark, "warehouse"))
    assert len(seen) == 1 and "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
