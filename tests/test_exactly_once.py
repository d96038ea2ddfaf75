"""Pulls and streams that stop anywhere and go on: every row once."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from dealscreen.schemas import BRONZE_SCHEMA, conform
from dealscreen.sources import incremental as inc
from dealscreen.sources import resumable
from dealscreen.streaming import routed

SCHEMA = "k string, v int, ModificationTimestamp timestamp_ntz"
T0 = dt.datetime(2024, 1, 1, 0, 0, 0, 7)


def rows(spark, *items):
    return spark.createDataFrame([(k, v, T0 + dt.timedelta(hours=h)) for k, v, h in items], SCHEMA)


def landed(spark, path):
    if not os.path.exists(path):
        return []
    df = spark.read.option("recursiveFileLookup", "true").schema(SCHEMA).json(path)
    return sorted(((r.k, r.v) for r in df.collect()), key=str)


def visible(path):
    return sorted(n for n in os.listdir(path) if not n.startswith(("_", "."))) if os.path.exists(path) else []


FIRST = [(f"k{i}", i, i // 4) for i in range(20)]


@pytest.mark.parametrize("stop", ["json", "keep_edge", "commit", "_show"])
def test_a_pull_that_stops_goes_on(spark, tmp_path, monkeypatch, stop):
    landing, state, src = f"{tmp_path}/l", f"{tmp_path}/s", rows(spark, *FIRST)
    calls = []

    def stopping(real):
        def call(*args, **kw):
            calls.append(1)
            if len(calls) == 2:
                raise RuntimeError("stopped")
            return real(*args, **kw)
        return call

    if stop == "_show":
        monkeypatch.setattr(resumable, "_show", stopping(resumable._show))
    elif stop == "json":
        from pyspark.sql.readwriter import DataFrameWriter
        monkeypatch.setattr(DataFrameWriter, "json", stopping(DataFrameWriter.json))
    else:
        monkeypatch.setattr(resumable.PullState, stop, stopping(getattr(resumable.PullState, stop)))
    with pytest.raises(RuntimeError):
        resumable.resumable_pull(src, landing, state, key_col="k", batch_rows=6)
    monkeypatch.undo()
    resumable.resumable_pull(src, landing, state, key_col="k", batch_rows=6)
    assert landed(spark, landing) == sorted((k, v) for k, v, _ in FIRST)
    assert len(visible(landing)) == 4 and not [n for n in os.listdir(landing) if n.startswith("_")]


def test_rows_of_the_marks_instant_that_come_later(spark, tmp_path):
    landing, state = f"{tmp_path}/l", f"{tmp_path}/s"
    pull = lambda *items, **kw: resumable.resumable_pull(rows(spark, *items), landing, state, key_col="k", **kw)
    assert pull() == [] and not os.path.exists(landing) and not os.path.exists(state)
    marks = pull(("b", 1, 0), ("d", 2, 0), batch_rows=1)
    assert [(m.n, m.key, m.n_records) for m in marks] == [(0, "b", 1), (1, "d", 1)]
    late = [("a", 3, 0), ("c", 4, 0), ("e", 5, 0), ("b", 1, 0), ("d", 2, 0)]
    assert [m.n_records for m in pull(*late)] == [3]
    assert pull(*late) == [] and len(visible(landing)) == 3
    pull(*late, ("z", 6, 0), ("a", 7, 2))
    assert landed(spark, landing) == [("a", 3), ("a", 7), ("b", 1), ("c", 4), ("d", 2), ("e", 5), ("z", 6)]


def test_equal_rows_and_rows_without_time(spark, tmp_path):
    src = rows(spark, ("a", 1, 0), ("a", 1, 0), ("a", 2, 0), (None, 3, 0)).union(
        spark.createDataFrame([("n", 9, None)], SCHEMA))
    resumable.resumable_pull(src, f"{tmp_path}/l", f"{tmp_path}/s", key_col="k", batch_rows=1)
    assert sorted(map(str, landed(spark, f"{tmp_path}/l"))) == sorted(map(str, [("a", 1), ("a", 1), ("a", 2), (None, 3)]))


def test_an_empty_pull_leaves_no_folder(spark, tmp_path):
    src = rows(spark, ("a", 1, 0))
    inc.incremental_pull(src, f"{tmp_path}/l", f"{tmp_path}/s")
    assert inc.incremental_pull(src, f"{tmp_path}/l", f"{tmp_path}/s").n_records == 0
    assert len(visible(f"{tmp_path}/l")) == 1


@pytest.mark.parametrize("fails_at", [1, 2])
def test_a_replayed_batch_is_in_each_table_once(spark, tmp_path, fails_at):
    landing, root, calls = f"{tmp_path}/landing", f"{tmp_path}/t", []
    os.makedirs(landing)
    with open(f"{landing}/a.jsonl", "w") as f:
        f.write('{"ListingKey": "L1", "seq": 1}\n{"ListingKey": "L2"\n{"ListingKey": "L3", "seq": 3}\n\n')

    def move(spark, source, target):
        calls.append(1)
        if len(calls) == fails_at:
            raise RuntimeError("stopped")
        routed._move(spark, source, target)

    with pytest.raises(Exception):
        routed.run_routed(spark, landing, f"{tmp_path}/c", root, move=move)
    assert routed.run_routed(spark, landing, f"{tmp_path}/c", root, move=move) == 1
    assert routed.run_routed(spark, landing, f"{tmp_path}/c", root) == 0
    good, bad = routed.routed_table(spark, root, "bronze"), routed.routed_table(spark, root, "quarantine")
    assert sorted(r.ListingKey for r in good.collect()) == ["L1", "L3"] and bad.count() == 1
    # The same batch id written again by hand: still once.
    batch = conform(good.where("ListingKey = 'L1'"), BRONZE_SCHEMA).withColumn("_corrupt_record", F.lit(None).cast("string"))
    routed.split_batch(root)(batch, 0)
    assert routed.routed_table(spark, root, "bronze").count() == 1 and routed.routed_table(spark, root, "quarantine").count() == 0
