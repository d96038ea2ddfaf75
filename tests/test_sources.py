import datetime as dt
import logging
import os

from pyspark.sql import functions as F

from dealscreen.schemas import CORRUPT_COL
from dealscreen.sources import files, incremental as inc, pages as pg, portal as pt
from dealscreen.streaming.bronze import run_bronze


def page(spark, html, page_id=1):
    return spark.createDataFrame([(page_id, html)], "page_id long, html string")


ISLAND = '<script id="__NEXT_DATA__" type="application/json">{}</script>'


def test_blocked_titles(spark):
    df = spark.createDataFrame([(1, "<title>ERROR 500</title>"), (2, "<title>Please solve CAPTCHA</title>"),
                                (3, "<title>error</title>"), (4, '<title>ok</title><div id="captcha"></div>')],
                               "page_id long, html string")
    got = {r.page_id: (r.a, r.b, r.c) for r in df.select(
        "page_id", pg.blocked(F.col("html"), "a").alias("a"), pg.blocked(F.col("html"), "b").alias("b"),
        pg.blocked(F.col("html"), "c").alias("c")).collect()}
    assert got == {1: (True, False, False), 2: (True, True, True), 3: (False, False, False), 4: (False, True, False)}


def test_island_first_parsing_pattern_wins(spark):
    html = ('<script id="__NEXT_DATA__">{broken</script>'
            '<script>window.S = {"props": {"pageProps": {"listings": [{"id": 7}]}}};</script>')
    v = pg.extract_json_island(F.col("html"), [pg.NEXT_DATA_PATTERN, r"(?s)window\.S = (\{.*?\});</script>"])
    r = page(spark, html).select(F.try_variant_get(v, "$.props.pageProps.listings[0].id", "int").alias("x")).first()
    assert r.x == 7
    assert page(spark, "<p>nothing</p>").select(pg.extract_json_island(F.col("html")).alias("v")).first().v is None


def test_layout_a_string_results_and_fallback_keys(spark):
    body = '{"props":{"pageProps":{"searchResults":"[{\\"listingId\\": 5, \\"listPrice\\": 0, \\"price\\": null, \\"address\\": {\\"streetAddress\\": \\"1 Elm\\"}, \\"bedrooms\\": 2}]"}}}'
    rows = pt.map_portal(page(spark, ISLAND.format(body)), "a").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.ListingKey, r.ParcelNumber, r.UnparsedAddress, r.ListPrice, r.BedroomsTotal) == \
        ("portal_a_5", "PUBLIC-portal_a-5", "1 Elm", None, 2)


def test_layout_a_cards_when_no_json(spark):
    html = ('<div data-rf-test-id="homecard" id="c1"></div><span class="x" data-rf-test-id="homecard"></span>')
    keys = sorted(r.listing_key for r in pt.map_portal_records(page(spark, html), "a").collect())
    assert keys == ["", "c1"]


def test_blocked_page_gives_nothing(spark):
    html = "<title>captcha</title>" + ISLAND.format('{"props":{"pageProps":{"listings":[{"id":1}]}}}')
    assert pt.map_portal(page(spark, html), "c").count() == 0


def test_layout_b_prices_from_text(spark):
    body = '{"props":{"pageProps":{"initialSearchState":{"listings":[{"zpid":"9","price":"$350,000","area":"1,200 sqft"}]}}}}'
    r = pt.map_portal(page(spark, ISLAND.format(body)), "b").first()
    assert (r.ListingKey, r.ListPrice, r.LivingArea, r.value_estimate) == ("portal_b_9", 350000.0, 1200.0, 350000.0)


def test_to_bronze_value_fallback(spark):
    rec = spark.createDataFrame([("portal_a", "1", None, 250000.0, "")],
                                "source string, listing_key string, value_estimate double, list_price double, apn string")
    full = rec.select("*", *[F.lit(None).cast(t).alias(n) for n, t in pt.PORTAL_RECORD_FIELDS if n not in rec.columns])
    r = pt.to_bronze(full).first()
    assert (r.value_estimate, r.ParcelNumber, r.ListingKey) == (250000.0, "PUBLIC-portal_a-1", "portal_a_1")


def test_fallback_rows_when_every_source_is_empty(spark):
    rows = pt.source_fallback(spark, None).collect()
    assert len(rows) == 3 and all(r.search_url for r in rows)
    assert {r.estimate_source for r in rows} == {"public_search_url"}
    assert "richardson" in [r for r in rows if r.source == "portal_a"][0].search_url.lower()


def test_unknown_source_skipped(spark, caplog):
    caplog.set_level(logging.WARNING)
    assert pt.known_sources(["nonexistent"]) == []
    assert "Unknown source" in caplog.text


def test_dry_run_writes_nothing(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "seq")
    landing = str(tmp_path / "landing")
    assert files.write_landing(df, landing, dry_run=True).first().n_records == 5
    assert not os.path.exists(landing)
    assert files.write_landing(df, landing).first().n_records == 5


def test_incremental_pull_state(spark, tmp_path):
    src = spark.createDataFrame([("a", dt.datetime(2020, 1, 1)), ("b", dt.datetime(2020, 2, 1))],
                                "ListingKey string, ModificationTimestamp timestamp_ntz")
    state, landing = str(tmp_path / "_state"), str(tmp_path / "landing")
    assert inc.read_watermark(spark, state) is None
    assert inc.incremental_pull(src, landing, state, dry_run=True).n_records == 2
    assert inc.read_watermark(spark, state) is None          # dry run moves nothing
    r = inc.incremental_pull(src, landing, state)
    assert (r.n_records, r.watermark) == (2, dt.datetime(2020, 2, 1))
    r2 = inc.incremental_pull(src, landing, state)
    assert r2.n_records == 0 and inc.read_watermark(spark, state) == dt.datetime(2020, 2, 1)
    assert inc.incremental_pull(src, landing, state, inclusive=True, dry_run=True).n_records == 1


def test_stream_exactly_once_and_ignores_underscore_files(spark, tmp_path):
    landing, ckpt, out = str(tmp_path / "landing"), str(tmp_path / "_ckpt"), str(tmp_path / "bronze")
    rows = spark.createDataFrame([("P1", "L1", 100.0)], "ParcelNumber string, ListingKey string, ListPrice double")
    files.write_landing(rows, landing, label="b1")
    os.makedirs(landing, exist_ok=True)
    with open(os.path.join(landing, "_watermark.txt"), "w") as f:
        f.write("2020-01-01T00:00:00Z")
    run_bronze(spark, landing, ckpt, target_path=out)
    files.write_landing(rows.withColumn("ListingKey", F.lit("L2")), landing, label="b2")
    run_bronze(spark, landing, ckpt, target_path=out)
    run_bronze(spark, landing, ckpt, target_path=out)
    df = spark.read.parquet(out)
    assert sorted(r.ListingKey for r in df.collect()) == ["L1", "L2"]
    assert df.filter(F.col(CORRUPT_COL).isNotNull()).count() == 0


def test_corrupt_lines_quarantined(spark, tmp_path):
    p = tmp_path / "landing" / "b"
    p.mkdir(parents=True)
    (p / "part.json").write_text('{"ListingKey": "L1"}\n{"ListingKey": \n')
    df = files.read_bronze(spark, str(tmp_path / "landing")).cache()
    assert files.good_rows(df).count() == 1 and files.quarantine(df).count() == 1


def test_search_orchestrator(spark, tmp_path):
    a = ISLAND.format('{"props":{"pageProps":{"homes":[{"id":"1","price":100},{"id":"2","price":0}]}}}')
    b = ISLAND.format('{"props":{"pageProps":{"searchPageState":{"cat1":{"searchResults":[{"zpid":"9"}]}}}}}')
    out = pt.search(spark, {"portal_a": page(spark, a), "portal_b": page(spark, b)},
                    requested=["portal_a", "portal_b", "portal_c", "nope"])
    rows = {r.ListingKey: r for r in out.collect()}
    assert set(rows) == {"portal_a_1", "portal_a_2", "portal_b_9", "portal_c_portal_c_search_url"}
    assert rows["portal_a_2"].ListPrice is None
    assert rows["portal_c_portal_c_search_url"].search_url.endswith("/3b-2b/for-sale/")
    n = files.write_portal_batch(out, str(tmp_path / "landing")).first().n_records
    assert n == 4
    (batch,) = os.listdir(tmp_path / "landing")
    assert batch.startswith("public_search_") and "T" in batch.split("_")[2]


def test_pull_without_modification_time(spark, tmp_path):
    src = spark.createDataFrame([("1", 200000), ("2", 300000)], "ListingKey string, ListPrice int")
    state, landing = str(tmp_path / "_state"), str(tmp_path / "landing")
    r = inc.incremental_pull(src, landing, state, select=["ListingKey", "ListPrice"])
    assert r.n_records == 2 and r.watermark is not None
    assert inc.read_watermark(spark, state) == r.watermark
    empty = src.filter("false")
    assert inc.incremental_pull(empty, landing, state).n_records == 0
    assert inc.read_watermark(spark, state) == r.watermark


def test_corrupt_only_queries_are_legal(spark, tmp_path):
    p = tmp_path / "landing" / "b"
    p.mkdir(parents=True)
    (p / "part.json").write_text('{"ListingKey": "L1"}\nnot json\n')
    df = files.read_bronze(spark, str(tmp_path / "landing"))
    assert files.quarantine(df).count() == 1
    assert files.good_rows(df).count() == 1


def test_large_parcel_ids_keep_their_own_numbers(spark):
    from dealscreen import fixtures as fx

    orders = spark.createDataFrame([(6 * p, p, 1000.0, "1999-01-01", "x") for p in (1234567, 1234568, 12)],
                                   "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string, o_orderpriority string")
    rows = orders.selectExpr("*", *fx.KEY_EXPRS).selectExpr("*", fx.BASE_EXPR).selectExpr(*fx.BRONZE_EXPRS).collect()
    assert len({r.ParcelNumber for r in rows}) == 3 and {r.PostalCode for r in rows} == {"1234567", "1234568", "00012"}
    assert any("000012-ab" in r.ParcelNumber for r in rows)


def test_stream_and_batch_see_the_same_files(spark, tmp_path):
    from dealscreen.sources import files
    from dealscreen.streaming.bronze import run_bronze

    df = spark.createDataFrame([("L1", 1.5)], "ListingKey string, ListPrice double")
    landing = str(tmp_path / "landing")
    for sub in ("a", "b/c", "d/e/f"):
        df.write.json(f"{landing}/{sub}")
    assert run_bronze(spark, landing, str(tmp_path / "ckpt"), target_path=str(tmp_path / "out")) >= 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == files.read_bronze(spark, landing).count() == 3
    assert run_bronze(spark, landing, str(tmp_path / "ckpt"), target_path=str(tmp_path / "out")) == 0


def test_pull_with_microseconds_lands_once(spark, tmp_path):
    import datetime as dt

    from dealscreen.sources import incremental as inc

    times = [dt.datetime(2024, 5, 1, 12, 0, 0, 123456), dt.datetime(2024, 5, 1, 12, 0, 0, 654321)]
    src = spark.createDataFrame([(f"L{i}", t) for i, t in enumerate(times)], "ListingKey string, ModificationTimestamp timestamp_ntz")
    state, landing = str(tmp_path / "state"), str(tmp_path / "landing")
    first = inc.incremental_pull(src, landing, state)
    again = inc.incremental_pull(src, landing, state)
    assert (first.n_records, first.watermark, again.n_records, again.batch_path) == (2, times[1], 0, None)
    assert inc.read_watermark(spark, state) == times[1]
    landed = spark.read.schema(src.schema).json(first.batch_path)
    assert {r.ModificationTimestamp for r in landed.collect()} == set(times)


def test_estimates_without_order_columns(spark):
    from dealscreen.plans.silver import quarantined_estimates, silver_value_estimates

    feed = spark.createDataFrame([("1-a", 10.0, "avm"), ("1-a", 12.0, "avm"), (None, 1.0, "avm"), ("2", 5.0, None)],
                                 "ParcelNumber string, value_estimate double, estimate_source string")
    assert [tuple(r) for r in silver_value_estimates([feed]).collect()] == [("1A", 12.0, "avm")]
    assert quarantined_estimates([feed]).count() == 2


def test_portal_reads_only_the_fields_that_are_asked_for(spark):
    html = ('<script id="__NEXT_DATA__">{"props": {"pageProps": {"searchPageState": {"cat1": {"searchResults": '
            '[{"zpid": "7", "area": "9 sqft"}, {"id": "8"}]}}}}}</script>')
    found = pt.map_portal(spark.createDataFrame([(1, html)], "page_id long, html string"), "b").select("source", "ListingKey")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "$.zpid" in plan and "$.area" not in plan
    assert sorted(r.ListingKey for r in found.collect()) == ["portal_b_7", "portal_b_8"]
