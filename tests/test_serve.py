from dealscreen.operators import serve


def ranked(spark):
    rows = [(f"APN{i}", f"L{i}", 1.0 + (i % 5) / 10, i % 2 == 0, i + 1) for i in range(120)]
    return spark.createDataFrame(rows, "apn string, listing_key string, dscr double, passes boolean, rank_score bigint")


def test_default_limit_and_order(spark):
    out = serve.top_deals(ranked(spark)).collect()
    assert len(out) == serve.DEFAULT_LIMIT == 50
    assert [r.rank_score for r in out] == list(range(1, 51))


def test_filters_and(spark):
    out = serve.top_deals(ranked(spark), 10, min_dscr=1.3, passes_only=True).collect()
    assert out and all(r.passes and r.dscr >= 1.3 for r in out)
    assert [r.rank_score for r in out] == sorted(r.rank_score for r in out)


def test_point_lookup(spark):
    assert serve.deal_by_apn(ranked(spark), "APN7").first().listing_key == "L7"
    assert serve.deal_by_apn(ranked(spark), "NONEXISTENT").count() == 0
    # request text is a literal, never SQL
    assert serve.deal_by_apn(ranked(spark), "x' OR '1'='1").count() == 0
