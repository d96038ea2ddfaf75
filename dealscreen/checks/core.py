"""Checks of the silver / gold / serving operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscreen import fixtures
from dealscreen import oracle_sql as osql
from dealscreen.checks import register
from dealscreen.config import Assumptions
from dealscreen.operators import serve
from dealscreen.operators.rank import rank_deals, top_k_deals
from dealscreen.operators.screen import deal_screen, join_values
from dealscreen.operators.triangulate import value_triangulation
from dealscreen.plans.gold import gold_deal_screen
from dealscreen.plans.silver import silver_listings, silver_value_estimates
from dealscreen.schemas import GOLD_DEAL_SCREEN_COLS


# --------------------------------------------------------------------------- #
# Shared inputs
# --------------------------------------------------------------------------- #
def bronze(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.bronze_listings(spark, sf)


def listings(spark: SparkSession, sf: str) -> DataFrame:
    return silver_listings(bronze(spark, sf))


def estimates(spark: SparkSession, sf: str) -> DataFrame:
    return silver_value_estimates([fixtures.estimate_feed(spark, sf)], fixtures.ESTIMATE_ORDER)


def gold(spark: SparkSession, sf: str, a: Assumptions | None = None, method: str = "exact") -> DataFrame:
    values = value_triangulation(estimates(spark, sf), method, a)
    return gold_deal_screen(listings(spark, sf), values, a)


def served(spark: SparkSession, sf: str) -> DataFrame:
    """The ranked table as it is served, written anew for each query."""
    from dealscreen.config import scratch_path
    from dealscreen.operators.rank import rank

    return rank(gold(spark, sf), target_path=scratch_path(spark, "served"))


# Fixed value: the parcel looked up by the point query (parcel 1 of the adapter).
LOOKUP_APN = "000001AB1"

# --------------------------------------------------------------------------- #
# Silver
# --------------------------------------------------------------------------- #
register("silver_listings", osql.with_base(osql.silver_listings_cte()) + "\nSELECT * FROM silver_listings")(
    lambda spark, sf: listings(spark, sf))

register("silver_value_estimates",
         osql.with_base(osql.silver_estimates_cte()) + "\nSELECT * FROM silver_value_estimates")(
    lambda spark, sf: estimates(spark, sf))

register("dedup_listing_latest",
         osql.with_base(osql.silver_listings_cte())
         + "\nSELECT listing_key, list_price, annual_property_tax, monthly_hoa FROM silver_listings")(
    lambda spark, sf: listings(spark, sf).select("listing_key", "list_price", "annual_property_tax", "monthly_hoa"))

register("dedup_estimate_latest",
         osql.with_base(osql.silver_estimates_cte())
         + "\nSELECT apn, estimate_source, value_estimate FROM silver_value_estimates")(
    lambda spark, sf: estimates(spark, sf).select("apn", "estimate_source", "value_estimate"))

# --------------------------------------------------------------------------- #
# Gold
# --------------------------------------------------------------------------- #
for _m in ("exact", "approx"):
    register(f"triangulation_{_m}",
             osql.with_base(osql.silver_estimates_cte(), osql.triangulation_cte(_m)) + "\nSELECT * FROM tri")(
        (lambda m: lambda spark, sf: value_triangulation(estimates(spark, sf), m))(_m))

register("screen_value_join",
         osql.with_base(osql.silver_listings_cte(), osql.silver_estimates_cte(), osql.triangulation_cte())
         + "\nSELECT l.listing_key, l.apn, t.value_estimate, t.value_confidence, t.n_sources"
           "\nFROM silver_listings l LEFT JOIN tri t ON l.apn = t.apn")(
    lambda spark, sf: join_values(
        listings(spark, sf), value_triangulation(estimates(spark, sf)),
        ("value_estimate", "value_confidence", "n_sources"),
    ).select("listing_key", "apn", "value_estimate", "value_confidence", "n_sources"))

register("deal_screen", osql.gold_ctes() + "\nSELECT * FROM gold")(lambda spark, sf: gold(spark, sf))

register("rank_default",
         osql.gold_ctes() + "\nSELECT listing_key, passes, equity_after_close, rank_score FROM gold")(
    lambda spark, sf: gold(spark, sf).select("listing_key", "passes", "equity_after_close", "rank_score"))

# The same rank over four times as many ranges: the result must not depend on
# the partition count.
register("rank_distributed", osql.gold_ctes() + "\nSELECT listing_key, rank_score FROM gold")(
    lambda spark, sf: rank_deals(
        deal_screen(listings(spark, sf), value_triangulation(estimates(spark, sf))),
        num_partitions=4 * int(spark.conf.get("spark.sql.shuffle.partitions")),
    ).select("listing_key", "rank_score"))

register("top_deals", osql.gold_ctes() + "\nSELECT * FROM gold ORDER BY rank_score LIMIT 50")(
    lambda spark, sf: serve.top_deals(served(spark, sf)))

register("top_deals_direct", osql.gold_ctes() + "\nSELECT * FROM gold ORDER BY rank_score LIMIT 50")(
    lambda spark, sf: top_k_deals(
        deal_screen(listings(spark, sf), value_triangulation(estimates(spark, sf))), 50
    ).select(*GOLD_DEAL_SCREEN_COLS))

register("top_deals_filtered",
         osql.gold_ctes() + f"\nSELECT * FROM gold WHERE passes = TRUE AND dscr >= {osql.d(1.3)} "
                            "ORDER BY rank_score LIMIT 50")(
    lambda spark, sf: serve.top_deals(served(spark, sf), 50, min_dscr=1.3, passes_only=True))

register("deal_by_apn",
         osql.gold_ctes() + f"\nSELECT * FROM gold WHERE apn = '{LOOKUP_APN}' ORDER BY rank_score LIMIT 1")(
    lambda spark, sf: serve.deal_by_apn(served(spark, sf), LOOKUP_APN))

# --------------------------------------------------------------------------- #
# Custom assumptions (per-tenant underwriting) and ML features
# --------------------------------------------------------------------------- #
# The alternative underwriting used by the assumption checks.
CUSTOM = Assumptions(annual_rate=0.0625, term_years=25, ltv_target=0.8, annual_insurance=2400.0,
                     rent_to_price_monthly=0.009, closing_pct=0.025, dscr_threshold=1.1)
ZERO_RATE = Assumptions(annual_rate=0.0, term_years=15)

register("screen_custom_assumptions", osql.gold_ctes(CUSTOM) + "\nSELECT * FROM gold")(
    lambda spark, sf: gold(spark, sf, CUSTOM))

register("screen_zero_rate", osql.gold_ctes(ZERO_RATE) + "\nSELECT * FROM gold")(
    lambda spark, sf: gold(spark, sf, ZERO_RATE))

register("deal_screen_approx", osql.gold_ctes(method="approx") + "\nSELECT * FROM gold")(
    lambda spark, sf: gold(spark, sf, method="approx"))


def _ml(spark: SparkSession, sf: str) -> DataFrame:
    from dealscreen.plans.ml_features import ml_features

    b = bronze(spark, sf).withColumn("value_estimate", F.expr(fixtures.OWN_ESTIMATE))
    return ml_features(b, value_triangulation(estimates(spark, sf)))


register("ml_features",
         osql.with_base(osql.silver_estimates_cte(), osql.triangulation_cte(), osql.ml_features_ctes())
         + "\nSELECT * FROM ml")(_ml)

register("investment_grade",
         osql.with_base(osql.silver_estimates_cte(), osql.triangulation_cte(), osql.ml_features_ctes())
         + "\nSELECT listing_key, dscr, ltv, instant_equity, heuristic_investment_grade FROM ml")(
    lambda spark, sf: _ml(spark, sf).select("listing_key", "dscr", "ltv", "instant_equity",
                                            "heuristic_investment_grade"))

# --------------------------------------------------------------------------- #
# Ranking with and without a model, end-to-end pipeline
# --------------------------------------------------------------------------- #


def _rank_fallback(spark: SparkSession, sf: str) -> DataFrame:
    from dealscreen.config import scratch_path
    from dealscreen.operators.rank import rank

    # No model is saved at this path: the deterministic rank is written.
    return rank(gold(spark, sf), model_path=scratch_path(spark, "no-model"),
                target_path=scratch_path(spark, "gold_ranked"))


register("rank_fallback", osql.gold_ctes() + "\nSELECT * FROM gold")(_rank_fallback)


def train_rank_model(screen: DataFrame, path: str) -> str:
    """Fit and save a small regression pipeline whose output is ``rank_score``
    (negated predicted pass score: lower is better)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    prep = SQLTransformer(statement=(
        "SELECT *, coalesce(dscr, 0D) AS f_dscr, coalesce(ltv, 1D) AS f_ltv, "
        "coalesce(equity_after_close, 0D) / 100000D AS f_equity, CAST(passes AS DOUBLE) AS label FROM __THIS__"))
    va = VectorAssembler(inputCols=["f_dscr", "f_ltv", "f_equity"], outputCol="features")
    lr = LinearRegression(featuresCol="features", labelCol="label", predictionCol="model_score", maxIter=20)
    post = SQLTransformer(statement="SELECT *, -model_score AS rank_score FROM __THIS__")
    Pipeline(stages=[prep, va, lr, post]).fit(screen.drop("rank_score")).write().overwrite().save(path)
    return path


def _rank_with_model(spark: SparkSession, sf: str) -> DataFrame:
    from dealscreen.config import scratch_path
    from dealscreen.operators.rank import rank

    g = gold(spark, sf)
    path = train_rank_model(g, scratch_path(spark, "rank-model"))
    # The score is the model's; SQL restates the rows it ranks and that every row has a score.
    out = rank(g, model_path=path, target_path=scratch_path(spark, "gold_ranked_model"))
    return out.withColumn("scored", F.col("rank_score").isNotNull()).drop("rank_score")


register("rank_with_model", osql.gold_ctes() + f"\nSELECT {osql.GOLD_COLS}, true AS scored FROM gold")(_rank_with_model)


def _pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    from dealscreen.config import Namespace, scratch_path
    from dealscreen.plans.pipeline import run_pipeline

    ns = Namespace(tenant=f"e2e_{uuid.uuid4().hex[:8]}")
    b = bronze(spark, sf)
    return run_pipeline(spark, b, [fixtures.estimate_feed(spark, sf, b)], ns=ns, a=Assumptions(),
                        estimate_order=fixtures.ESTIMATE_ORDER, location_root=scratch_path(spark, "warehouse"))


register("layers_end_to_end", osql.gold_ctes() + "\nSELECT * FROM gold")(_pipeline)


def _save_rule_model(screen: DataFrame, path: str, statement: str) -> str:
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    Pipeline(stages=[SQLTransformer(statement=statement)]).fit(screen).write().overwrite().save(path)
    return path


def _rank_rule_model(spark: SparkSession, sf: str) -> DataFrame:
    from dealscreen.config import scratch_path
    from dealscreen.operators.rank import rank

    g = gold(spark, sf)
    path = _save_rule_model(g.drop("rank_score"), scratch_path(spark, "rule-model"),
                            "SELECT *, -coalesce(equity_after_close, 0D) AS rank_score FROM __THIS__")
    return rank(g, model_path=path)


register("rank_with_rule_model", osql.gold_ctes() + f"""
SELECT {osql.GOLD_COLS}, -coalesce(equity_after_close, {osql.d(0.0)}) AS rank_score FROM gold""")(_rank_rule_model)


def _rank_model_without_score(spark: SparkSession, sf: str) -> DataFrame:
    from dealscreen.config import scratch_path
    from dealscreen.operators.rank import rank

    g = gold(spark, sf)
    path = _save_rule_model(g.drop("rank_score"), scratch_path(spark, "scoreless-model"),
                            "SELECT *, 1 AS unrelated FROM __THIS__")
    return rank(g, model_path=path)


register("rank_model_without_score", osql.gold_ctes() + "\nSELECT * FROM gold")(_rank_model_without_score)
