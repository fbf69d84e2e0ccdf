"""Weekly base (D1), competitor metrics (D2), internal competitor features (D3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upshelf.functions.weeks import week_start
from upshelf.plans.params import DEFAULT, Params

BASE_KEYS = ["week_start", "store_id", "price_family", "product_number", "article_id",
             "brand", "category", "subcategory"]
COMPETITOR_COLS = ["n_competitors", "n_any_cheaper", "n_shelf_cheaper", "n_promo_cheaper_no_hurdle",
                   "n_promo_cheaper_hurdle", "avg_cheaper_gap", "worst_gap", "p90_gap"]
# 1/11 quantile of the (negative) gap; the warehouse names it "p90".
GAP_QUANTILE = 1.0 / 11
QUANTILE_ACCURACY = 100000


def history_start(p: Params):
    """Rolling history cutoff, ``as_of`` minus ``history_years``."""
    return F.add_months(F.lit(p.as_of), -12 * p.history_years)


def eligible_sales(tx: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """P1 + P2: kept org, positive amount, in-store channel, inside the history."""
    return tx.where((F.col("sales_org") == p.sales_org) & (F.col("sales_amount") > 0)
                    & (F.lower("channel") == p.channel) & (F.col("txn_date") >= history_start(p)))


def promotions_in_scope(promo: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """National, past promotions."""
    return promo.where((F.col("district") == "National") & (F.col("future_flag") == "PAST"))


def promotions_unique(promo: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Decision for repeated (week, price family) keys: one row per key with the
    largest discount and the smallest label, so the base join cannot fan out."""
    return (promotions_in_scope(promo, p).groupBy("week_start", "price_family")
            .agg(F.max("discountpercent").alias("discountpercent"),
                 F.min("brochure").alias("brochure"), F.min("multibuy").alias("multibuy")))


def price_rows(comp: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each price row reduced to its own best option ``o`` (unit price, hurdle quantity) of the shelf price and two
    offers, with ``least`` (nulls skipped), beside its shelf price and own price."""
    c = comp.where(F.col("fw_end_date") >= history_start(p))
    shelf = F.col("shelf_price").cast("double")

    def unit(price, qty):
        return F.try_divide(F.col(price).cast("double"), F.nullif(F.col(qty), F.lit(0)).cast("double"))

    def hurdle(qty):
        return F.when(F.col(qty).isNull() | (F.col(qty) == 1), F.lit(1)).otherwise(F.col(qty))

    opts = [(shelf, F.lit(1)), (unit("offer1_price", "offer1_qty"), hurdle("offer1_qty")),
            (unit("offer2_price", "offer2_qty"), hurdle("offer2_qty"))]
    x = c.select("product_number", week_start("fw_end_date").alias("week_start"), "competitor",
                 shelf.alias("shelf_unit"), F.col("own_price").cast("double").alias("own_price"),
                 *[u.alias(f"u{i}") for i, (u, _) in enumerate(opts)], *[q.alias(f"q{i}") for i, (_, q) in enumerate(opts)])
    bu = F.least(F.col("u0"), F.col("u1"), F.col("u2"))
    bq = F.least(*[F.when(F.col(f"u{i}") == bu, F.col(f"q{i}")) for i in range(3)])
    return x.select("product_number", "week_start", "competitor", "shelf_unit", "own_price",
                    F.struct(bu.alias("unit"), bq.alias("qty")).alias("o"))


def competitor_best_offers(comp: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A2 + U5: per (product, week, competitor) the lowest unit price among the
    shelf price and two offers, its hurdle quantity (tie -> lowest quantity),
    and the lowest shelf price.

    The (sort-based) struct minimum sees one row per price row (see
    ``price_rows``) instead of three exploded options."""
    return (price_rows(comp, p).where(F.col("o.unit").isNotNull())
            .groupBy("product_number", "week_start", "competitor")
            .agg(F.min("o").alias("best"), F.min("shelf_unit").alias("shelf_unit"))
            .select("product_number", "week_start", "competitor",
                    F.col("best.unit").alias("best_unit_price"), F.col("best.qty").alias("hurdle_qty"),
                    "shelf_unit"))


def own_prices(comp: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A3: distinct own shelf prices per (product, week)."""
    return (comp.where(F.col("fw_end_date") >= history_start(p))
            .select("product_number", week_start("fw_end_date").alias("week_start"),
                    F.col("own_price").cast("double").alias("own_price"))
            .distinct())


def offers_with_own_prices(comp: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """``competitor_best_offers`` joined to ``own_prices`` on (product, week), in one pass over the price rows: a
    product-week's few competitors and own prices meet in one group, so neither side is dealt out again."""
    keys = ["product_number", "week_start"]
    x = price_rows(comp, p).where(F.col("product_number").isNotNull() & F.col("week_start").isNotNull())
    per = x.groupBy(*keys, "competitor").agg(
        F.min(F.when(F.col("o.unit").isNotNull(), F.col("o"))).alias("best"),
        F.min(F.when(F.col("o.unit").isNotNull(), F.col("shelf_unit"))).alias("shelf_unit"),
        F.collect_set(F.struct("own_price")).alias("own"))
    week = per.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("best").isNotNull(), F.struct("competitor", "best", "shelf_unit"))).alias("offers"),
        F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"))
    return (week.select(*keys, "offers", F.inline("own")).select(*keys, "own_price", F.inline("offers"))
            .select(*keys, "competitor", F.col("best.unit").alias("best_unit_price"), F.col("best.qty").alias("hurdle_qty"),
                    "shelf_unit", "own_price"))


def competitor_metrics(comp: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per (product, week) competitor counts and price gaps.

    The own-price join is kept as the warehouse has it: several own prices in
    one week multiply the counts (a documented fan-out, decision 10)."""
    j = offers_with_own_prices(comp, p)
    cheaper = F.col("best_unit_price") < F.col("own_price")
    gap = F.when(cheaper, F.col("best_unit_price") - F.col("own_price"))
    return j.groupBy("product_number", "week_start").agg(
        F.count(F.lit(1)).alias("n_competitors"),
        F.count_if(cheaper).alias("n_any_cheaper"),
        F.count_if(cheaper & (F.col("hurdle_qty") == 1) & (F.col("best_unit_price") == F.col("shelf_unit")))
         .alias("n_shelf_cheaper"),
        F.count_if(cheaper & (F.col("hurdle_qty") == 1) & (F.col("best_unit_price") != F.col("shelf_unit")))
         .alias("n_promo_cheaper_no_hurdle"),
        F.count_if(cheaper & (F.col("hurdle_qty") > 1)).alias("n_promo_cheaper_hurdle"),
        F.avg(gap).alias("avg_cheaper_gap"),
        F.min(gap).alias("worst_gap"),
        F.percentile_approx(gap, GAP_QUANTILE, QUANTILE_ACCURACY).alias("p90_gap"),
    )


def weekly_sales(tx: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A1: eligible lines summed to week × store × price family × product × article."""
    return (eligible_sales(tx, p).withColumn("week_start", week_start("txn_date"))
            .groupBy(*BASE_KEYS).agg(F.sum("sales_amount").alias("sales")))


def weekly_base(tx: DataFrame, comp: DataFrame, promo: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The weekly SKU × store sales table with promotion and competitor
    features; missing features take their defaults (0 and the two labels)."""
    s = weekly_sales(tx, p)
    pr = promotions_unique(promo, p)
    cm = competitor_metrics(comp, p)
    j = s.join(pr, ["week_start", "price_family"], "left").join(cm, ["product_number", "week_start"], "left")
    return j.select(
        *BASE_KEYS,
        F.coalesce("discountpercent", F.lit(0.0)).alias("discountpercent"),
        F.coalesce("multibuy", F.lit(p.no_multibuy_label)).alias("multibuy"),
        F.coalesce("brochure", F.lit(p.no_brochure_label)).alias("brochure"),
        "sales",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COMPETITOR_COLS[:5]],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in COMPETITOR_COLS[5:]],
    )


def internal_competitor_features(base: DataFrame, promo: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """D3: per (week, store, brand, category): any brochure, any multibuy and the
    largest discount over the price families present. Repeated promotion keys
    cannot fan out here because every measure is a max."""
    keys = base.select("week_start", "store_id", "brand", "category", "price_family").distinct()
    pr = promotions_in_scope(promo, p).select("week_start", "price_family", "discountpercent",
                                              "brochure", "multibuy")

    def flag(c):
        return F.when(F.lower(c).like("%not%") | F.col(c).isNull(), 0).otherwise(1)

    return (keys.join(pr, ["week_start", "price_family"], "left")
            .groupBy("week_start", "store_id", "brand", "category")
            .agg(F.max(flag("brochure")).alias("internal_competitor_brochure"),
                 F.max(flag("multibuy")).alias("internal_competitor_multibuy"),
                 F.max(F.coalesce("discountpercent", F.lit(0.0)))
                  .alias("max_internal_competitor_discount_percent")))
