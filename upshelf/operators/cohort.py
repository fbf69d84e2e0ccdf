"""Campaign slices: cohort-week totals (D11), cohort exogenous regressors
and the SKU × store × week scoped slice (D10).

All bookings at once; the new-to planes read one global history (all stores,
all articles), never one per booking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upshelf.functions.keys import LEVEL_KEYS, LEVELS, node_key
from upshelf.functions.numeric import safe_div, weighted_mean
from upshelf.operators import customers as C
from upshelf.operators.nodes import NUMERIC_REGRESSORS
from upshelf.operators.scope import cohort_filter, in_window
from upshelf.plans.params import DEFAULT, Params

EXOG9 = [c for c in NUMERIC_REGRESSORS if c != "max_internal_competitor_discount_percent"]
TARGETS = ["sales", "shoppers", "new_to_sku_sales_13m", "new_to_sku_shoppers_13m", "new_to_brand_sales_13m",
           "new_to_brand_shoppers_13m"]


def base_cohort(base: DataFrame, skus: DataFrame, windows: DataFrame, stores: DataFrame) -> DataFrame:
    """Per (booking, week, product, article): sales over cohort stores and the
    product-week attributes (one value per product-week; ``min`` instead of an
    arbitrary pick, decision 14)."""
    b = cohort_filter(in_window(base.join(skus, "article_id"), windows), windows, stores)
    return b.groupBy("booking_number", "week_start", "product_number", "article_id").agg(
        F.min("brand").alias("brand"), F.min("category").alias("category"), F.min("subcategory").alias("subcategory"),
        *[F.min(c).alias(c) for c in ["discountpercent", "multibuy", "brochure", *EXOG9[1:]]],
        F.sum("sales").alias("sales"))


def exog_cohort_week(bc: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per (booking, week) total sales, 9 sales-weighted regressors and
    the two label shares (A13, A14)."""
    s = F.col("sales")
    return bc.groupBy("booking_number", "week_start").agg(
        F.sum(s).alias("sales"),
        *[weighted_mean(c, s).alias(c) for c in EXOG9],
        safe_div(F.sum(F.when(F.col("brochure") == p.no_brochure_label, s).otherwise(F.lit(0))).cast("double"),
                 F.sum(s).cast("double")).alias("brochure_not_on_brochure"),
        safe_div(F.sum(F.when(F.col("multibuy") == p.no_multibuy_label, s).otherwise(F.lit(0))).cast("double"),
                 F.sum(s).cast("double")).alias("multibuy_not_on_multibuy"))


def internal_discount_week(base: DataFrame, promo: DataFrame, skus: DataFrame, windows: DataFrame,
                           stores: DataFrame) -> DataFrame:
    """Per (booking, week) the largest promotion discount over every price
    family the booking's articles carry that week (decision 13)."""
    fams = cohort_filter(in_window(base.join(skus, "article_id"), windows), windows, stores) \
        .select("booking_number", "week_start", "price_family").distinct()
    pr = promo.where((F.col("district") == "National") & (F.col("future_flag") == "PAST")) \
        .select("week_start", "price_family", "discountpercent")
    return (fams.join(pr, ["week_start", "price_family"], "left").groupBy("booking_number", "week_start")
            .agg(F.max(F.coalesce("discountpercent", F.lit(0.0))).alias("max_internal_competitor_discount_percent")))


def cohort_week_totals(base: DataFrame, promo: DataFrame, lines: DataFrame, skus: DataFrame, windows: DataFrame,
                       stores: DataFrame, p: Params = DEFAULT, guard: bool = True) -> DataFrame:
    """One row per (booking, week) with constant hierarchy keys, the
    regressors and six targets. ``lines``: customer plane with the cast
    validator (P6), all stores, with weekly columns of ``sku`` and ``brand_subcat``.

    ``guard`` applies the exactly-one-brand rule (P22): bookings whose
    promoted SKUs span several brands in scope are skipped (see
    ``scope.preflight`` for the reasons)."""
    if guard:
        from upshelf.operators.scope import preflight
        ok = preflight(base, skus, windows, stores).where(F.col("ok")).select("booking_number")
        skus = skus.join(ok, "booking_number", "left_semi")
    bc = base_cohort(base, skus, windows, stores)
    dims = bc.groupBy("booking_number").agg(F.min("brand").alias("brand"), F.min("category").alias("category"),
                                            F.min("subcategory").alias("subcategory"))
    ex = exog_cohort_week(bc, p)
    mcd = internal_discount_week(base, promo, skus, windows, stores)
    cohort_sku = C.scoped_lines(lines, skus, windows, stores)
    shop = cohort_sku.where(F.col("customer_id").isNotNull()).groupBy("booking_number", "week_start") \
        .agg(F.count_distinct("customer_id").alias("shoppers"))
    nsku = C.new_to_week(cohort_sku, "sku", ["week_start"], prefix="new_to_sku", p=p)
    pairs = (bc.where(F.col("brand").isNotNull() & (F.trim("brand") != "") & F.col("subcategory").isNotNull()
                      & (F.trim("subcategory") != ""))
             .select("booking_number", "brand", "subcategory").distinct())
    pair_articles = lines.select("article_id", "brand", "subcategory").distinct().join(pairs, ["brand", "subcategory"]) \
        .select("booking_number", "article_id")
    cohort_bs = C.scoped_lines(lines, pair_articles, windows, stores)
    nbr = C.new_to_week(cohort_bs, "brand_subcat", ["week_start"], prefix="new_to_brand", p=p)
    k = ["booking_number", "week_start"]
    out = (ex.join(dims, "booking_number").join(mcd, k, "left").join(shop, k, "left")
           .join(nsku, k, "left").join(nbr, k, "left"))
    return out.select(
        *k, "brand", "category", "subcategory", "discountpercent",
        F.coalesce("max_internal_competitor_discount_percent", F.lit(0.0)).alias(
            "max_internal_competitor_discount_percent"),
        *EXOG9[1:], "brochure_not_on_brochure", "multibuy_not_on_multibuy", "sales",
        F.coalesce("shoppers", F.lit(0)).alias("shoppers"),
        F.coalesce("new_to_sku_sales_13m", F.lit(0)).alias("new_to_sku_sales_13m"),
        F.coalesce("new_to_sku_shoppers_13m", F.lit(0)).alias("new_to_sku_shoppers_13m"),
        F.coalesce("new_to_brand_sales_13m", F.lit(0)).alias("new_to_brand_sales_13m"),
        F.coalesce("new_to_brand_shoppers_13m", F.lit(0)).alias("new_to_brand_shoppers_13m"))


#: Forecast metric of each target column of the cohort-week totals.
METRIC_OF = {c: c.removesuffix("_13m") for c in TARGETS}


def cohort_panel(totals: DataFrame) -> DataFrame:
    """D24 input from the cohort-week totals (D11): six metrics x six levels in
    long form (booking, metric, level, node, week, y).

    The totals hold no article, so the SKU level is one node, ``ALL``, and a
    booking's row belongs to the one node of each other level that its
    constant hierarchy keys name. A level with a missing key has no node."""
    def node(level: str):
        return F.lit("sku=ALL") if level == "sku" else node_key(level)

    def known(level: str):
        cols = [] if level == "sku" else LEVEL_KEYS[level]
        return F.lit(True) if not cols else F.concat(*[F.col(c) for c in cols]).isNotNull()

    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("decimal(38,4)").alias("y")) for c, m in METRIC_OF.items()])
    nodes = F.filter(F.array(*[F.struct(F.lit(lv).alias("level"), F.when(known(lv), node(lv)).alias("node")) for lv in LEVELS]),
                     lambda n: n["node"].isNotNull())
    return (totals.select("booking_number", "week_start", F.explode(nodes).alias("n"), metrics.alias("metrics"))
            .select("booking_number", "week_start", "n.level", "n.node", F.inline("metrics"))
            .select("booking_number", "metric", "level", "node", "week_start", "y"))


def scoped_slice(base: DataFrame, promo: DataFrame, cl: DataFrame, articles: DataFrame, windows: DataFrame,
                 stores: DataFrame, variant: str = "lag", p: Params = DEFAULT, once=None) -> DataFrame:
    """SKU × store × week slice rows of each booking with shoppers (D4),
    new-to-SKU and new-to-brand (D5 ``lag`` / D7 ``first``; brand key =
    brand×subcategory for ``lag_brand_subcat``), internal competitor features
    (D3), left-joined and zero-filled. ``articles`` is the booking universe,
    ``cl`` its scoped lines of the customer plane.

    ``once(name, table)``, if given, writes a table that the slice is joined from: the plan of each step then stays
    small on the driver, and variants share what they have in common."""
    once = once or (lambda _, x: x())
    rows = once("rows", lambda: cohort_filter(in_window(base.join(articles, "article_id"), windows), windows, stores))
    grain = C.SKU_GRAIN
    mode = "first" if variant == "first" else "lag"
    shop = once("shoppers", lambda: C.shoppers(cl, grain))
    nsku = once(f"sku_{mode}", lambda: C.new_to(cl, "sku", grain, mode=mode, prefix="new_to_sku", p=p))
    if variant == "lag_brand_subcat":
        bgrain = ["week_start", "store_id", "brand", "subcategory"]
        nbr = once("brand_subcat_lag", lambda: C.new_to(cl, "brand_subcat", bgrain, mode="lag", prefix="new_to_brand", p=p))
        bss = once("brand_subcat_shoppers", lambda: C.shoppers(cl, bgrain, "brand_subcategory_shoppers"))
    else:
        bgrain = grain
        nbr = once(f"brand_{mode}", lambda: C.new_to(cl, "brand", grain, mode=mode, prefix="new_to_brand", p=p))
        bss = None
    ic = once("internal", lambda: internal_features_by_booking(rows, promo))
    k = ["booking_number", *grain]
    # these tables are as long as the slice: small in files, they would fill the driver as broadcasts
    out = (rows.join(shop.hint("merge"), k, "left").join(nsku.hint("merge"), k, "left")
           .join(nbr.hint("merge"), ["booking_number", *bgrain], "left")
           .join(ic.hint("merge"), ["booking_number", "week_start", "store_id", "brand", "category"], "left"))
    if bss is not None:
        out = out.join(bss.hint("merge"), ["booking_number", *bgrain], "left")
    zero = ["shoppers", "new_to_sku_shoppers_13m", "new_to_sku_sales_13m", "new_to_brand_shoppers_13m",
            "new_to_brand_sales_13m", "internal_competitor_brochure", "internal_competitor_multibuy",
            "max_internal_competitor_discount_percent"] + (["brand_subcategory_shoppers"] if bss is not None else [])
    return out.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in zero else F.col(c) for c in out.columns])


def internal_features_by_booking(rows: DataFrame, promo: DataFrame) -> DataFrame:
    """D3 inside each booking's slice: the price families present depend on
    the booking's universe, so the booking is part of the key."""
    keys = rows.select("booking_number", "week_start", "store_id", "brand", "category", "price_family").distinct()
    pr = promo.where((F.col("district") == "National") & (F.col("future_flag") == "PAST")) \
        .select("week_start", "price_family", "discountpercent", "brochure", "multibuy")

    def flag(c):
        return F.when(F.lower(c).like("%not%") | F.col(c).isNull(), 0).otherwise(1)

    return (keys.join(pr, ["week_start", "price_family"], "left")
            .groupBy("booking_number", "week_start", "store_id", "brand", "category")
            .agg(F.max(flag("brochure")).alias("internal_competitor_brochure"),
                 F.max(flag("multibuy")).alias("internal_competitor_multibuy"),
                 F.max(F.coalesce("discountpercent", F.lit(0.0))).alias("max_internal_competitor_discount_percent")))


def weekly_internal_discount(rows: DataFrame, promo: DataFrame, weighting: str = "sales") -> DataFrame:
    """Per (booking, week) the mean of the largest discount among the price families of a slice row's (booking, week,
    store, brand, category), weighted by sales or (``"mean"``) by rows.

    A group's rows share the discount, so a group's weight is summed before it: rows are dealt out once, and only with
    these keys. A group with a null key has no discount."""
    pr = promo.where((F.col("district") == "National") & (F.col("future_flag") == "PAST")) \
        .groupBy("week_start", "price_family").agg(F.max(F.coalesce("discountpercent", F.lit(0.0))).alias("_d"))
    c = "max_internal_competitor_discount_percent"
    by = ["store_id", "brand", "category"]
    weight = F.col("sales") if weighting == "sales" else F.lit(1)
    g = (rows.select("booking_number", "week_start", *by, "price_family", weight.alias("_w"))
         .join(pr, ["week_start", "price_family"], "left")
         .groupBy("booking_number", "week_start", *by).agg(F.sum("_w").alias("_w"), F.max(F.coalesce("_d", F.lit(0.0))).alias("_d")))
    known = F.col("store_id").isNotNull() & F.col("brand").isNotNull() & F.col("category").isNotNull()
    d = F.when(known, F.col("_d").cast("double")).otherwise(F.lit(0.0))
    return g.groupBy("booking_number", "week_start").agg(F.try_divide(
        F.sum(d * F.coalesce("_w", F.lit(0))), F.nullif(F.sum("_w").cast("double"), F.lit(0.0))).alias(c))
