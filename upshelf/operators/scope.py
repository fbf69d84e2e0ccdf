"""Campaign scope: product dimension (D19), SKU universe (D20), preflight and
brand guard (D21, P22), and the per-campaign slice rows that feed the panel.

Campaigns are data: every function works on all bookings at once, keyed by
``booking_number``. Date windows are turned into equi-joins by exploding each
booking's window into its weeks (a few dozen rows per booking), so no range
or cartesian join appears in any plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upshelf.plans.params import DEFAULT, Params

DIM_COLS = ["article_id", "product_number", "brand", "category", "subcategory"]
# The universe levels and their key columns.
UNIVERSE_LEVELS = {
    "sku": ["article_id"],
    "brand": ["brand"],
    "brand_category": ["brand", "category"],
    "brand_subcategory": ["brand", "subcategory"],
    "category": ["category"],
    "subcategory": ["subcategory"],
}
NARROW_LEVELS = ["sku", "brand_subcategory"]


def product_dim(base: DataFrame) -> DataFrame:
    """Distinct article × product × brand × category × subcategory."""
    return base.select(*DIM_COLS).distinct()


def in_window(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of ``df`` (with booking_number, week_start) inside the pull window:
    an equi-join on the booking (one window row per booking) plus a filter."""
    w = windows.select("booking_number", F.col("min_d").alias("_lo"), F.col("max_d").alias("_hi"))
    return (df.join(w, "booking_number").where(F.col("week_start").between(F.col("_lo"), F.col("_hi")))
            .drop("_lo", "_hi"))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` dealt to as many tasks as the session has shuffle partitions. Every row meets all its bookings next, so
    tasks merged by the size of their input would hold many times that in their aggregates."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def dim_weeks(base: DataFrame) -> DataFrame:
    """Distinct (week, article, hierarchy) of the base: store detail removed
    before anything is replicated per booking."""
    return base.select("week_start", *DIM_COLS).distinct()


def promo_dim(base: DataFrame, skus: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct (booking, article, hierarchy) of promoted articles selling
    inside the booking's window (the slice's product dimension)."""
    j = skus.join(dim_weeks(base), "article_id")
    return in_window(j, windows).select("booking_number", *DIM_COLS).distinct()


def sku_universe(base: DataFrame, skus: DataFrame, windows: DataFrame, mode: str = "wide",
                 promo: DataFrame | None = None, dim: DataFrame | None = None) -> DataFrame:
    """(booking, article_id) of the analysis universe.

    wide: promoted SKUs ∪ whole brands ∪ brand×category ∪ brand×subcategory ∪
    categories ∪ subcategories; narrow: promoted SKUs ∪ brand×subcategory.
    Only articles selling inside the booking's window count (J18 + U1)."""
    promo = promo_dim(base, skus, windows) if promo is None else promo
    dim = product_dim(base) if dim is None else dim
    cand = candidates(skus, promo, dim, mode)
    active = base.select("week_start", "article_id").distinct()
    return in_window(active.join(cand, "article_id"), windows).select("booking_number", "article_id").distinct()


def cohort_filter(df: DataFrame, windows: DataFrame, stores: DataFrame) -> DataFrame:
    """Keep rows (booking, store_id, ...) whose store is in the booking's cohort;
    bookings flagged ``all_stores`` keep every store (P16). One left join on
    (booking, store) plus a filter — never ``OR IN`` and never two passes."""
    flag = windows.select("booking_number", F.col("all_stores").alias("_all"))
    st = stores.select("booking_number", "store_id", F.lit(True).alias("_in"))
    return (df.join(flag, "booking_number").join(st, ["booking_number", "store_id"], "left")
            .where(F.col("_all") | F.col("_in").isNotNull()).drop("_all", "_in"))


def candidates(skus: DataFrame, promo: DataFrame, dim: DataFrame, mode: str = "wide") -> DataFrame:
    """(booking, article) members of the universe by hierarchy alone, from the
    article-level dimension (no weeks). brand ⊇ brand×category and
    brand×subcategory, so the wide universe needs four joins, not six."""
    d = dim.select("article_id", "brand", "category", "subcategory").distinct()
    parts = [skus.select("booking_number", "article_id")]
    levels = [["brand"], ["category"], ["subcategory"]] if mode == "wide" else [["brand", "subcategory"]]
    for keys in levels:
        src = promo.select("booking_number", *keys).distinct()
        parts.append(d.join(src, keys).select("booking_number", "article_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def slice_rows(base: DataFrame, universe: DataFrame, windows: DataFrame, stores: DataFrame) -> DataFrame:
    """Base rows of each booking: universe articles, cohort stores, window weeks.

    ``universe`` may be the hierarchy candidates: a base row inside the window
    proves the article sells there, so no separate activity check is needed."""
    j = spread(base, "article_id").join(universe, "article_id")
    return cohort_filter(in_window(j, windows), windows, stores)


def preflight(base: DataFrame, skus: DataFrame, windows: DataFrame, stores: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """D21 + P22: per booking SKU / store counts, distinct non-blank brands in
    scope, and the skip reason; ``ok`` is the exactly-one-brand guard. A
    booking over all stores counts the stores that sell its SKUs in its
    window (A18). ``assets`` (booking, n_assets, n_unknown_assets) is added."""
    n_sku = skus.groupBy("booking_number").agg(F.count(F.lit(1)).alias("n_skus"))
    n_st = stores.groupBy("booking_number").agg(F.count(F.lit(1)).alias("n_listed"))
    named = F.when(F.col("brand").isNotNull() & (F.trim("brand") != ""), F.col("brand"))
    rows = slice_rows(base, skus, windows, stores).select("booking_number", "store_id", named.alias("brand")).distinct()
    br = rows.groupBy("booking_number").agg(F.count_distinct("brand").alias("n_brands"), F.min("brand").alias("first_brand"))
    sold = rows.select("booking_number", "store_id").distinct().groupBy("booking_number").agg(F.count(F.lit(1)).alias("n_sold"))
    j = windows.select("booking_number", "all_stores")
    for more in (n_sku, n_st, br, sold, assets):
        j = j if more is None else j.join(more, "booking_number", "left")
    nb = F.coalesce("n_brands", F.lit(0))
    reason = (F.when(F.coalesce("n_skus", F.lit(0)) == 0, "no promo SKUs")
              .when(nb == 0, "no brand in scope")
              .when(nb > 1, F.concat(F.lit("promo SKUs span "), nb.cast("string"), F.lit(" brands"))))
    counted = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_assets", "n_unknown_assets") if assets is not None]
    return j.select("booking_number", F.coalesce("n_skus", F.lit(0)).alias("n_skus"),
                    F.coalesce(F.when(F.col("all_stores"), F.col("n_sold")).otherwise(F.col("n_listed")), F.lit(0)).alias("n_stores"), "all_stores",
                    nb.alias("n_brands"), F.when(nb == 1, F.col("first_brand")).alias("brand"),
                    reason.alias("skip_reason"), reason.isNull().alias("ok"), *counted)
