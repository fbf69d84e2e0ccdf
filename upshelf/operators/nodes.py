"""Node registry (D22) and weekly node panel.

All six hierarchy levels are handled in one pass: each slice row is expanded
into its six candidate (level, key1, key2) tuples and equi-joined once to the
registry, then summed per (booking, level, node, week).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upshelf.functions.keys import LEVELS, LEVEL_KEYS, node_key
from upshelf.plans.params import DEFAULT, Params

# The twelve weekly regressors (two label shares renamed to
# snake case: brochure "Not on brochure" share, multibuy "Not on Multibuy" share).
NUMERIC_REGRESSORS = ["discountpercent", "max_internal_competitor_discount_percent", "n_competitors",
                      "n_any_cheaper", "n_shelf_cheaper", "n_promo_cheaper_no_hurdle", "n_promo_cheaper_hurdle",
                      "avg_cheaper_gap", "worst_gap", "p90_gap"]
SHARE_REGRESSORS = ["brochure_not_on_brochure", "multibuy_not_on_multibuy"]
REGRESSORS = NUMERIC_REGRESSORS + SHARE_REGRESSORS


# A node in panels and compare rows: its text for reports, and its typed key (k1, k2), which later joins read.
NODE = ["level", "node", "key"]


def _k(level: str, i: int) -> Column:
    keys = LEVEL_KEYS[level]
    return F.col(keys[i]) if i < len(keys) else F.lit("")


def node_registry(skus: DataFrame, promo_dim: DataFrame) -> DataFrame:
    """Per booking the nodes of six levels, limited to promoted SKUs.

    SKU nodes are every promoted article (even unseen in the dimension);
    other levels come from ``promo_dim`` (booking, article, hierarchy of the
    promoted articles selling in the window) with non-null keys.
    Columns: booking, level, node, k1, k2 (k2 '' if unused)."""
    d = promo_dim
    parts = [skus.select("booking_number", F.lit("sku").alias("level"), node_key("sku").alias("node"),
                         F.col("article_id").alias("k1"), F.lit("").alias("k2"))]
    for lv in LEVELS[1:]:
        keys = LEVEL_KEYS[lv]
        sub = d.where(F.col(keys[0]).isNotNull() & F.col(keys[-1]).isNotNull())
        parts.append(sub.select("booking_number", F.lit(lv).alias("level"), node_key(lv).alias("node"),
                                _k(lv, 0).alias("k1"), _k(lv, 1).alias("k2")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def expand_levels(rows: DataFrame, measures: list[str]) -> DataFrame:
    """Each row -> six (level, k1, k2) candidates, keeping ``measures``."""
    cands = F.array(*[F.struct(F.lit(lv).alias("level"), _k(lv, 0).alias("k1"), _k(lv, 1).alias("k2"))
                      for lv in LEVELS])
    return rows.select("booking_number", "week_start", *measures, F.inline(cands))


ARTICLE_WEEK = ["booking_number", "week_start", "article_id", "brand", "category", "subcategory"]


def slice_article_week(slice_rows: DataFrame) -> DataFrame:
    """Slice rows summed to (booking, week, article hierarchy): store detail goes before the six levels are expanded."""
    return slice_rows.groupBy(*ARTICLE_WEEK).agg(F.sum("sales").alias("sales"))


def weekly_panel(slice_agg: DataFrame, registry: DataFrame, target: str = "sales") -> DataFrame:
    """Y per (booking, level, node, key, week) over the booking's slice.

    Input is the slice at (booking, week, article) grain, so store detail
    never crosses the six-way expansion and registry join."""
    pre = slice_agg.select(*ARTICLE_WEEK, F.col(target).alias("y"))
    x = expand_levels(pre, ["y"]).withColumn("key", F.struct("k1", "k2"))
    return (x.join(registry, ["booking_number", "level", "k1", "k2"])
            .groupBy("booking_number", *NODE, "week_start").agg(F.sum("y").alias("y")))


def weekly_regressors(slice_rows: DataFrame, weighting: str = "sales", p: Params = DEFAULT) -> DataFrame:
    """A13/A14 (decision 26): per (booking, week) sales-weighted regressor
    means and label shares over the slice; ``weighting="mean"`` gives the
    unweighted row mean. Regressors that are no column of the rows are left out."""
    s = F.col("sales")
    numeric = [c for c in NUMERIC_REGRESSORS if c in slice_rows.columns]
    if weighting == "sales":
        # exact sums, divided as doubles: a quotient of decimals keeps six places
        def over(x):
            return F.try_divide(F.sum(x * s).cast("double"), F.nullif(F.sum(s).cast("double"), F.lit(0.0)))
        num = [over(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in numeric]
        shares = [over(F.when(F.col("brochure") == p.no_brochure_label, F.lit(1)).otherwise(F.lit(0))).alias("brochure_not_on_brochure"),
                  over(F.when(F.col("multibuy") == p.no_multibuy_label, F.lit(1)).otherwise(F.lit(0))).alias("multibuy_not_on_multibuy")]
    else:
        num = [F.avg(F.col(c).cast("double")).alias(c) for c in numeric]
        shares = [F.avg(F.when(F.col("brochure") == p.no_brochure_label, 1.0).otherwise(0.0)).alias(
                      "brochure_not_on_brochure"),
                  F.avg(F.when(F.col("multibuy") == p.no_multibuy_label, 1.0).otherwise(0.0)).alias(
                      "multibuy_not_on_multibuy")]
    return slice_rows.groupBy("booking_number", "week_start").agg(*num, *shares)


# The ten counterfactual metrics and the new-to keys behind them.
NEW_TO_KEYS = ["sku", "brand", "category", "subcategory"]
METRICS = ["sales", "shoppers"] + [f"new_to_{k}_{m}" for k in NEW_TO_KEYS for m in ("sales", "shoppers")]


def customer_panel(scoped: DataFrame, registry: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """D23/D29 customer metrics per (booking, level, node, week): distinct
    shoppers and new-to-{sku, brand, category, subcategory} shoppers and
    sales, recomputed at every node from scoped lines of the customer plane
    (decision 16; never summed over SKUs or stores).

    Distinct counts avoid the Expand blow-up of several conditional
    ``count_distinct``: rows are first reduced to one per customer and node,
    then flags are summed."""
    from upshelf.functions.weeks import month_diff
    x = scoped.where(F.col("customer_id").isNotNull())
    for name in NEW_TO_KEYS:
        prev = F.when(F.col(f"prev_{name}") >= F.col("lookback_start"), F.col(f"prev_{name}"))
        x = x.withColumn(f"new_{name}", prev.isNull() | (month_diff(F.col("d"), prev) >= p.new_to_months))
    per = (x.groupBy("booking_number", "week_start", "article_id", "brand", "category", "subcategory",
                     "customer_id")
           .agg(*[F.max(f"new_{k}").cast("int").alias(f"has_{k}") for k in NEW_TO_KEYS],
                *[F.sum(F.when(F.col(f"new_{k}"), F.col("sales_amount")).otherwise(F.lit(0))).alias(f"amt_{k}")
                  for k in NEW_TO_KEYS]))
    meas = [f"has_{k}" for k in NEW_TO_KEYS] + [f"amt_{k}" for k in NEW_TO_KEYS] + ["customer_id"]
    e = expand_levels(per, meas).join(registry, ["booking_number", "level", "k1", "k2"]).withColumn("key", F.struct("k1", "k2"))
    cust = e.groupBy("booking_number", *NODE, "week_start", "customer_id").agg(
        *[F.max(f"has_{k}").alias(f"has_{k}") for k in NEW_TO_KEYS],
        *[F.sum(f"amt_{k}").alias(f"amt_{k}") for k in NEW_TO_KEYS])
    return cust.groupBy("booking_number", *NODE, "week_start").agg(
        F.count(F.lit(1)).alias("shoppers"),
        *[F.sum(f"has_{k}").cast("long").alias(f"new_to_{k}_shoppers") for k in NEW_TO_KEYS],
        *[F.sum(f"amt_{k}").alias(f"new_to_{k}_sales") for k in NEW_TO_KEYS])


def long_panel(sales_panel: DataFrame, cust_panel: DataFrame) -> DataFrame:
    """(booking, metric, level, node, key, week, y) for the ten metrics. Node-weeks
    with sales but no valid customer get 0 for the customer metrics."""
    j = sales_panel.withColumnRenamed("y", "sales").join(
        cust_panel, ["booking_number", *NODE, "week_start"], "left")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"),
                               F.coalesce(F.col(m).cast("decimal(38,4)"), F.lit(0).cast("decimal(38,4)")).alias("y"))
                      for m in METRICS])
    return j.select("booking_number", *NODE, "week_start", F.inline(pairs))


def label_mode(df: DataFrame, keys: list[str], label: str, default: str) -> DataFrame:
    """Most frequent non-null label per group; ties -> smallest; a group
    with no label gets ``default``."""
    return df.groupBy(*keys).agg(F.coalesce(F.mode(label, True), F.lit(default)).alias(label))


def one_hot(df: DataFrame, col: str, values: list[str], prefix: str | None = None) -> DataFrame:
    """one 0/1 column per explicit label value."""
    prefix = prefix or col
    return df.select("*", *[F.when(F.col(col) == v, 1.0).otherwise(0.0).alias(
        f"{prefix}_" + "".join(ch if ch.isalnum() else "_" for ch in v.lower())) for v in values])


def weekly_panel_direct(base: DataFrame, registry: DataFrame, windows: DataFrame, stores: DataFrame,
                        target: str = "sales", articles: DataFrame | None = None) -> DataFrame:
    """D23 without the article-level slice: the base is first summed to each
    level's own grain (week, store, level key) in one expand + partial
    aggregation, then joined to the registry, the window and the cohort.

    A category node therefore joins (week × store × category) sums instead of
    every article of the category once per booking; the result equals
    ``weekly_panel`` over the slice (every row matching a node key is in the
    booking's universe)."""
    from upshelf.operators.scope import cohort_filter, in_window
    lo = windows.select(F.min("min_d")).scalar()
    hi = windows.select(F.max("max_d")).scalar()
    base = base.where(F.col("week_start").between(lo, hi))          # weeks inside some campaign window
    if articles is not None:                                          # articles inside some universe
        base = base.join(articles.select("article_id").distinct(), "article_id", "left_semi")
    cands = F.array(*[F.struct(F.lit(lv).alias("level"), _k(lv, 0).alias("k1"), _k(lv, 1).alias("k2"))
                      for lv in LEVELS])
    lv = (base.select("week_start", "store_id", F.col(target).alias("y"), F.inline(cands))
          .groupBy("week_start", "store_id", "level", "k1", "k2").agg(F.sum("y").alias("y")))
    j = lv.join(registry, ["level", "k1", "k2"])
    j = cohort_filter(in_window(j, windows), windows, stores)
    return j.withColumn("key", F.struct("k1", "k2")).groupBy("booking_number", *NODE, "week_start").agg(F.sum("y").alias("y"))
