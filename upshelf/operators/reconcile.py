"""Uplift totals (D26), hierarchy capping (D27) and the uplift grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upshelf.functions.numeric import cap_child, smaller_abs

# Level -> total column, and the grid's report labels.
TOTALS = {
    "sku": "promo_sku_total",
    "brand_category": "brand_category_total",
    "brand_subcategory": "brand_subcategory_total",
    "brand": "brand_total",
    "category": "category_total",
    "subcategory": "subcategory_total",
}
GRID_LABELS = [
    ("promo_sku_total", "Campaign SKUs"),
    ("brand_category_total", "Brand- Category"),
    ("brand_subcategory_total", "Brand- Subcat"),
    ("brand_total", "Whole Brand"),
    ("category_total", "Whole Category"),
    ("subcategory_total", "Whole Sub- category"),
]
METRIC_LABELS = {"sales": "Incremental Sales / Dollars"}


def uplift_totals(compare: DataFrame, keys: tuple[str, ...] = ("booking_number",)) -> DataFrame:
    """Sum of uplift per level; missing levels and all-null sums -> 0."""
    return compare.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(F.col("level") == lv, F.col("uplift"))), F.lit(0)).alias(col)
        for lv, col in TOTALS.items()])


def cap_hierarchy(totals: DataFrame) -> DataFrame:
    """brand×category capped by the smaller-magnitude of brand and
    category; brand×subcategory by brand and subcategory; SKU by the smaller
    of the two *capped* children. Signs are kept."""
    b, c, s = F.col("brand_total"), F.col("category_total"), F.col("subcategory_total")
    bc = cap_child("brand_category_total", smaller_abs(b, c))
    bsc = cap_child("brand_subcategory_total", smaller_abs(b, s))
    t = totals.withColumn("brand_category_total", bc).withColumn("brand_subcategory_total", bsc)
    return t.withColumn("promo_sku_total", cap_child(
        "promo_sku_total", smaller_abs(F.col("brand_category_total"), F.col("brand_subcategory_total"))))


def uplift_grid(capped: DataFrame, metric: str = "sales") -> DataFrame:
    """One labelled report row per campaign."""
    return capped.select(F.col("booking_number").alias("campaign_id"),
                         F.lit(METRIC_LABELS.get(metric, metric)).alias("Metric"),
                         *[F.col(c).alias(label) for c, label in GRID_LABELS])
