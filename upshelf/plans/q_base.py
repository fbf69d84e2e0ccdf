"""Catalogue entries for D1-D3."""

from __future__ import annotations

from upshelf.operators import base as B
from upshelf.plans import inputs as I
from upshelf.plans import oracle as O
from upshelf.plans.catalog import register, tidy

_BASE_OUT = """
SELECT week_start, store_id, price_family, product_number, article_id, brand, category, subcategory,
       discountpercent, multibuy, brochure, CAST(sales AS DOUBLE) AS sales,
       n_competitors, n_any_cheaper, n_shelf_cheaper, n_promo_cheaper_no_hurdle, n_promo_cheaper_hurdle,
       round(avg_cheaper_gap, 6) AS avg_cheaper_gap, worst_gap, p90_gap
FROM base"""


@register("weekly_base", O.with_(*O.BASE_CTES) + _BASE_OUT)
def q_weekly_base(spark, sf_dir):
    return tidy(I.weekly_base_lazy(spark, sf_dir), rounded=["avg_cheaper_gap"])


@register("competitor_metrics", O.with_(O.FX_COMP, O.COMP_METRICS) + """
SELECT product_number, week_start, n_competitors, n_any_cheaper, n_shelf_cheaper,
       n_promo_cheaper_no_hurdle, n_promo_cheaper_hurdle, round(avg_cheaper_gap, 6) AS avg_cheaper_gap,
       worst_gap, p90_gap
FROM cm""")
def q_competitor_metrics(spark, sf_dir):
    return tidy(B.competitor_metrics(I.comp(spark, sf_dir)), rounded=["avg_cheaper_gap"])


@register("internal_competitor_features", O.with_(*O.BASE_CTES) + """,
ic_keys AS (SELECT DISTINCT week_start, store_id, brand, category, price_family FROM base)
SELECT k.week_start, k.store_id, k.brand, k.category,
       CAST(max(CASE WHEN lower(p.brochure) LIKE '%not%' OR p.brochure IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS internal_competitor_brochure,
       CAST(max(CASE WHEN lower(p.multibuy) LIKE '%not%' OR p.multibuy IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS internal_competitor_multibuy,
       max(COALESCE(p.discountpercent, 0.0)) AS max_internal_competitor_discount_percent
FROM ic_keys k LEFT JOIN fx_promo p
  ON p.week_start = k.week_start AND p.price_family = k.price_family
 AND p.district = 'National' AND p.future_flag = 'PAST'
GROUP BY 1, 2, 3, 4""")
def q_internal_competitor_features(spark, sf_dir):
    return tidy(B.internal_competitor_features(I.weekly_base(spark, sf_dir), I.promo(spark, sf_dir)))
