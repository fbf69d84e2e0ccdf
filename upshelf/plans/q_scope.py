"""Catalogue entries for D19-D28 (scope, nodes, counterfactual, grid)."""

from __future__ import annotations

from pyspark.sql import functions as F

from upshelf.operators import forecast as FC
from upshelf.operators import nodes as N
from upshelf.operators import reconcile as R
from upshelf.operators import scope as S
from upshelf.plans import oracle as O
from upshelf.plans.catalog import register, tidy
from upshelf.plans.pipeline import campaigns

W = O.with_(*O.CAMPAIGN_CTES)


@register("product_dim", O.with_(*O.BASE_CTES) +
          "SELECT DISTINCT article_id, product_number, brand, category, subcategory FROM base")
def q_product_dim(spark, sf_dir):
    return S.product_dim(campaigns(spark, sf_dir).base)


@register("sku_universe_wide", W + "SELECT * FROM uni")
def q_universe_wide(spark, sf_dir):
    return campaigns(spark, sf_dir).universe("wide")


@register("sku_universe_narrow", W + "SELECT * FROM uni_narrow")
def q_universe_narrow(spark, sf_dir):
    return campaigns(spark, sf_dir).universe("narrow")


@register("preflight", W + """, pf_br AS (
  SELECT booking_number, count(DISTINCT brand) AS n_brands, min(brand) AS first_brand
  FROM sl WHERE brand IS NOT NULL AND trim(brand) <> ''
    AND article_id IN (SELECT article_id FROM bk_skus k WHERE k.booking_number = sl.booking_number)
  GROUP BY booking_number)
SELECT w.booking_number,
       COALESCE((SELECT count(*) FROM bk_skus k WHERE k.booking_number = w.booking_number), 0) AS n_skus,
       CASE WHEN w.all_stores THEN COALESCE((SELECT count(DISTINCT store_id) FROM sl WHERE sl.booking_number = w.booking_number
              AND sl.article_id IN (SELECT article_id FROM bk_skus k WHERE k.booking_number = w.booking_number)), 0)
            ELSE COALESCE((SELECT count(*) FROM bk_stores k WHERE k.booking_number = w.booking_number), 0) END AS n_stores,
       w.all_stores, COALESCE(b.n_brands, 0) AS n_brands,
       CASE WHEN COALESCE(b.n_brands, 0) = 1 THEN b.first_brand END AS brand,
       CASE WHEN (SELECT count(*) FROM bk_skus k WHERE k.booking_number = w.booking_number) = 0 THEN 'no promo SKUs'
            WHEN COALESCE(b.n_brands, 0) = 0 THEN 'no brand in scope'
            WHEN b.n_brands > 1 THEN 'promo SKUs span ' || CAST(b.n_brands AS VARCHAR) || ' brands' END AS skip_reason,
       COALESCE(b.n_brands, 0) = 1 AS ok,
       (SELECT count(*) FROM media_master m WHERE m.booking_number = w.booking_number) AS n_assets,
       (SELECT count(*) FROM media_master m WHERE m.booking_number = w.booking_number AND NOT EXISTS (
          SELECT 1 FROM base d WHERE list_contains(string_split(m.sorted_sku_list, ','), d.article_id) AND d.brand IS NOT NULL AND d.category IS NOT NULL)) AS n_unknown_assets
FROM bk_win w LEFT JOIN pf_br b ON b.booking_number = w.booking_number""")
def q_preflight(spark, sf_dir):
    return tidy(campaigns(spark, sf_dir).preflight())


@register("node_registry", W + "SELECT booking_number, level, node FROM reg")
def q_node_registry(spark, sf_dir):
    return campaigns(spark, sf_dir).registry().select("booking_number", "level", "node")


@register("weekly_panel_sales", W + "SELECT booking_number, level, node, week_start, CAST(y AS DOUBLE) AS y FROM panel")
def q_weekly_panel(spark, sf_dir):
    return tidy(campaigns(spark, sf_dir).panel().drop("key"))


@register("counterfactual_mean", W + """SELECT booking_number, level, node, ds, CAST(y AS DOUBLE) AS y,
       CAST(yhat AS DOUBLE) AS yhat, CAST(uplift AS DOUBLE) AS uplift FROM cmp""")
def q_counterfactual_mean(spark, sf_dir):
    return tidy(campaigns(spark, sf_dir).compare().drop("key"))


@register("counterfactual_mean_raw", W + f""", rw_yh AS (
  SELECT p.booking_number, p.level, p.node, CAST(floor(CAST(sum(p.y) AS DOUBLE) / count(p.y) * CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE))
              / CAST(1000000 AS DOUBLE) AS DECIMAL(38,6)) AS yhat
  FROM panel p JOIN bk_win w ON w.booking_number = p.booking_number
  WHERE p.week_start >= w.min_d AND p.week_start <= w.train_end_raw GROUP BY p.booking_number, p.level, p.node)
SELECT c.booking_number, c.level, c.node, c.ds, CAST(c.y AS DOUBLE) AS y, CAST(h.yhat AS DOUBLE) AS yhat, CAST(c.y - h.yhat AS DOUBLE) AS uplift
FROM cmp c LEFT JOIN rw_yh h ON h.booking_number = c.booking_number AND h.level = c.level AND h.node = c.node""")
def q_counterfactual_mean_raw(spark, sf_dir):
    """Trained up to the day before the media start."""
    c = campaigns(spark, sf_dir)
    return tidy(FC.counterfactual_mean(c.panel(), c.windows, cutoff="raw").drop("key"))


_NUM = N.NUMERIC_REGRESSORS
_WR = O.with_(*O.slice_ctes("lag"), """wr AS (
  SELECT r.*, COALESCE(i.max_internal_competitor_discount_percent, 0.0) AS max_internal_competitor_discount_percent
  FROM ss_rows r LEFT JOIN ss_ic i ON i.booking_number = r.booking_number AND i.week_start = r.week_start
   AND i.store_id = r.store_id AND i.brand = r.brand AND i.category = r.category)""")


def _label(col, value, weight):
    return f"sum(CASE WHEN {col} = '{value}' THEN {weight} ELSE 0 END)"


@register("weekly_regressors", _WR + "SELECT booking_number, week_start, "
          + ", ".join(f"round(sum(COALESCE({c}, 0) * CAST(sales AS DOUBLE)) / NULLIF(CAST(sum(sales) AS DOUBLE), 0), 5) + 0.0 AS {c}" for c in _NUM)
          + ", " + ", ".join(f"round({_label(col, v, 'CAST(sales AS DOUBLE)')} / NULLIF(CAST(sum(sales) AS DOUBLE), 0), 5) + 0.0 AS {n}" for col, v, n in (
              ("brochure", "Not on brochure", "brochure_not_on_brochure"), ("multibuy", "Not on Multibuy", "multibuy_not_on_multibuy")))
          + " FROM wr GROUP BY booking_number, week_start")
def q_weekly_regressors(spark, sf_dir):
    """The regressors of the wide slice, weighted by sales."""
    return tidy(campaigns(spark, sf_dir).weekly_regressors(), rounded=N.REGRESSORS, digits=5)


@register("weekly_regressors_mean", _WR + "SELECT booking_number, week_start, "
          + ", ".join(f"round(avg(CAST({c} AS DOUBLE)), 9) + 0.0 AS {c}" for c in _NUM)
          + ", " + ", ".join(f"round({_label(col, v, '1.0')} / count(*), 9) + 0.0 AS {n}" for col, v, n in (
              ("brochure", "Not on brochure", "brochure_not_on_brochure"), ("multibuy", "Not on Multibuy", "multibuy_not_on_multibuy")))
          + " FROM wr GROUP BY booking_number, week_start")
def q_weekly_regressors_mean(spark, sf_dir):
    """The unweighted row means."""
    return tidy(campaigns(spark, sf_dir).weekly_regressors("mean"), rounded=N.REGRESSORS, digits=9)


_TOT = ["promo_sku_total", "brand_category_total", "brand_subcategory_total", "brand_total", "category_total",
        "subcategory_total"]


@register("uplift_totals", W + "SELECT booking_number, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _TOT)
          + " FROM tot")
def q_uplift_totals(spark, sf_dir):
    return tidy(R.uplift_totals(campaigns(spark, sf_dir).compare()))


@register("uplift_grid", W + """SELECT booking_number AS campaign_id, 'Incremental Sales / Dollars' AS "Metric",
       CAST(promo_sku_total AS DOUBLE) AS "Campaign SKUs", CAST(brand_category_total AS DOUBLE) AS "Brand- Category",
       CAST(brand_subcategory_total AS DOUBLE) AS "Brand- Subcat", CAST(brand_total AS DOUBLE) AS "Whole Brand",
       CAST(category_total AS DOUBLE) AS "Whole Category", CAST(subcategory_total AS DOUBLE) AS "Whole Sub- category"
FROM capped""")
def q_uplift_grid(spark, sf_dir):
    return tidy(campaigns(spark, sf_dir).grid())


_CW = O.with_(*O.COHORT_FORECAST_CTES)


@register("counterfactual_cohort", _CW + """SELECT booking_number, metric, level, node, ds, CAST(y AS DOUBLE) AS y,
       CAST(yhat AS DOUBLE) AS yhat, CAST(uplift AS DOUBLE) AS uplift FROM cf_cmp""")
def q_counterfactual_cohort(spark, sf_dir):
    """D24 over the cohort-week totals: six metrics x six levels of every booking."""
    return tidy(campaigns(spark, sf_dir).compare_cohort())


@register("uplift_totals_cohort", _CW + "SELECT booking_number, metric, "
          + ", ".join(f"CAST(COALESCE(sum(CASE WHEN level = '{lv}' THEN uplift END), 0) AS DOUBLE) AS {c}" for lv, c in
                      zip(("sku", "brand_category", "brand_subcategory", "brand", "category", "subcategory"), _TOT))
          + " FROM cf_cmp GROUP BY booking_number, metric")
def q_uplift_totals_cohort(spark, sf_dir):
    return tidy(R.uplift_totals(campaigns(spark, sf_dir).compare_cohort(), keys=("booking_number", "metric")))


@register("counterfactual_cohort_ridge", _CW + """SELECT booking_number, metric, level, node, ds, y, round(yhat, 4) + 0.0 AS yhat,
       round(y - yhat, 4) + 0.0 AS uplift FROM cf_ridge""")
def q_counterfactual_cohort_ridge(spark, sf_dir):
    """Ridge on two of the cohort's own weekly regressors."""
    c = campaigns(spark, sf_dir)
    two = ["discountpercent", "n_competitors"]
    out = FC.counterfactual_ridge(c.cohort_panel(), c.windows, c.cohort_week_totals().select("booking_number", "week_start", *two),
                                  keys=("metric",), features=two)
    return tidy(out, rounded=["yhat", "uplift"], digits=4)


@register("counterfactual_ridge")
def q_counterfactual_ridge(spark, sf_dir):
    """Ridge learner with all regressors; tests compare it with a NumPy solve per node."""
    c = campaigns(spark, sf_dir)
    return FC.counterfactual_ridge(c.panel(), c.windows, c.regressors(), alpha=1.0).drop("key")


@register("counterfactual_full", O.with_(*O.FULL_CTES) + """SELECT booking_number, metric, level, node, ds,
       CAST(y AS DOUBLE) AS y, CAST(yhat AS DOUBLE) AS yhat, CAST(uplift AS DOUBLE) AS uplift FROM fcmp""")
def q_counterfactual_full(spark, sf_dir):
    """Ten metrics × six levels in one plan."""
    return tidy(campaigns(spark, sf_dir).compare_full().drop("key"))


@register("uplift_totals_full", O.with_(*O.FULL_CTES) + """SELECT booking_number, metric,
       CAST(COALESCE(sum(CASE WHEN level = 'sku' THEN uplift END), 0) AS DOUBLE) AS promo_sku_total,
       CAST(COALESCE(sum(CASE WHEN level = 'brand_category' THEN uplift END), 0) AS DOUBLE) AS brand_category_total,
       CAST(COALESCE(sum(CASE WHEN level = 'brand_subcategory' THEN uplift END), 0) AS DOUBLE) AS brand_subcategory_total,
       CAST(COALESCE(sum(CASE WHEN level = 'brand' THEN uplift END), 0) AS DOUBLE) AS brand_total,
       CAST(COALESCE(sum(CASE WHEN level = 'category' THEN uplift END), 0) AS DOUBLE) AS category_total,
       CAST(COALESCE(sum(CASE WHEN level = 'subcategory' THEN uplift END), 0) AS DOUBLE) AS subcategory_total
FROM fcmp GROUP BY booking_number, metric""")
def q_uplift_totals_full(spark, sf_dir):
    return tidy(R.uplift_totals(campaigns(spark, sf_dir).compare_full(), keys=("booking_number", "metric")))


@register("counterfactual_gbt")
def q_counterfactual_gbt(spark, sf_dir):
    """Pooled gradient-boosted-trees learner (MLlib); no SQL oracle."""
    c = campaigns(spark, sf_dir)
    return FC.counterfactual_gbt(c.panel(), c.windows, c.regressors()).drop("key")


@register("counterfactual_dynamic", O.with_(*O.CAMPAIGN_CTES, O.DYNAMIC) + """SELECT booking_number, level, node, ds, CAST(y AS DOUBLE) AS y,
       CAST(yhat AS DOUBLE) AS yhat, CAST(uplift AS DOUBLE) AS uplift FROM dyn_cmp""")
def q_counterfactual_dynamic(spark, sf_dir):
    """Mean learner over dynamic (per-week) cohorts."""
    return tidy(campaigns(spark, sf_dir).compare_dynamic().drop("key"))
