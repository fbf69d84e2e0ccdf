"""Catalogue entries for D4-D9 over the whole transaction table (open window)."""

from __future__ import annotations

from upshelf.operators import customers as C
from upshelf.plans import inputs as I
from upshelf.plans import oracle as O
from upshelf.plans.catalog import register, tidy

GRAIN = C.SKU_GRAIN


def _lines(spark, sf_dir, validator="regex"):
    return C.global_window(C.customer_lines(I.tx(spark, sf_dir), validator=validator))


@register("shoppers_sku_week", O.with_(O.FX_TX, O.lines_cte()) + f"""
SELECT {", ".join(GRAIN)}, count(DISTINCT customer_id) AS shoppers
FROM lines WHERE customer_id IS NOT NULL GROUP BY {", ".join(GRAIN)}""")
def q_shoppers(spark, sf_dir):
    return tidy(C.shoppers(_lines(spark, sf_dir), GRAIN))


def _lag_entry(name, key_name, grain, mode, prefix):
    sql = O.new_to_lag_sql(C.KEYS[key_name], grain, prefix, mode)

    @register(name, sql)
    def q(spark, sf_dir):
        return tidy(C.new_to(_lines(spark, sf_dir), key_name, grain, mode=mode, prefix=prefix))
    q.__name__ = f"q_{name}"
    return q


_lag_entry("new_to_lag_sku", "sku", GRAIN, "lag", "new_to_sku")
_lag_entry("new_to_lag_brand", "brand", GRAIN, "lag", "new_to_brand")
_lag_entry("new_to_lag_brand_subcat", "brand_subcat", ["week_start", "store_id", "brand", "subcategory"],
           "lag", "new_to_brand")
_lag_entry("new_to_lag_category", "category", ["week_start", "store_id", "category"], "lag", "new_to_category")
_lag_entry("new_to_lag_subcategory", "subcategory", ["week_start", "store_id", "subcategory"], "lag",
           "new_to_subcategory")
_lag_entry("new_to_first_sku", "sku", GRAIN, "first", "new_to_sku")
_lag_entry("new_to_first_brand", "brand", GRAIN, "first", "new_to_brand")


def _week_entry(name, key_name, prefix):
    @register(name, O.new_to_week_sql(C.KEYS[key_name], prefix))
    def q(spark, sf_dir):
        return tidy(C.new_to_week(_lines(spark, sf_dir, "cast"), key_name, ["week_start"], prefix=prefix))
    q.__name__ = f"q_{name}"
    return q


_week_entry("new_to_week_sku", "sku", "new_to_sku")
_week_entry("new_to_week_brand_subcat", "brand_subcat", "new_to_brand")
