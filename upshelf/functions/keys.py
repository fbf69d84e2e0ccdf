"""Product-hierarchy node keys.

A node is (level, key columns). Its text key is ``brand=X|cat=Y`` style; the
six levels and their key columns are fixed values of the modelled app.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hierarchy levels, in report order, and their key columns.
LEVELS = ["sku", "brand", "brand_category", "brand_subcategory", "category", "subcategory"]
LEVEL_KEYS = {
    "sku": ["article_id"],
    "brand": ["brand"],
    "brand_category": ["brand", "category"],
    "brand_subcategory": ["brand", "subcategory"],
    "category": ["category"],
    "subcategory": ["subcategory"],
}
# Text prefixes used in the node key.
KEY_PREFIX = {"article_id": "sku=", "brand": "brand=", "category": "cat=", "subcategory": "subcat="}


def node_key(level: str) -> Column:
    """text key of a node from its key columns."""
    parts = [F.concat(F.lit(KEY_PREFIX[c]), F.col(c)) for c in LEVEL_KEYS[level]]
    return F.concat_ws("|", *parts)


def _part(g: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(g, r"(?:^|\|)" + name + r"=([^|]*)", 1), F.lit(""))


def parse_node_key(g) -> Column:
    """struct(level, product_id, brand, category, subcategory) from a key."""
    g = F.col(g) if isinstance(g, str) else g
    sku, brand, cat, sub = _part(g, "sku"), _part(g, "brand"), _part(g, "cat"), _part(g, "subcat")
    level = (F.when(brand.isNotNull() & cat.isNotNull(), "brand_category")
             .when(brand.isNotNull() & sub.isNotNull(), "brand_subcategory")
             .when(sku.isNotNull(), "sku")
             .when(brand.isNotNull(), "brand")
             .when(cat.isNotNull(), "category")
             .when(sub.isNotNull(), "subcategory"))
    return F.struct(level.alias("level"), sku.alias("product_id"), brand.alias("brand"),
                    cat.alias("category"), sub.alias("subcategory"))
