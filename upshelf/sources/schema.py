"""Canonical schemas (lower-snake names) and ``conform``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)

TRANSACTIONS = T.StructType([
    T.StructField("txn_date", T.DateType()),
    T.StructField("store_id", T.StringType()),
    T.StructField("price_family", T.StringType()),
    T.StructField("product_number", T.LongType()),
    T.StructField("article_id", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("customer_raw", T.StringType()),
    T.StructField("sales_amount", MONEY),
    T.StructField("sales_org", T.StringType()),
    T.StructField("channel", T.StringType()),
])

COMPETITOR_PRICES = T.StructType([
    T.StructField("product_number", T.LongType()),
    T.StructField("fw_end_date", T.DateType()),
    T.StructField("competitor", T.StringType()),
    T.StructField("shelf_price", MONEY),
    T.StructField("offer1_price", MONEY),
    T.StructField("offer1_qty", T.IntegerType()),
    T.StructField("offer2_price", MONEY),
    T.StructField("offer2_qty", T.IntegerType()),
    T.StructField("own_price", MONEY),
])

PROMOTIONS = T.StructType([
    T.StructField("week_start", T.DateType()),
    T.StructField("price_family", T.StringType()),
    T.StructField("discountpercent", T.DoubleType()),
    T.StructField("brochure", T.StringType()),
    T.StructField("multibuy", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("future_flag", T.StringType()),
])

BOOKINGS = T.StructType([
    T.StructField("booking_number", T.StringType()),
    T.StructField("quote_status", T.StringType()),
    T.StructField("campaign_start_date", T.DateType()),
    T.StructField("campaign_end_date", T.DateType()),
    T.StructField("media_start_date", T.DateType()),
    T.StructField("media_end_date", T.DateType()),
    T.StructField("media", T.StringType()),
    T.StructField("media_location", T.StringType()),
    T.StructField("media_type", T.StringType()),
    T.StructField("opportunity_name", T.StringType()),
    T.StructField("quoteline_sku", T.StringType()),
    T.StructField("store_list", T.StringType()),
])

TYPE_WEIGHTS = T.StructType([
    T.StructField("media_type", T.StringType()),
    T.StructField("weight", T.DoubleType()),
])

# Source column names of the warehouse tables mapped to canonical names.
ALIASES = {
    "BusinessDate": "txn_date", "SiteNumber": "store_id", "PriceFamilyCode": "price_family",
    "ProductNumber": "product_number", "Article": "article_id", "BrandDescription": "brand",
    "CategoryDescription": "category", "SubCategoryDescription": "subcategory",
    "TotalAmountIncludingGST": "sales_amount", "SalesOrganisation": "sales_org",
    "Channel": "channel", "CRN": "customer_raw", "ProdNbr": "product_number",
    "FWEndDate": "fw_end_date", "Competitor": "competitor", "CompStdPrice": "shelf_price",
    "CompOffer1Price": "offer1_price", "CompOffer1Qty": "offer1_qty",
    "CompOffer2Price": "offer2_price", "CompOffer2Qty": "offer2_qty", "WOWStdPrice": "own_price",
    "pwstartdate": "week_start", "petpricefamily": "price_family", "MBTrigger": "multibuy",
    "SalesDistrict": "district", "FutureFlag": "future_flag", "product_id": "article_id",
    "ds": "week_start",
}


def conform(df: DataFrame, schema: T.StructType, aliases: dict | None = None) -> DataFrame:
    """Rename known aliases, cast to the schema, add missing columns as null.

    Text numbers such as ``0E-9`` are coerced with ``try_cast``; bad values
    become null. Extra columns are dropped; column order follows the schema."""
    aliases = {**ALIASES, **(aliases or {})}
    present = set(df.columns)
    cols = []
    for f in schema.fields:
        src = f.name if f.name in present else next(
            (a for a, c in aliases.items() if c == f.name and a in present), None)
        if src is None:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(df.schema[src].dataType, T.StringType) and not isinstance(f.dataType, T.StringType):
            cols.append(F.col(src).try_cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(src).cast(f.dataType).alias(f.name))
    return df.select(*cols)
