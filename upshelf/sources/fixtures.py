"""Adapters from the driver's TPC-H-style tables to the four logical inputs.

The modelled app reads a transaction-line table (T1), competitor prices (T2),
a promotion calendar (T3) and raw media bookings (T4). The test data has none
of these, so each is derived from ``lineitem / orders / part / supplier`` by a
fixed mapping (documented in FIXTURES.md). The DuckDB oracle inlines the same
mapping as CTEs (``upshelf.plans.oracle.PRELUDE``).

All adapters are lazy DataFrame expressions with explicit column pruning.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upshelf.functions.weeks import week_start
from upshelf.sources.schema import MONEY

# Fixed values of the booking fixture: first campaign anchor (a Wednesday),
# campaign length, and the three assets (media type, media, location, start offset).
BOOKING_ANCHOR = dt.date(1998, 1, 7)
CAMPAIGN_DAYS = 28
ASSETS = [
    (0, "Floor", "Entry floor", "Front", 0),
    (1, "Aisle Fin A", "Fin side A", "Aisle", 0),
    (2, "Digital Screen Network", "Screens", "Store", 14),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _money(x):
    return x.cast(MONEY)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per basket line (lineitem ⋈ orders ⋈ part)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        "l_discount", "l_returnflag", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    cust = (F.when(F.col("o_custkey") % 17 == 0, F.lit(None).cast("string"))
            .when(F.col("o_custkey") % 19 == 0, F.lit("GUEST"))
            .otherwise(F.concat(F.lit(" 10"), F.col("o_custkey").cast("string"))))
    amount = (F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1),
                     -F.col("l_extendedprice"))
              .otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount"))))
    return j.select(
        F.to_date("l_shipdate").alias("txn_date"),
        F.col("l_suppkey").cast("string").alias("store_id"),
        F.concat(F.lit("PF"), (F.col("p_size") % 10).cast("string")).alias("price_family"),
        F.col("l_partkey").alias("product_number"),
        F.concat(F.lit("A"), F.col("l_partkey").cast("string")).alias("article_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.concat(F.col("p_type"), F.lit("/"), (F.col("p_size") % 4).cast("string")).alias("subcategory"),
        cust.alias("customer_raw"),
        _money(amount).alias("sales_amount"),
        F.when(F.col("o_orderstatus") == "P", "S2").otherwise("S1").alias("sales_org"),
        F.when(F.col("o_orderpriority") == "5-LOW", "Online").otherwise("In Store").alias("channel"),
    )


def competitor_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product × date × competitor shelf and offer prices (lineitem ⋈ part)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax", "l_shipdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = li.join(p, li.l_partkey == p.p_partkey)
    rp = F.col("p_retailprice")
    q1 = F.when(F.col("l_linenumber") % 3 == 0, F.lit(None)).otherwise(F.col("l_linenumber") % 3)
    no_tax = F.col("l_tax") == 0
    return j.select(
        F.col("l_partkey").alias("product_number"),
        F.to_date("l_shipdate").alias("fw_end_date"),
        F.concat(F.lit("C"), (F.col("l_suppkey") % 3).cast("string")).alias("competitor"),
        _money(rp * (F.lit(0.80) + F.lit(0.01) * (F.col("l_suppkey") % 40))).alias("shelf_price"),
        _money(rp * q1 * (1 - F.col("l_discount"))).alias("offer1_price"),
        q1.cast("int").alias("offer1_qty"),
        F.when(no_tax, F.lit(None)).otherwise(_money(2 * rp * (1 - F.col("l_tax")))).cast(MONEY)
         .alias("offer2_price"),
        F.when(no_tax, F.lit(None)).otherwise(F.lit(2)).cast("int").alias("offer2_qty"),
        _money(rp + F.when(F.col("l_linenumber") == 7, 10).otherwise(0)).alias("own_price"),
    )


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week × price family promotion calendar (lineitem ⋈ part, grouped)."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_discount", "l_shipdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    g = (li.join(p, li.l_partkey == p.p_partkey)
         .groupBy(week_start(F.to_date("l_shipdate")).alias("week_start"),
                  F.concat(F.lit("PF"), (F.col("p_size") % 10).cast("string")).alias("price_family"))
         .agg(F.max("l_discount").alias("discountpercent"), F.count(F.lit(1)).alias("n")))
    n = F.col("n")
    return g.select(
        "week_start", "price_family", "discountpercent",
        F.when(n % 4 == 0, "Front page").when(n % 4 == 1, "Not on brochure").alias("brochure"),
        F.when(n % 3 == 0, "2 for 1").alias("multibuy"),
        F.lit("National").alias("district"),
        F.when(n % 11 == 0, "FUTURE").otherwise("PAST").alias("future_flag"),
    )


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: raw media bookings, one row per booking × asset line.

    One booking per brand number k; SKU list = the brand's articles, store list
    = suppliers whose key differs from k modulo 3 (blank when k % 5 = 0). The
    store rule is an equi-join on the allowed residues, not a theta join.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brands = part.select(
        F.col("p_brand").alias("brand"),
        F.regexp_extract("p_brand", r"#(\d+)", 1).cast("long").alias("k")).distinct()
    skus = (part.groupBy(F.col("p_brand").alias("brand"))
            .agg(F.array_sort(F.collect_list("p_partkey")).alias("keys"))
            .select("brand", F.array_join(F.transform("keys", lambda x: F.concat(F.lit("A"), x.cast("string"))), ",")
                    .alias("quoteline_sku")))
    residues = brands.select("brand", "k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("r")) \
        .where(F.col("r") != F.col("k") % 3)
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3).alias("r"))
    stores = (residues.join(sup, "r").groupBy("brand")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string")), ",")
                   .alias("store_text")))
    assets = F.array(*[F.struct(F.lit(a).alias("asset"), F.lit(t).alias("media_type"), F.lit(m).alias("media"),
                                F.lit(loc).alias("media_location"), F.lit(off).alias("offset"))
                       for a, t, m, loc, off in ASSETS])
    start = F.date_add(F.lit(BOOKING_ANCHOR), (F.col("k") * CAMPAIGN_DAYS).cast("int"))
    end = F.date_add(F.lit(BOOKING_ANCHOR), (F.col("k") * CAMPAIGN_DAYS + CAMPAIGN_DAYS - 1).cast("int"))
    b = brands.select("brand", "k", F.inline(assets))
    return (b.join(skus, "brand").join(stores, "brand", "left").select(
        F.concat(F.lit("WOW"), (F.col("k") + 1000).cast("string")).alias("booking_number"),
        F.when(F.col("k") % 7 == 0, "Draft").otherwise("Booked").alias("quote_status"),
        start.alias("campaign_start_date"),
        end.alias("campaign_end_date"),
        F.date_add(start, F.col("offset")).alias("media_start_date"),
        end.alias("media_end_date"),
        "media", "media_location", "media_type",
        F.concat(F.lit("Opp "), F.col("k").cast("string")).alias("opportunity_name"),
        "quoteline_sku",
        F.when(F.col("k") % 5 == 0, F.lit("")).otherwise(F.col("store_text")).alias("store_list"),
    ))
