"""Properties of the pipeline on the driver tables (sf0.001)."""

import os

import pytest
from pyspark.sql import functions as F

from upshelf.operators import base as B
from upshelf.operators import customers as C
from upshelf.plans import inputs as I
from upshelf.plans.pipeline import campaigns

SF = os.environ.get("UPSHELF_TEST_SF", "/root/testdata/sf0.001")


def test_weeks_are_wednesdays_and_sales_conserved(spark):
    base = I.weekly_base(spark, SF)
    assert base.where(F.dayofweek("week_start") != 4).count() == 0
    lines = B.eligible_sales(I.tx(spark, SF))
    assert base.agg(F.sum("sales")).first()[0] == lines.agg(F.sum("sales_amount")).first()[0]


def test_new_to_never_exceeds_shoppers(spark):
    lines = C.global_window(C.customer_lines(I.tx(spark, SF)))
    s = C.shoppers(lines, C.SKU_GRAIN)
    n = C.new_to(lines, "brand", C.SKU_GRAIN)
    bad = s.join(n, C.SKU_GRAIN).where(F.col("new_to_brand_shoppers_13m") > F.col("shoppers")).count()
    assert bad == 0


def test_capping_keeps_sign_and_bounds(spark):
    from upshelf.operators import reconcile as R
    c = campaigns(spark, SF)
    t = R.uplift_totals(c.compare())
    cap = R.cap_hierarchy(t)
    rows = t.join(cap.select("booking_number", *[F.col(x).alias("c_" + x) for x in t.columns[1:]]),
                  "booking_number").collect()
    for r in rows:
        assert abs(r.c_brand_category_total) <= abs(r.brand_category_total)
        assert r.c_brand_category_total * r.brand_category_total >= 0
        assert abs(r.c_promo_sku_total) <= max(abs(r.c_brand_category_total), abs(r.c_brand_subcategory_total))


def test_sov_sums_to_one_and_shares_to_one(spark):
    c = campaigns(spark, SF)
    s = c.sov().groupBy("booking_number", "week_start", "category").agg(F.sum("sov").alias("t"))
    assert s.where(F.abs(F.col("t") - 1) > 1e-9).count() == 0
    sh = c.share().groupBy("booking_number", "category").agg(F.sum("market_share").alias("t"))
    assert sh.where((F.abs(F.col("t") - 1) > 1e-9) & (F.col("t") != 0)).count() == 0


def test_result_independent_of_partitioning(spark):
    lines = C.global_window(C.customer_lines(I.tx(spark, SF)))
    a = C.new_to(lines, "sku", C.SKU_GRAIN).collect()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        b = C.new_to(lines.repartition(1), "sku", C.SKU_GRAIN).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
