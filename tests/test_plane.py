"""The customer plane: attached previous days equal planes joined after the fan-out, and its join moves no lines."""

from pyspark.sql import functions as F

from upshelf.operators import customers as CU
from upshelf.plans.pipeline import campaigns

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(str, df.collect()))


def test_new_to_of_the_plane_equals_joined_history(spark):
    c = campaigns(spark, SF)
    plain = CU.scoped_lines(c.lines(), c.candidates(), c.windows, c.stores)
    plane = c.scoped_lines()
    grain = CU.SKU_GRAIN
    assert plane.count() > 0 and _rows(CU.shoppers(plain, grain)) == _rows(CU.shoppers(plane, grain))
    for key in CU.KEYS:
        for mode in ("lag", "first"):
            assert _rows(CU.new_to(plain, key, grain, mode, history=c.lines())) == _rows(CU.new_to(plane, key, grain, mode)), (key, mode)
    cast = CU.scoped_lines(c.plane("cast"), c.skus, c.windows, c.stores)
    plain = CU.scoped_lines(c.lines("cast"), c.skus, c.windows, c.stores)
    for key in ("sku", "brand_subcat"):
        assert _rows(CU.new_to_week(plain, key, ["week_start"], history=c.lines("cast"))) == _rows(CU.new_to_week(cast, key, ["week_start"]))


def test_plane_of_null_keys_repeats_and_no_rows(spark):
    cols = "customer_id string, d string, store_id string, price_family string, product_number long, article_id string, brand string, category string, subcategory string, sales_amount decimal(18,4)"
    rows = [("c1", "2001-01-03", "s1", "f", 1, "A1", None, "k", "u", 2), ("c1", "2001-01-03", "s1", "f", 1, "A1", None, "k", "u", 3),
            ("c1", "2001-02-07", "s2", "f", 1, "A1", None, "k", "u", 4), (None, "2001-02-07", "s2", "f", 1, "A1", "b", "k", "u", 5),
            ("c1", "2001-02-09", "s2", "f", 2, "A2", "b", "k", "v", 6)]
    df = spark.createDataFrame(rows, cols.replace("decimal(18,4)", "long")).withColumn("d", F.to_date("d")).withColumn("week_start", F.date_sub("d", 0))
    got = {(str(r.d), r.article_id): (r.sales_amount, str(r.prev_sku), str(r.prev_brand), str(r.prev_category)) for r in CU.customer_plane(df).collect()}
    assert got == {("2001-01-03", "A1"): (5, "None", "None", "None"), ("2001-02-07", "A1"): (4, "2001-01-03", "None", "2001-01-03"),
                   ("2001-02-09", "A2"): (6, "None", "None", "2001-02-07")}
    assert CU.customer_plane(df.limit(0)).count() == 0


def test_plane_joins_without_an_exchange_of_lines(spark):
    c = campaigns(spark, SF)
    c.plane(), c.candidates()
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = CU.scoped_lines(c.plane(), c.candidates(), c.windows, None)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert "SelectedBucketsCount" in plan
    assert plan.count("Exchange hashpartitioning(article_id") == 1          # the articles of the bookings only
