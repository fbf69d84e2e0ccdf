"""Steps that must not grow faster than their input: written tables, dealt-out rows, one pass over price rows."""

import datetime as dt
import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from upshelf.operators import base as B
from upshelf.operators import cohort as CO
from upshelf.operators import customers as C
from upshelf.operators import scope as S
from upshelf.plans import inputs as I
from upshelf.plans.pipeline import campaigns
from upshelf.sources import sinks

SF = "/root/testdata/sf0.001"
W = dt.date(2001, 1, 3)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_booking_tables_and_rows_of_all_metrics_are_scans(spark):
    c = campaigns(spark, SF)
    for df in (c.skus, c.stores, c.windows, c.promo, c.compare_full(), c.hypothesis_full("brand")):
        assert "Exchange" not in _plan(df) and df.count() > 0


def test_slice_rows_are_dealt_to_all_partitions(spark):
    base = spark.createDataFrame([(W, "A1", "s1"), (W, "A2", "s2")], "week_start date, article_id string, store_id string")
    uni = spark.createDataFrame([("B1", "A1"), ("B2", "A1"), ("B2", "A2")], "booking_number string, article_id string")
    win = spark.createDataFrame([("B1", W, W, True), ("B2", W, W, False)], "booking_number string, min_d date, max_d date, all_stores boolean")
    st = spark.createDataFrame([("B2", "s2")], "booking_number string, store_id string")
    rows = S.slice_rows(base, uni, win, st)
    assert sorted((r.booking_number, r.article_id) for r in rows.collect()) == [("B1", "A1"), ("B2", "A2")]
    assert "REPARTITION_BY_NUM" in _plan(rows)


def test_weekly_internal_discount_of_groups_null_keys_and_repeats(spark):
    rows = spark.createDataFrame([
        ("B", W, "s1", "b", "c", "F1", Decimal(1)), ("B", W, "s1", "b", "c", "F2", Decimal(3)), ("B", W, "s2", "b", "c", "F1", Decimal(4)),
        ("B", W, "s2", "b", None, "F2", Decimal(2)), ("B", W, "s3", "b", "c", None, Decimal(10))],
        "booking_number string, week_start date, store_id string, brand string, category string, price_family string, sales decimal(18,4)")
    promo = spark.createDataFrame([(W, "F1", 0.1, "National", "PAST"), (W, "F2", 0.2, "National", "PAST"), (W, "F2", 0.3, "National", "PAST"),
                                   (W, "F1", 0.9, "National", "FUTURE")],
                                  "week_start date, price_family string, discountpercent double, district string, future_flag string")
    # groups: s1 0.3 with sales 1 + 3, s2 0.1 with 4, the null category and the null family 0
    by_sales, by_rows = (CO.weekly_internal_discount(rows, promo, w).collect()[0][2] for w in ("sales", "mean"))
    assert abs(by_sales - (0.3 * 4 + 0.1 * 4) / 20) < 1e-12 and abs(by_rows - (0.3 * 2 + 0.1) / 5) < 1e-12


def test_offers_meet_own_prices_in_one_pass(spark):
    d = dt.date(2001, 1, 5)
    comp = spark.createDataFrame([
        (1, d, "C1", 3.0, 2.0, 1, None, None, 5.0), (1, d, "C1", 4.0, None, None, 6.0, 2, 7.0), (1, d, "C2", None, None, None, None, None, None),
        (1, d, None, 9.0, None, None, None, None, 5.0), (2, d, "C1", None, None, None, None, None, 5.0), (None, d, "C1", 1.0, None, None, None, None, 5.0)],
        "product_number long, fw_end_date date, competitor string, shelf_price double, offer1_price double, offer1_qty int,"
        " offer2_price double, offer2_qty int, own_price double")
    cols = ["product_number", "week_start", "competitor", "best_unit_price", "hurdle_qty", "shelf_unit", "own_price"]
    joined = B.competitor_best_offers(comp).join(B.own_prices(comp), ["product_number", "week_start"])
    got = sorted(map(str, B.offers_with_own_prices(comp).select(*cols).collect()))
    assert got == sorted(map(str, joined.select(*cols).collect())) and len(got) == 6
    assert _plan(B.competitor_metrics(I.comp(spark, SF))).count("lineitem.parquet") == 1


def test_scoped_slices_are_joined_from_written_parts(spark):
    c = campaigns(spark, SF)
    for variant in ("lag", "first", "lag_brand_subcat"):
        plan = _plan(c.scoped_slice(variant))
        assert "Aggregate" not in plan and "BroadcastHashJoin" not in plan, variant


def test_plans_of_written_tables_are_released(spark):
    kept = []

    def table():
        df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
        kept.append(spark._jvm.java.lang.ref.WeakReference(df._jdf.queryExecution()))
        return df

    for bucket_by in (None, ["k"]):
        assert sinks.materialise(spark, table, "released", (uuid.uuid4().hex,), bucket_by=bucket_by).count() == 7
    assert [ref.get() for ref in kept] == [None, None]


def test_customer_plane_deals_out_one_key_at_a_time(spark, tmp_path):
    d = dt.date(2001, 1, 5)
    lines = spark.createDataFrame([
        (c, d + dt.timedelta(days=7 * i % 40), W + dt.timedelta(days=7 * (7 * i % 40 // 7)), s, "F", p, f"A{p}", b, "c", "c/0", Decimal(i))
        for i in range(12) for c in ("100", "101", None) for s, p, b in (("s1", 1, "b"), ("s2", 2, None))],
        "customer_id string, d date, week_start date, store_id string, price_family string, product_number long, article_id string,"
        " brand string, category string, subcategory string, sales_amount decimal(18,4)")
    plans = []

    def once(name, table):
        plans.append(_plan(table))
        table.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    keys = {"days": ("sku", "brand"), "weeks": ("brand_subcat",)}
    whole = C.customer_plane(lines, **keys)
    plans.append(_plan(got := C.customer_plane(lines, **keys, once=once)))
    assert sorted(map(str, got.select(whole.columns).collect())) == sorted(map(str, whole.collect())) and got.count() > 0
    # the rows and, for every key, its days or weeks and the rows with them: two exchanges at most each
    assert len(plans) == 8 and max(p.count("Exchange ") for p in plans) <= 2 < _plan(whole).count("Exchange ")
