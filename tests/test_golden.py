"""Golden micro-frames for the semantic traps (hand-computed expectations)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from upshelf.functions import keys as K
from upshelf.functions import lists as L
from upshelf.functions import numeric as N
from upshelf.functions import weeks as Wk
from upshelf.operators import base as B
from upshelf.operators import customers as C
from upshelf.operators import market as MK
from upshelf.operators import media as M
from upshelf.operators import models as ML
from upshelf.operators import reconcile as R
from upshelf.plans.params import DEFAULT

D = dt.date


def test_week_edges(spark):
    # 2024-02-06 Tue, 02-07 Wed, 02-08 Thu
    df = spark.createDataFrame([(D(2024, 2, 6),), (D(2024, 2, 7),), (D(2024, 2, 8),)], "d date")
    got = [r[0] for r in df.select(Wk.week_start("d")).collect()]
    assert got == [D(2024, 1, 31), D(2024, 2, 7), D(2024, 2, 7)]
    thu = [r[0] for r in df.select(Wk.week_start("d", "THU")).collect()]
    assert thu == [D(2024, 2, 1), D(2024, 2, 1), D(2024, 2, 8)]


def test_month_and_sunday_week_diff(spark):
    df = spark.createDataFrame([(D(2024, 2, 1), D(2023, 1, 31)), (D(2024, 2, 7), D(2024, 2, 4)),
                                (D(2024, 2, 10), D(2024, 2, 4))], "a date, b date")
    got = df.select(Wk.month_diff("a", "b"), Wk.week_diff_sunday("a", "b")).collect()
    assert [tuple(r) for r in got] == [(13, 52), (0, 0), (0, 0)]
    df2 = spark.createDataFrame([(D(2024, 2, 11), D(2024, 2, 7))], "a date, b date")
    assert df2.select(Wk.week_diff_sunday("a", "b")).first()[0] == 1   # Wed -> next Sun crosses one


def _tx(spark, rows):
    return spark.createDataFrame(
        [(d, s, "PF1", p, f"A{p}", b, "CAT", "CAT/0", c, Decimal(str(a)), "S1", "In Store")
         for d, s, p, b, c, a in rows],
        "txn_date date, store_id string, price_family string, product_number long, article_id string, brand string,"
        " category string, subcategory string, customer_raw string, sales_amount decimal(18,4), sales_org string,"
        " channel string")


def test_new_to_lag_13_month_boundary_and_same_day(spark):
    rows = [
        (D(2023, 1, 15), "1", 1, "B", "123", 5.0),   # first ever -> new
        (D(2024, 2, 1), "1", 1, "B", "123", 7.0),    # 13 month boundaries after Jan 2023 -> new
        (D(2024, 2, 1), "1", 1, "B", "123", 3.0),    # same day, second line -> new too (whole day)
        (D(2024, 12, 20), "1", 1, "B", "123", 2.0),  # 10 months later -> not new
        (D(2024, 2, 1), "1", 1, "B", "ab1", 9.0),    # invalid id -> never counted
    ]
    lines = C.global_window(C.customer_lines(_tx(spark, rows)))
    out = {(r.week_start, r.store_id): (r.new_to_sku_shoppers_13m, float(r.new_to_sku_sales_13m))
           for r in C.new_to(lines, "sku", ["week_start", "store_id"], prefix="new_to_sku").collect()}
    assert out[(D(2023, 1, 11), "1")] == (1, 5.0)
    assert out[(D(2024, 1, 31), "1")] == (1, 10.0)
    assert out[(D(2024, 12, 18), "1")] == (0, 0.0)


def test_lookback_start_cuts_previous_purchase(spark):
    rows = [(D(2023, 1, 1), "1", 1, "B", "123", 1.0), (D(2024, 1, 10), "1", 1, "B", "123", 1.0)]
    lines = C.customer_lines(_tx(spark, rows))
    # window starting 2024-01-03: lookback start = 400 days earlier = 2022-11-29 -> previous purchase kept
    # (12 month boundaries -> not new); starting 2024-02-07 the previous purchase of 2023-01-01 falls
    # outside 400 days but the purchase itself is outside the window anyway.
    w = lines.select("*", F.lit(D(2024, 1, 3)).alias("min_d"), F.lit(D(2024, 3, 1)).alias("max_d"),
                     F.date_sub(F.lit(D(2024, 1, 3)), 400).alias("lookback_start"))
    lag = C.new_to(w, "sku", ["week_start"], prefix="n").collect()
    assert [(r.n_shoppers_13m) for r in lag] == [0]
    first = C.new_to(w, "sku", ["week_start"], mode="first", prefix="n").collect()
    assert [(r.n_shoppers_13m) for r in first] == [0]
    w2 = lines.select("*", F.lit(D(2024, 1, 3)).alias("min_d"), F.lit(D(2024, 3, 1)).alias("max_d"),
                      F.lit(D(2023, 6, 1)).alias("lookback_start"))
    assert [r.n_shoppers_13m for r in C.new_to(w2, "sku", ["week_start"], mode="first", prefix="n").collect()] == [1]


def test_valid_customer_rules(spark):
    df = spark.createDataFrame([(" 123 ",), ("12",), ("-123",), ("abc",), (None,), ("0012",)], "c string")
    got = df.select(C.valid_customer_regex("c").alias("r"), C.valid_customer_cast("c").alias("k")).collect()
    assert [r.r for r in got] == ["123", None, None, None, None, "0012"]
    assert [r.k for r in got] == ["123", None, "-123", None, None, "0012"]


def test_duplicate_promotion_key_does_not_fan_out(spark):
    promo = spark.createDataFrame([
        (D(2024, 1, 31), "PF1", 0.1, "Front page", None, "National", "PAST"),
        (D(2024, 1, 31), "PF1", 0.3, "Not on brochure", "2 for 1", "National", "PAST"),
        (D(2024, 1, 31), "PF1", 0.9, None, None, "National", "FUTURE")],
        "week_start date, price_family string, discountpercent double, brochure string, multibuy string,"
        " district string, future_flag string")
    u = B.promotions_unique(promo).collect()
    assert len(u) == 1 and u[0].discountpercent == 0.3 and u[0].brochure == "Front page"


def test_offer_tie_takes_lowest_quantity_and_own_price_fanout(spark):
    comp = spark.createDataFrame([
        (1, D(2001, 6, 6), "C0", Decimal("10"), Decimal("16"), 2, Decimal("24"), 3, Decimal("9")),
        (1, D(2001, 6, 6), "C0", Decimal("10"), Decimal("16"), 2, Decimal("24"), 3, Decimal("12")),
    ], "product_number long, fw_end_date date, competitor string, shelf_price decimal(18,4), offer1_price "
       "decimal(18,4), offer1_qty int, offer2_price decimal(18,4), offer2_qty int, own_price decimal(18,4)")
    best = B.competitor_best_offers(comp).first()
    assert best.best_unit_price == 8.0 and best.hurdle_qty == 2          # 16/2 = 24/3 = 8 -> qty 2
    cm = B.competitor_metrics(comp).first()
    assert cm.n_competitors == 2 and cm.n_any_cheaper == 2 and cm.n_promo_cheaper_hurdle == 2
    assert cm.worst_gap == -4.0 and cm.avg_cheaper_gap == -2.5


def test_cap_with_negative_zero_and_null_parents(spark):
    t = spark.createDataFrame([
        ("a", 50.0, 30.0, 20.0, -40.0, 100.0, 10.0),
        ("b", 5.0, 0.0, 1.0, 3.0, 4.0, 2.0),
    ], "booking_number string, promo_sku_total double, brand_category_total double, brand_subcategory_total double,"
       " brand_total double, category_total double, subcategory_total double")
    got = {r.booking_number: r for r in R.cap_hierarchy(t).collect()}
    a = got["a"]
    assert a.brand_category_total == 30.0          # |30| <= |-40|
    assert a.brand_subcategory_total == 10.0       # parent = subcategory (10)
    assert a.promo_sku_total == 10.0               # capped by smaller capped child
    b = got["b"]
    assert b.brand_category_total == 0.0 and b.promo_sku_total == 0.0
    df = spark.createDataFrame([(5.0, None), (-5.0, 2.0)], "c double, p double")
    assert [r[0] for r in df.select(N.cap_child("c", "p")).collect()] == [5.0, -2.0]


def test_list_parse_shapes(spark):
    rows = [("",), (None,), ("['a', 'b']",), ('["x","y"]',), ("[1, 2]",), ("1,2, 3",), ("4 5  6",), (" 'q' ",)]
    df = spark.createDataFrame(rows, "x string")
    got = [r[0] for r in df.select(L.parse_list("x")).collect()]
    assert got == [[], [], ["a", "b"], ["x", "y"], ["1", "2"], ["1", "2", "3"], ["4", "5", "6"], ["q"]]
    df2 = spark.createDataFrame([([" a", "nan", "", "b", "a", None],)], "a array<string>")
    assert df2.select(L.clean_ids("a")).first()[0] == ["a", "b"]


def test_node_key_roundtrip(spark):
    df = spark.createDataFrame([("brand=X|cat=Y=Z",), ("sku=A1",), ("brand=B|subcat=S",), ("cat=C",)], "g string")
    got = [tuple(r[0]) for r in df.select(K.parse_node_key("g")).collect()]
    assert got[0] == ("brand_category", None, "X", "Y=Z", None)
    assert got[1] == ("sku", "A1", None, None, None)
    assert got[2] == ("brand_subcategory", None, "B", None, "S")
    assert got[3] == ("category", None, None, "C", None)


def test_leader_tie_gives_two_leaders(spark):
    base = spark.createDataFrame([
        (D(2024, 1, 3), "B1", "C", Decimal("10")), (D(2024, 1, 3), "B2", "C", Decimal("10")),
        (D(2024, 1, 3), "B3", "C", Decimal("5"))], "week_start date, brand string, category string, sales decimal(18,4)")
    win = spark.createDataFrame([("k", D(2024, 2, 1), True)], "booking_number string, train_end_raw date, all_stores boolean")
    got = {r.brand: r.is_leader for r in MK.preperiod_share(base, win).collect()}
    assert got == {"B1": 1, "B2": 1, "B3": 0}


def test_discount_percent_vs_fraction(spark):
    rows = [(D(2024, 1, 3), "A1", Decimal("10"), 20.0), (D(2024, 1, 3), "A1", Decimal("30"), 40.0)]
    base = spark.createDataFrame(rows, "week_start date, article_id string, sales decimal(18,4), discountpercent double")
    named = lambda df: df.selectExpr("*", "'b' as brand", "'c' as category", "'s' as subcategory")
    v = MK.discount_depth(MK.depth_sums(named(base)), "sku").first().disc_depth
    assert abs(v - 0.35) < 1e-9
    frac = spark.createDataFrame([(D(2024, 1, 3), "A1", Decimal("10"), 0.2)],
                                 "week_start date, article_id string, sales decimal(18,4), discountpercent double")
    assert abs(MK.discount_depth(MK.depth_sums(named(frac)), "sku").first().disc_depth - 0.2) < 1e-9


def test_booking_with_two_end_dates_and_one_week_campaign(spark):
    bk = spark.createDataFrame([
        ("WOW1", "Booked", D(2000, 1, 5), D(2000, 1, 11), D(2000, 1, 5), D(2000, 1, 11), "m", "Front", "Floor",
         "o", "A2,A1", "3,1"),
        ("WOW1", "Booked", D(2000, 1, 5), D(2000, 1, 11), D(2000, 1, 5), D(2000, 1, 8), "m", "Front", "Floor",
         "o", "A3", "2")],
        "booking_number string, quote_status string, campaign_start_date date, campaign_end_date date,"
        " media_start_date date, media_end_date date, media string, media_location string, media_type string,"
        " opportunity_name string, quoteline_sku string, store_list string")
    mm = M.media_master(bk).collect()
    # The 4-key join ignores the end date, so both end dates are combined with
    # both SKU lists and both store lists: 2 x 2 x 2 rows (kept as modelled).
    combos = {(r.media_end_date, r.sorted_sku_list, r.sorted_store_list) for r in mm}
    assert len(mm) == 8 and combos == {(e, k, s) for e in (D(2000, 1, 8), D(2000, 1, 11))
                                       for k in ("A1,A2", "A3") for s in ("1,3", "2")}
    assert sorted(r.campaign_week_split for r in mm) == list(range(1, 9))
    assert {r.campaign_week for r in mm} == {1}
    w = M.campaign_windows(M.media_master(bk)).first()
    assert w.first_week == w.last_week == D(2000, 1, 5)


def test_campaign_ols_with_fewer_campaigns_than_features(spark):
    agg = spark.createDataFrame([("c1", 1.0, 2.0, 10.0), ("c2", 2.0, 1.0, 20.0)],
                                "campaign_id string, x1 double, x2 double, uplift_total double")
    co = {r.feature: r.coef for r in ML.fit_campaign_level(agg, ["x1", "x2"]).collect()}
    # minimum-norm solution: w = (5, -5), intercept = 15 - 1.5*5 + 1.5*5 = 15
    assert abs(co["x1"] - 5) < 1e-9 and abs(co["x2"] + 5) < 1e-9 and abs(co["(intercept)"] - 15) < 1e-9


def test_weighted_mean_and_clip(spark):
    df = spark.createDataFrame([(None, Decimal("2")), (3.0, Decimal("2")), (1.5, None)], "x double, s decimal(18,4)")
    assert df.select(N.weighted_mean("x", "s")).first()[0] == 1.5
    df2 = spark.createDataFrame([(None,), (2.0,), (0.5,)], "x double")
    assert [r[0] for r in df2.select(N.clip_upper("x")).collect()] == [None, 1.0, 0.5]
