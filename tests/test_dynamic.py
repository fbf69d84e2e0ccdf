"""Dynamic cohorts: equal to the static result when every week has the same
store set (the driver fixture), and per-week store sets on a micro-frame."""

import datetime as dt
import os
from decimal import Decimal

from pyspark.sql import functions as F

from upshelf.operators import dynamic as DY
from upshelf.operators import media as M
from upshelf.plans.pipeline import campaigns

SF = os.environ.get("UPSHELF_TEST_SF", "/root/testdata/sf0.001")
D = dt.date


def test_dynamic_equals_static_when_store_sets_coincide(spark):
    c = campaigns(spark, SF)
    a = sorted(tuple(r) for r in c.compare().collect())
    b = sorted(tuple(r) for r in c.compare_dynamic().collect())
    assert a == b and len(a) > 0


def test_week_cohorts_follow_each_assets_weeks(spark):
    media = spark.createDataFrame([
        ("B", "s1", D(2024, 1, 3), D(2024, 1, 16), ["1", "2"], ["A1"], ["floor media"]),
        ("B", "s2", D(2024, 1, 10), D(2024, 1, 16), ["3"], ["A1"], ["pelmet"])],
        "booking_number string, study_id string, media_start_date date, media_end_date date,"
        " sorted_store_list array<string>, sorted_sku_list array<string>, media_type_array array<string>")
    w = M.campaign_windows(media)
    sig, members = DY.week_cohorts(media, w)
    by_week = {r.week_start: r.cohort for r in sig.collect()}
    assert len(by_week) == 2 and by_week[D(2024, 1, 3)] != by_week[D(2024, 1, 10)]
    mem = {}
    for r in members.collect():
        mem.setdefault(r.cohort, set()).add(r.store_id)
    assert mem[by_week[D(2024, 1, 3)]] == {"1", "2"} and mem[by_week[D(2024, 1, 10)]] == {"1", "2", "3"}
