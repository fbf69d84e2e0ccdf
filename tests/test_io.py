"""Sources and sinks round-trips (S7-S17), conform (P12), id coercion (P15), one-hot."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from upshelf.functions import lists as L
from upshelf.operators import exposure as EX
from upshelf.operators import nodes as N
from upshelf.sources import readers, schema, sinks


def test_weekly_base_sink_and_csv_reader(spark):
    d = tempfile.mkdtemp(prefix="upshelf-io-")
    base = spark.createDataFrame([(dt.date(2024, 1, 3), "1", 7, Decimal("2.5")), (dt.date(2024, 1, 10), "2", 8, Decimal("1"))],
                                 "week_start date, store_id string, product_number long, sales decimal(18,4)")
    sinks.write_weekly_base(base, f"{d}/base.parquet")
    back = readers.read_any(spark, f"{d}/base.parquet")
    assert back.count() == 2 and "week_start" in back.columns
    sinks.write_report_csv(base.select("store_id", F.col("week_start").cast("string").alias("week_start")), f"{d}/rep")
    csv = readers.read_any(spark, f"{d}/rep", date_cols=("week_start",))
    assert dict(csv.dtypes)["week_start"] == "date" and csv.count() == 2
    sinks.write_lines(spark.createDataFrame([("  + a (1.000)",)], "line string"), f"{d}/lines")
    assert spark.read.text(f"{d}/lines").first()[0] == "  + a (1.000)"


def test_id_list_and_weights(spark):
    ids = readers.id_list(spark, [" 1", "", None, "1", "2"])
    assert sorted(r[0] for r in ids.collect()) == ["1", "2"]
    w = readers.type_weights(spark, {"Floor Media": 2.0, "_default_": 0.5})
    assert sorted(r.media_type for r in w.collect()) == ["_default_", "floor media"]


def test_type_weight_default_and_unknown_brand_asset(spark):
    media = spark.createDataFrame([
        ("B1", "s1", dt.date(2024, 1, 3), dt.date(2024, 1, 9), ["floor media", "pelmet"], ["A1"], []),
        ("B1", "s2", dt.date(2024, 1, 3), dt.date(2024, 1, 9), ["floor media"], ["ZZ"], ["1"])],
        "booking_number string, study_id string, media_start_date date, media_end_date date,"
        " media_type_array array<string>, sorted_sku_list array<string>, sorted_store_list array<string>")
    dim = spark.createDataFrame([("A1", "BR", "CAT")], "article_id string, brand string, category string")
    w = readers.type_weights(spark, {"floor media": 2.0, "_default_": 0.5})
    cal = EX.exposure_calendar(media, dim, 4, w).collect()
    assert len(cal) == 1                                # asset with unknown SKU dropped
    r = cal[0]
    assert r.exp_weight_brand_cat == 2.5 and r.n_types == 2.0 and r.coverage_frac == 1.0
    no_w = EX.exposure_calendar(media, dim, 4, spark.createDataFrame([], "media_type string, weight double")).first()
    assert no_w.exp_weight_brand_cat == 2.0              # empty table -> 1.0 everywhere


def test_conform_coerce_and_one_hot(spark):
    raw = spark.createDataFrame([("2024-01-03", "12", "0E-9", "x")],
                                "BusinessDate string, SiteNumber string, TotalAmountIncludingGST string, extra string")
    c = schema.conform(raw, schema.TRANSACTIONS)
    assert c.columns == [f.name for f in schema.TRANSACTIONS.fields]
    r = c.first()
    assert r.txn_date == dt.date(2024, 1, 3) and r.store_id == "12" and r.sales_amount == 0 and r.brand is None
    df = spark.createDataFrame([(" 007 ",), ("A7",)], "x string")
    assert [r[0] for r in df.select(L.coerce_id("x")).collect()] == ["7", "A7"]
    oh = N.one_hot(spark.createDataFrame([("Not on brochure",), ("Front page",)], "brochure string"), "brochure",
                   ["Not on brochure"]).collect()
    assert [r.brochure_not_on_brochure for r in oh] == [1.0, 0.0]


def test_read_many_keeps_partition_types(spark, tmp_path):
    """Ids with leading zeros come back as text when the schema is given."""
    df = spark.createDataFrame([("007", "sales", "sku", 1.0), ("7", "sales", "sku", 2.0)], "booking_number string, metric string, level string, y double")
    sinks.write_compare(df, str(tmp_path / "c"))
    back = readers.read_many(spark, str(tmp_path / "c"), df.schema).drop("source_file")
    assert sorted(r.booking_number for r in back.collect()) == ["007", "7"]


def test_successive_exports_do_not_touch_each_other(spark):
    import __spark_entry__ as E
    q = E.queries()["weekly_uplift_export"]
    first = q(spark, "/root/testdata/sf0.001")
    n = first.count()
    assert q(spark, "/root/testdata/sf0.001").count() == n == first.count()


def test_scenario_without_known_feature_scores_the_intercept(spark):
    from upshelf.operators import models
    coefs = spark.createDataFrame([("(intercept)", 3.0), ("a", 2.0)], "feature string, coef double")
    sc = spark.createDataFrame([("s1", "a", 1.5), ("s2", "unknown", 9.0)], "scenario_id string, feature string, value double")
    assert {r.scenario_id: r.predicted_total_uplift for r in models.score_campaign(sc, coefs).collect()} == {"s1": 6.0, "s2": 3.0}
