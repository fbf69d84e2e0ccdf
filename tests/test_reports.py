"""Typed node keys, dose maps and reports in a fixed order."""

import datetime as dt

from pyspark.sql import functions as F

from upshelf.operators import exposure as EX
from upshelf.operators import forecast as FC
from upshelf.operators import insights as IN
from upshelf.operators import nodes as N
from upshelf.plans import q_insights
from upshelf.sources import readers, sinks

D = dt.date


def test_names_with_pipes_keep_their_keys(spark):
    dim = [("b", "A1", 1, "X|cat=Y", "Z", "s|1"), ("b", "A2", 2, "X", "Y|cat=Z", "t=2")]
    promo = spark.createDataFrame(dim, "booking_number string, article_id string, product_number long, brand string, category string, subcategory string")
    registry = N.node_registry(promo.select("booking_number", "article_id"), promo)
    rows = promo.select("booking_number", F.explode(F.array(*[F.lit(D(2001, 1, d)) for d in (3, 10, 17)])).alias("week_start"), "article_id", "brand", "category",
                        "subcategory", F.col("product_number").cast("decimal(18,4)").alias("sales"))
    panel = N.weekly_panel(rows, registry)
    win = spark.createDataFrame([("b", D(2000, 1, 1), D(2001, 1, 17), D(2001, 1, 17), D(2001, 1, 17))],
                                "booking_number string, min_d date, cutoff_week date, first_week date, last_week date")
    compare = FC.counterfactual_mean(panel, win)
    got = {(r.brand, r.category): (r.y, r.yhat) for r in IN.compare_keys(compare, "brand_category").collect()}
    # both nodes read "brand=X|cat=Y|cat=Z", yet stay apart and keep their names
    assert {k: (float(a), float(b)) for k, (a, b) in got.items()} == {("X|cat=Y", "Z"): (1.0, 1.0), ("X", "Y|cat=Z"): (2.0, 2.0)}
    assert {r.subcategory for r in IN.compare_keys(compare, "subcategory").collect()} == {"s|1", "t=2"}
    assert FC.counterfactual_ridge(panel, win).select("key").distinct().count() == panel.select("key").distinct().count()


def test_dose_maps_merge_by_type(spark):
    k = "booking_number string, week_start date, brand string, category string"
    w = D(2001, 1, 3)
    doses = spark.createDataFrame([("b", w, "B", "C1", "fin", 0.5), ("b", w, "B", "C2", "fin", 0.25), ("b", w, "B", "C2", "bus", 1.0)], k + ", media_type string, dose double")
    feats = ", ".join(f"{f} double" for f in EX.FEATURES)
    bc = spark.createDataFrame([("b", w, "B", c, *[1.0] * len(EX.FEATURES)) for c in ("C1", "C2", "C3")], f"{k}, {feats}")
    promo = spark.createDataFrame([("b", "A1", "B", "C2", "S1"), ("b", "A2", "B", "C2", "S2")], "booking_number string, article_id string, brand string, category string, subcategory string")
    one = EX.exposure_by_grain(bc, promo, "brand", doses).first()
    assert one.doses == {"bus": 1.0, "fin": 0.75} and list(one.doses) == ["bus", "fin"]
    by = {r.category: r.doses for r in EX.exposure_by_grain(bc, promo, "brand_category", doses).collect()}
    assert by == {"C1": {"fin": 0.5}, "C2": {"bus": 1.0, "fin": 0.25}, "C3": {}}
    assert {r.subcategory: r.doses for r in EX.exposure_by_grain(bc, promo, "subcategory", doses).collect()} == {s: by["C2"] for s in ("S1", "S2")}
    wide = IN.dose_columns(EX.exposure_by_grain(bc, promo, "sku", doses), ["fin", "bus stop"]).collect()
    assert {(r.article_id, r.dose_fin, r.dose_bus_stop) for r in wide} == {("A1", 0.25, 0.0), ("A2", 0.25, 0.0)}


def test_lines_keep_their_order_over_many_files(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("n")).withColumn("line", F.format_string("line %04d", "n")).repartition(7)
    sinks.write_lines(df, f"{tmp_path}/lines", order=["n"], partitions=5)
    back = [r.line for r in readers.read_lines(spark, f"{tmp_path}/lines").orderBy("file", "at").collect()]
    assert back == [f"line {i:04d}" for i in range(2000)]
    assert readers.read_lines(spark, f"{tmp_path}/lines").select("file").distinct().count() > 1


def test_driver_report_lists_both_models_in_order(spark):
    rows = [(m, g, f, c) for m in ("sales", "shoppers") for g in ("brand", "sku") for f, c in (("a", 3.0), ("b", -1.0), ("c", 0.5), ("d", 2.0), ("woy_sin", 9.0))]
    co = spark.createDataFrame(rows, "metric string, grain string, feature string, coef double")
    camp = co.union(spark.createDataFrame([("sales", "brand", "(intercept)", 99.0)], co.schema))
    rep = IN.driver_report(co, camp, k=3).orderBy("metric", "grain", "section", "ordinal")
    lines = [r.line for r in rep.collect()]
    assert lines[:16] == ["[sales @ brand] Weekly positive drivers:", "  + a (3.000)", "  + d (2.000)", "  + c (0.500)",
                          "[sales @ brand] Weekly negative drivers:", "  - b (-1.000)", "  - c (0.500)", "  - d (2.000)",
                          "[sales @ brand] Campaign positive drivers:", "  + a (3.000)", "  + d (2.000)", "  + c (0.500)",
                          "[sales @ brand] Campaign negative drivers:", "  - b (-1.000)", "  - c (0.500)", "  - d (2.000)"]
    assert len(lines) == 4 * 16


def test_registered_report_reads_back_whole(spark):
    lines = [r.line for r in q_insights.q_driver_report(spark, "/root/testdata/sf0.001").collect()]
    heads = [x for x in lines if x.startswith("[")]
    assert len(heads) == 4 * 60 and heads == sorted(heads, key=lambda x: (x[1:x.index("]")].split(" @ "), "Campaign" in x, "negative" in x))
