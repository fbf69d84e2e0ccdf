"""Dynamic cohorts (decision 8, ``cohort="dynamic"``): every campaign week is
forecast over *that week's* treated stores — each asset's own weeks × its own
store list — instead of one static store set for the whole campaign.

Set-based: weeks whose store sets are identical share one cohort, named by a
hash of the sorted store list ("ALL" when an all-stores asset runs that week).
Each cohort gets one panel series and one training fit; a campaign week is
predicted from the series of its own cohort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upshelf.operators import media as M
from upshelf.operators.forecast import micro
from upshelf.operators.nodes import ARTICLE_WEEK, NODE, expand_levels
from upshelf.operators.scope import in_window, spread

ALL = "ALL"   # cohort name of an all-stores week


def week_cohorts(media: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(booking, week, cohort) for every covered week, and the cohort members
    (booking, cohort, store_id) of listed cohorts. Store sets per week are
    bounded by the fleet size."""
    cal = M.store_calendar(media, windows, cohort="dynamic")
    sig = cal.groupBy("booking_number", "week_start").agg(
        F.when(F.max("all_stores"), F.lit(ALL)).otherwise(
            F.sha2(F.array_join(F.array_sort(F.collect_set("store_id")), ","), 256)).alias("cohort"))
    members = (cal.where(~F.col("all_stores")).join(sig.where(F.col("cohort") != ALL), ["booking_number", "week_start"])
               .select("booking_number", "cohort", "store_id").distinct())
    return sig, members


def dynamic_panel(base: DataFrame, candidates: DataFrame, windows: DataFrame, sig: DataFrame, members: DataFrame,
                  registry: DataFrame) -> DataFrame:
    """y per (booking, cohort, level, node, week) over each cohort's stores."""
    rows = in_window(spread(base, "article_id").join(candidates, "article_id"), windows)
    listed = rows.join(members, ["booking_number", "store_id"])
    allc = rows.join(sig.where(F.col("cohort") == ALL).select("booking_number", "cohort").distinct(), "booking_number")
    r = listed.unionByName(allc)
    pre = r.groupBy(*ARTICLE_WEEK, "cohort").agg(F.sum("sales").alias("y"))
    x = expand_levels(pre, ["cohort", "y"]).withColumn("key", F.struct("k1", "k2"))
    return (x.join(registry, ["booking_number", "level", "k1", "k2"])
            .groupBy("booking_number", "cohort", *NODE, "week_start").agg(F.sum("y").alias("y")))


def counterfactual_dynamic(panel: DataFrame, windows: DataFrame, sig: DataFrame) -> DataFrame:
    """Mean learner per (booking, cohort, node): train on the cohort's weeks
    before the cutoff, predict each campaign week from its own cohort."""
    w = windows.select("booking_number", "min_d", "cutoff_week", "first_week", "last_week")
    j = panel.join(w, "booking_number")
    node = [c for c in NODE if c in panel.columns]
    g = ["booking_number", "cohort", *node]
    train = j.where((F.col("week_start") >= F.col("min_d")) & (F.col("week_start") < F.col("cutoff_week")))
    yhat = train.groupBy(*g).agg(micro(F.sum("y").cast("double") / F.count("y")).alias("yhat"))
    test = (j.where(F.col("week_start").between(F.col("first_week"), F.col("last_week")))
            .join(sig, ["booking_number", "week_start", "cohort"], "left_semi"))
    return (test.join(yhat, g, "left")
            .select("booking_number", *node, F.col("week_start").alias("ds"), "y", "yhat",
                    (F.col("y") - F.col("yhat")).alias("uplift")))
