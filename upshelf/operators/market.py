"""Pre-period market share (D32) and discount depth.

Both have a form over all stores and one over each booking's cohort stores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upshelf.functions.keys import LEVEL_KEYS, LEVELS
from upshelf.functions.weeks import week_start
from upshelf.operators.scope import cohort_filter
from upshelf.plans.params import DEFAULT, Params

DEPTH_KEYS = LEVEL_KEYS          # grain -> key columns of the discount depth


def preperiod_share(base: DataFrame, windows: DataFrame, p: Params = DEFAULT, stores: DataFrame | None = None,
                    ) -> DataFrame:
    """Per booking, brand × category sales over the ``preperiod_weeks``
    before the training cutoff (media start - 1 day), the category total,
    the share and the leader flag (rank 1 of share in the category; ties give
    several leaders). ``stores`` restricts to cohort stores (decision 28);
    default all stores."""
    keys = ["week_start", "brand", "category"] + (["store_id"] if stores is not None else [])
    pre = base.groupBy(*keys).agg(F.sum("sales").alias("sales"))
    w = windows.select("booking_number", F.col("train_end_raw").alias("_cut"), "all_stores")
    lo = F.date_sub(F.col("_cut"), 7 * p.preperiod_weeks)
    # Each booking's pre-period is a set of preperiod_weeks week starts, from the first one not before ``lo``:
    # explode them and equi-join on the week instead of a range join.
    weeks = w.select("booking_number", "_cut", "all_stores", F.explode(F.sequence(
        week_start(F.date_add(lo, 6)), F.date_sub(F.col("_cut"), 1), F.expr("INTERVAL 7 DAY"))).alias("week_start"))
    j = pre.join(weeks, "week_start")
    if stores is not None:
        j = cohort_filter(j, windows, stores)
    bc = j.groupBy("booking_number", "brand", "category").agg(F.sum("sales").alias("sales_brand"))
    out = bc.withColumn("sales_cat", F.sum("sales_brand").over(Window.partitionBy("booking_number", "category")))
    share = F.when(F.col("sales_cat") > 0, F.col("sales_brand").cast("double") / F.col("sales_cat").cast("double")) \
        .otherwise(F.lit(0.0))
    out = out.withColumn("market_share", share)
    rk = F.rank().over(Window.partitionBy("booking_number", "category").orderBy(F.desc("market_share")))
    return out.withColumn("is_leader", (rk == 1).cast("long")).select(
        "booking_number", "brand", "category", "sales_brand", "sales_cat", "market_share", "is_leader")


def depth_sums(base: DataFrame, p: Params = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """D35 in one pass over the base: per week, level and node keys (k1, k2) the weighted discount sum, the weight sum
    and the largest discount. Weights are |sales| + eps. ``by``: further columns to keep (``store_id``)."""
    w = F.abs(F.col("sales")).cast("double") + F.lit(p.weight_eps)
    keys = lambda lv, i: F.col(LEVEL_KEYS[lv][i]) if i < len(LEVEL_KEYS[lv]) else F.lit("")
    nodes = F.array(*[F.struct(F.lit(lv).alias("level"), keys(lv, 0).alias("k1"), keys(lv, 1).alias("k2")) for lv in LEVELS])
    d = F.col("discountpercent").cast("double")
    return (base.select("week_start", *by, d.alias("d"), (d * w).alias("dw"), w.alias("w"), F.inline(nodes))
            .groupBy("week_start", *by, "level", "k1", "k2")
            .agg(F.sum("dw").alias("dw"), F.sum("w").alias("w"), F.max("d").alias("top")))


def _depth(sums: DataFrame, top, p: Params):
    """Percent values (largest of the whole table > threshold) are turned into fractions, decided once (decision 25)."""
    return sums.withColumn("disc_depth", F.col("dw") / F.col("w") * F.when(top > p.discount_threshold, F.lit(0.01)).otherwise(F.lit(1.0)))


def discount_depth(sums: DataFrame, grain: str, p: Params = DEFAULT) -> DataFrame:
    """Weekly sales-weighted discount depth at a grain, from ``depth_sums``."""
    top = sums.where(F.col("level") == "category").select(F.max("top")).scalar()
    keys = DEPTH_KEYS[grain]
    return _depth(sums.where(F.col("level") == grain), top, p).select(
        "week_start", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keys, 1)], "disc_depth")


def discount_depth_cohort(store_sums: DataFrame, windows: DataFrame, stores: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """D35 over each booking's cohort stores in its campaign weeks, all grains: (booking, level, k1, k2, week, depth).

    ``store_sums``: ``depth_sums`` by store, so a store's articles are summed before bookings fan out. The threshold
    is decided on the whole table, before stores are filtered."""
    top = store_sums.where(F.col("level") == "category").select(F.max("top")).scalar()
    weeks = windows.select("booking_number", F.explode(F.sequence("first_week", "last_week", F.expr("INTERVAL 7 DAY"))).alias("week_start"))
    own = cohort_filter(store_sums.join(weeks, "week_start"), windows, stores)
    sums = own.groupBy("booking_number", "level", "k1", "k2", "week_start").agg(F.sum("dw").alias("dw"), F.sum("w").alias("w"))
    return _depth(sums, top, p).drop("dw", "w")
