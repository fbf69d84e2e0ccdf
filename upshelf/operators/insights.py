"""Hypothesis tables (D36, D37), campaign aggregate (D38), top drivers (D39),
calendar features (D40) and the weekly uplift export (D41)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upshelf.functions.weeks import calendar_features as cal_cols
from upshelf.operators.exposure import FEATURES, no_doses
from upshelf.operators.market import DEPTH_KEYS

FILL = FEATURES + ["disc_depth"]


def compare_keys(compare: DataFrame, level: str) -> DataFrame:
    """Compare rows of one level with the key columns of their typed node key: names may hold any character."""
    cols = [F.col("key")[f"k{i}"].alias(c) for i, c in enumerate(DEPTH_KEYS[level], 1)]
    return compare.where(F.col("level") == level).select("*", *cols).withColumnRenamed("ds", "week_start")


def hypothesis_table(compare: DataFrame, exposure: DataFrame, depth: DataFrame, grain: str) -> DataFrame:
    """Compare rows of a grain ⋈ exposure features ⋈ discount depth,
    zero-filled; one row per (campaign, node, week), with the type doses as a map."""
    keys = DEPTH_KEYS[grain]
    metric = ["metric"] if "metric" in compare.columns else []
    c = compare_keys(compare, grain).select("booking_number", *metric, "level", "node", "week_start", *keys,
                                            "y", "yhat", "uplift")
    x = (c.join(exposure, ["booking_number", "week_start", *keys], "left")
         .join(depth, ["week_start", *keys], "left"))
    return x.select(F.col("booking_number").alias("campaign_id"), *metric, "level", "node", "week_start", *keys,
                    "y", "yhat", "uplift",
                    *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FILL],
                    F.coalesce("doses", no_doses()).alias("doses"))


def dose_columns(table: DataFrame, types: list[str]) -> DataFrame:
    """One column (``dose_<type>``, missing as 0) per wanted type of the table's dose maps."""
    return table.select("*", *[F.coalesce(F.col("doses")[t], F.lit(0.0)).alias(dose_col(t)) for t in types])


def dose_col(t: str) -> str:
    return "dose_" + "".join(ch if ch.isalnum() else "_" for ch in t)


def campaign_aggregate(weekly: DataFrame, dose_cols: list[str] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """Campaign totals and means (A27) including duration in weeks; ``keys`` (metric, grain) are kept apart."""
    return weekly.groupBy(*keys, "campaign_id").agg(
        F.sum("uplift").alias("uplift_total"),
        F.sum("n_assets_cov").alias("n_assets_total"),
        F.avg("n_types").alias("n_types_avg"),
        F.avg("esov").alias("esov_avg"),
        F.avg("disc_depth").alias("disc_depth_avg"),
        F.max("is_leader").alias("is_leader"),
        F.count_distinct("week_start").alias("duration_weeks"),
        *[F.avg(c).alias(f"{c}_avg") for c in dose_cols])


def calendar_features(df: DataFrame, ds: str = "ds") -> DataFrame:
    """Year, ISO week, weekday and cyclic month / week features."""
    return df.select("*", *cal_cols(ds))


SEASONAL = ["woy_sin", "woy_cos"]


def top_drivers(coefs: DataFrame, k: int = 5, exclude: list[str] = SEASONAL, digits: int = 3) -> DataFrame:
    """D39 (O4 + F29): k largest and k smallest coefficients per model key
    (seasonality excluded) with a formatted report line. ``ordinal`` numbers
    the lines of a model: positive drivers first, largest effect first."""
    keys = [c for c in ["model", "metric", "grain"] if c in coefs.columns]
    c = coefs.where(~F.col("feature").isin(*exclude))
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("coef"), "feature"))
    neg = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc("coef"), "feature"))
    r = c.select("*", pos.alias("rank_pos"), neg.alias("rank_neg"))
    side = lambda sign, rank, first: r.where(F.col(rank) <= k).select(
        *keys, F.lit(sign).alias("sign"), F.col(rank).alias("rank"), "feature", "coef", (F.col(rank) + first).alias("ordinal"))
    out = side("+", "rank_pos", 0).unionByName(side("-", "rank_neg", k))
    return out.withColumn("line", F.format_string(f"  %s %s (%.{digits}f)", "sign", "feature", "coef"))


def driver_report(weekly: DataFrame, campaign: DataFrame, k: int = 3) -> DataFrame:
    """The lines of a driver report in a fixed order: per metric and grain, each model's title, positive and negative
    drivers. Columns ``metric, grain, section, ordinal`` are the order, ``line`` the text (see ``sinks.write_lines``)."""
    both = None
    for section, (title, coefs) in enumerate((("Weekly", weekly), ("Campaign", campaign))):
        top = top_drivers(coefs.where(F.col("feature") != "(intercept)"), k)
        heads = coefs.select("metric", "grain").distinct().select("metric", "grain", F.inline(F.array(
            F.struct(F.lit(0).alias("ordinal"), F.format_string(f"[%s @ %s] {title} positive drivers:", "metric", "grain").alias("line")),
            F.struct(F.lit(k + 1).alias("ordinal"), F.format_string(f"[%s @ %s] {title} negative drivers:", "metric", "grain").alias("line")))))
        # drivers follow their title: positive ones are 1..k, negative ones k + 2 .. 2k + 1
        rows = top.select("metric", "grain", (F.col("ordinal") + F.when(F.col("sign") == "-", 1).otherwise(0)).alias("ordinal"), "line")
        part = heads.unionByName(rows).withColumn("section", F.lit(section))
        both = part if both is None else both.unionByName(part)
    return both.select("metric", "grain", "section", "ordinal", "line")


def weekly_uplift_export(compare: DataFrame) -> DataFrame:
    """Stacked compare rows with uplift, ready for one CSV."""
    return compare.select("booking_number", "level", "node", "ds", "y", "yhat",
                          F.coalesce("uplift", F.col("y") - F.col("yhat")).alias("uplift"))
