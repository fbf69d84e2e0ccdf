"""Media exposure (D30, D31), share of voice (D33) and grain projections.

Per-type doses are data, not columns: long form (``media_type`` rows) or, beside
the other exposure features, a map from type to dose that is merged at every
grain. No list of types is needed to name columns; ``insights.dose_columns``
reads single types out of the map at the model edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upshelf.functions.numeric import clip_upper
from upshelf.functions.weeks import week_range
from upshelf.operators.media import load_media
from upshelf.plans.params import DEFAULT, Params

UNSPECIFIED_TYPE = "_unspecified_"   # fixed value: placeholder type of an asset without types
DEFAULT_KEY = "_default_"            # fixed value: weight-table row holding the default weight
CAL_KEYS = ["booking_number", "week_start", "brand", "category"]


def fleet_size(base: DataFrame):
    """Number of distinct stores, as an in-plan scalar subquery."""
    return base.select(F.count_distinct("store_id")).scalar()


def assets(media: DataFrame, fleet, weights: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """One row per asset (media-master row) and media type with its weight and
    the asset's coverage (F22, F23)."""
    fleet = fleet if isinstance(fleet, Column) else F.lit(fleet)
    m = load_media(media)
    types = F.array_sort(F.array_distinct(F.transform("media_type_array", lambda t: F.lower(t))))
    types = F.when(F.size(types) == 0, F.array(F.lit(UNSPECIFIED_TYPE))).otherwise(types)
    stores = F.filter("sorted_store_list", lambda s: F.trim(s) != "")
    n = F.size(stores)
    cov = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), n / F.greatest(F.lit(1), fleet)))
    a = m.select("booking_number", "study_id", "media_start_date", "media_end_date", "sorted_sku_list",
                 cov.alias("cov"), F.size(types).alias("n_types"), F.explode(types).alias("media_type"))
    if weights is None:
        return a.withColumn("w", F.lit(p.default_type_weight))
    wt = weights.select(F.lower("media_type").alias("media_type"), "weight")
    dflt = wt.where(F.col("media_type") == DEFAULT_KEY).select(F.max("weight")).scalar()
    return (a.join(wt.where(F.col("media_type") != DEFAULT_KEY), "media_type", "left")
            .withColumn("w", F.coalesce("weight", dflt, F.lit(p.default_type_weight))).drop("weight"))


def brand_pairs(media: DataFrame, dim: DataFrame) -> DataFrame:
    """Distinct (asset, brand, category) of each asset's SKUs; assets
    whose SKUs are unknown have no pair and are dropped (decision 24)."""
    m = load_media(media)
    s = m.select("study_id", F.explode("sorted_sku_list").alias("article_id"))
    return (s.join(dim.select("article_id", "brand", "category"), "article_id")
            .where(F.col("brand").isNotNull() & F.col("category").isNotNull())
            .select("study_id", "brand", "category").distinct())


def asset_counts(media: DataFrame, dim: DataFrame) -> DataFrame:
    """Per booking the assets, and those without a known article: they have no brand pair and so no exposure."""
    known = brand_pairs(media, dim).select("study_id").distinct().withColumn("_known", F.lit(1))
    return (media.select("booking_number", "study_id").join(known, "study_id", "left").groupBy("booking_number")
            .agg(F.count("study_id").alias("n_assets"), F.count(F.when(F.col("_known").isNull(), 1)).alias("n_unknown_assets")))


def _asset_weeks(at: DataFrame, pairs: DataFrame) -> DataFrame:
    return (at.join(pairs, "study_id")
            .withColumn("week_start", F.explode(week_range("media_start_date", "media_end_date"))))


def exposure_calendar(media: DataFrame, dim: DataFrame, fleet, weights: DataFrame | None = None,
                      p: Params = DEFAULT) -> DataFrame:
    """Booking × week × brand × category exposure, overlapping assets
    rolled up, coverage clipped at 1."""
    at = assets(media, fleet, weights, p)
    per_asset = at.groupBy("booking_number", "study_id", "media_start_date", "media_end_date", "cov", "n_types") \
        .agg(F.sum("w").alias("w_sum"))
    x = _asset_weeks(per_asset, brand_pairs(media, dim))
    return x.groupBy(*CAL_KEYS).agg(
        F.sum("cov").alias("n_assets_cov"),
        F.sum("n_types").cast("double").alias("n_types"),
        F.max(F.lit(1.0)).alias("running_carto_media"),
        clip_upper(F.sum("cov")).alias("coverage_frac"),
        F.sum(F.col("w_sum") * F.col("cov")).alias("exp_weight_brand_cat"))


def exposure_doses(media: DataFrame, dim: DataFrame, fleet, weights: DataFrame | None = None,
                   p: Params = DEFAULT) -> DataFrame:
    """Per-type has/dose in long form: dose = coverage × type weight."""
    at = assets(media, fleet, weights, p)
    x = _asset_weeks(at, brand_pairs(media, dim))
    return x.groupBy(*CAL_KEYS, "media_type").agg(F.max(F.lit(1.0)).alias("has"),
                                                  F.sum(F.col("cov") * F.col("w")).alias("dose"))


def dose_maps(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doses): the doses of equal keys and types summed, as a map sorted by type."""
    return (long.groupBy(*keys, "media_type").agg(F.sum("dose").alias("dose"))
            .groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("media_type", "dose")))).alias("doses")))


def sov_esov(cal: DataFrame, share: DataFrame, scope: str = "booking") -> DataFrame:
    """sov = brand weight / (week, category) weight; esov = sov - share.

    ``scope="booking"`` (default, as modelled) shares the denominator only
    among the same campaign's assets; ``"market"`` across all campaigns."""
    part = ["week_start", "category"] + (["booking_number"] if scope == "booking" else [])
    den = F.sum("exp_weight_brand_cat").over(Window.partitionBy(*part))
    s = share.select("booking_number", "brand", "category", "market_share", "is_leader")
    out = (cal.withColumn("cat_week_exp", den)
           .withColumn("sov", F.when(F.col("cat_week_exp") > 0, F.col("exp_weight_brand_cat") / F.col("cat_week_exp"))
                       .otherwise(F.lit(0.0)))
           .join(s, ["booking_number", "brand", "category"], "left")
           .withColumn("market_share", F.coalesce("market_share", F.lit(0.0)))
           .withColumn("is_leader", F.coalesce("is_leader", F.lit(0)).cast("long")))
    return out.withColumn("esov", F.col("sov") - F.col("market_share"))


FEATURES = ["running_carto_media", "n_assets_cov", "n_types", "coverage_frac", "sov", "esov", "is_leader",
            "exp_weight_brand_cat"]


def no_doses() -> Column:
    return F.create_map().cast("map<string,double>")


def _roll(df: DataFrame, keys: list[str], sov: str) -> DataFrame:
    """Exposure rows summed to ``keys``, their dose maps merged type by type."""
    doses = dose_maps(df.select(*keys, F.explode("doses").alias("media_type", "dose")), keys)
    return _roll_features(df, keys, sov).join(doses, keys, "left").withColumn("doses", F.coalesce("doses", no_doses()))


def _roll_features(df: DataFrame, keys: list[str], sov: str) -> DataFrame:
    sov_agg = (F.avg("sov") if sov == "mean" else clip_upper(F.sum("sov"))).alias("sov")
    esov_agg = (F.avg("esov") if sov == "mean" else F.sum("esov")).alias("esov")
    return df.groupBy(*keys).agg(
        F.sum("n_assets_cov").alias("n_assets_cov"), F.sum("n_types").alias("n_types"),
        F.max("running_carto_media").alias("running_carto_media"), F.max("coverage_frac").alias("coverage_frac"),
        F.sum("exp_weight_brand_cat").alias("exp_weight_brand_cat"), sov_agg, esov_agg,
        F.max("is_leader").alias("is_leader"))


def exposure_by_grain(bc: DataFrame, promo_dim: DataFrame, grain: str, doses: DataFrame | None = None) -> DataFrame:
    """Project the brand×category exposure (with sov/esov) to a grain.

    brand: sums, sov/esov means; category: sums, sov summed and clipped at 1;
    brand_subcategory: rows repeated per promoted subcategory of the pair and
    sov re-based within (week, subcategory); subcategory: roll-up of that;
    sku: each promoted article inherits its brand×category row. ``doses``
    (long form at brand×category) become a map: summed in roll-ups, inherited
    otherwise."""
    keep = ["booking_number", "week_start"]
    out = [*FEATURES, "doses"]
    bc = (bc.withColumn("doses", no_doses()) if doses is None else
          bc.join(dose_maps(doses, CAL_KEYS), CAL_KEYS, "left").withColumn("doses", F.coalesce("doses", no_doses())))
    if grain == "brand_category":
        return bc.select(*keep, "brand", "category", *out)
    if grain == "brand":
        return _roll(bc, keep + ["brand"], "mean").select(*keep, "brand", *out)
    if grain == "category":
        return _roll(bc, keep + ["category"], "sum").select(*keep, "category", *out)
    pairs = promo_dim.select("booking_number", "brand", "category", "subcategory").where(
        F.col("brand").isNotNull() & F.col("category").isNotNull() & F.col("subcategory").isNotNull()).distinct()
    if grain in ("brand_subcategory", "subcategory"):
        bsc = bc.join(pairs, ["booking_number", "brand", "category"])
        den = F.sum("exp_weight_brand_cat").over(Window.partitionBy("booking_number", "week_start", "subcategory"))
        bsc = bsc.withColumn("sov", F.when(den > 0, F.col("exp_weight_brand_cat") / den).otherwise(F.lit(0.0)))
        if grain == "brand_subcategory":
            return bsc.select(*keep, "brand", "subcategory", *out)
        return _roll(bsc, keep + ["subcategory"], "sum").select(*keep, "subcategory", *out)
    if grain == "sku":
        skus = promo_dim.select("booking_number", "article_id", "brand", "category").where(
            F.col("brand").isNotNull() & F.col("category").isNotNull()).distinct()
        return skus.join(bc, ["booking_number", "brand", "category"], "left").select(
            *keep, "article_id", *out).where(F.col("week_start").isNotNull())
    raise ValueError(grain)
