"""Catalogue entries for D30-D41 and the models (M2-M7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from upshelf.operators import exposure as EX
from upshelf.operators import insights as IN
from upshelf.operators import market as MK
from upshelf.operators import models as ML
from upshelf.plans import oracle as O
from upshelf.plans.catalog import register, tidy
from upshelf.plans.pipeline import campaigns
from upshelf.sources import readers, sinks

W = O.with_(*O.INSIGHT_CTES)
GRAINS = ["sku", "brand", "brand_category", "brand_subcategory", "category", "subcategory"]
EXR = ["n_assets_cov", "coverage_frac", "exp_weight_brand_cat", "cat_week_exp", "sov", "esov", "market_share"]


def _r(cols, rounded):
    return ", ".join(f"round({c}, 6) AS {c}" if c in rounded else c for c in cols)


_CAL_COLS = ["booking_number", "week_start", "brand", "category", "n_assets_cov", "n_types", "running_carto_media",
             "coverage_frac", "exp_weight_brand_cat"]


@register("exposure_calendar", W + f"SELECT {_r(_CAL_COLS, EXR)} FROM excal")
def q_exposure_calendar(spark, sf_dir):
    return tidy(campaigns(spark, sf_dir).exposure_calendar(), rounded=EXR)


@register("exposure_calendar_weighted", W + """, xw AS (
  SELECT booking_number, week_start, brand, category, cov, len(types) AS k,
         list_sum(list_transform(types, lambda t: CASE t WHEN 'aisle fin' THEN 2.0 WHEN 'bus stop' THEN 1.25 ELSE 0.5 END)) AS w FROM ex_rows)
SELECT booking_number, week_start, brand, category, round(sum(cov), 6) AS n_assets_cov, CAST(sum(k) AS DOUBLE) AS n_types, 1.0 AS running_carto_media,
       round(CASE WHEN sum(cov) > 1 THEN 1.0 ELSE sum(cov) END, 6) AS coverage_frac, round(sum(w * cov), 6) AS exp_weight_brand_cat
FROM xw GROUP BY booking_number, week_start, brand, category""")
def q_exposure_calendar_weighted(spark, sf_dir):
    """Exposure weighted by media type, with a default for all others."""
    c = campaigns(spark, sf_dir)
    weights = readers.type_weights(spark, {"Aisle Fin": 2.0, "bus stop": 1.25, "_default_": 0.5})
    return tidy(EX.exposure_calendar(c.media, c.dim, EX.fleet_size(c.base), weights, c.p), rounded=EXR)


@register("exposure_doses", W + "SELECT booking_number, week_start, brand, category, media_type, has, "
          "round(dose, 6) AS dose FROM exdose")
def q_exposure_doses(spark, sf_dir):
    return tidy(campaigns(spark, sf_dir).exposure_doses(), rounded=["dose"])


@register("brand_pairs", W + "SELECT * FROM ex_pairs")
def q_brand_pairs(spark, sf_dir):
    c = campaigns(spark, sf_dir)
    return EX.brand_pairs(c.media, c.dim)


@register("preperiod_share", W + """SELECT booking_number, brand, category, CAST(sales_brand AS DOUBLE) AS sales_brand,
       CAST(sales_cat AS DOUBLE) AS sales_cat, market_share, is_leader FROM share""")
def q_preperiod_share(spark, sf_dir):
    return tidy(campaigns(spark, sf_dir).share())


_SOV_COLS = _CAL_COLS + ["cat_week_exp", "sov", "market_share", "is_leader", "esov"]


@register("sov_esov", W + f"SELECT {_r(_SOV_COLS, EXR)} FROM sov")
def q_sov(spark, sf_dir):
    return tidy(campaigns(spark, sf_dir).sov().select(*_SOV_COLS), rounded=EXR)


def _grain_entries(g):
    keys = O.GRAIN_KEYS[g]
    feats = EX.FEATURES
    cols = ["booking_number", "week_start", *keys, *feats]

    on = ", ".join(["booking_number", "week_start", *keys])

    @register(f"exposure_by_grain_{g}", W + ", " + O.dose_text_cte(g) + f"""
SELECT {_r(cols, EXR)}, COALESCE(doses, '') AS doses FROM {O.EG_TABLE[g]} LEFT JOIN dose_text USING ({on})""")
    def q_eg(spark, sf_dir):
        text = F.transform(F.map_entries("doses"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("decimal(18,6)").cast("string")))
        return tidy(campaigns(spark, sf_dir).exposure_by_grain(g).select(*cols, F.array_join(text, ";").alias("doses")), rounded=EXR)

    @register(f"discount_depth_{g}", W + ", " + O.depth_cte(g) + f"""
SELECT week_start, {", ".join(keys)}, round(disc_depth, 6) AS disc_depth FROM dd""")
    def q_dd(spark, sf_dir):
        return tidy(campaigns(spark, sf_dir).depth(g), rounded=["disc_depth"])

    hcols = ["campaign_id", "level", "node", "week_start", *keys, "y", "yhat", "uplift", *IN.FILL]
    hr = EXR + ["disc_depth"]

    @register(f"hypothesis_table_{g}", W + ", " + O.hypothesis_cte(g) + f" SELECT {_r(hcols, hr)} FROM hyp")
    def q_hyp(spark, sf_dir):
        return tidy(campaigns(spark, sf_dir).hypothesis(g).select(*hcols), rounded=hr)

    q_eg.__name__, q_dd.__name__, q_hyp.__name__ = f"q_eg_{g}", f"q_dd_{g}", f"q_hyp_{g}"


for _g in GRAINS:
    _grain_entries(_g)



@register("discount_depth_cohort", W + " " + O.depth_cohort_sql())
def q_depth_cohort(spark, sf_dir):
    """D35 over every booking's cohort stores and campaign weeks, all grains."""
    return tidy(campaigns(spark, sf_dir).depth_cohort(), rounded=["disc_depth"])


@register("preperiod_share_cohort", W + ", " + O.SHARE_COHORT + """
SELECT booking_number, brand, category, CAST(sales_brand AS DOUBLE) AS sales_brand, CAST(sales_cat AS DOUBLE) AS sales_cat, market_share, is_leader
FROM cshare""")
def q_share_cohort(spark, sf_dir):
    """D32 over every booking's cohort stores (decision 28)."""
    return tidy(campaigns(spark, sf_dir).share_cohort())


_AGG = ["uplift_total", "n_assets_total", "n_types_avg", "esov_avg", "disc_depth_avg", "is_leader", "duration_weeks"]


@register("campaign_aggregate", W + ", " + O.hypothesis_cte("brand_category") + """
SELECT campaign_id, round(sum(uplift), 6) AS uplift_total, round(sum(n_assets_cov), 6) AS n_assets_total,
       round(avg(n_types), 6) AS n_types_avg, round(avg(esov), 6) AS esov_avg,
       round(avg(disc_depth), 6) AS disc_depth_avg, max(is_leader) AS is_leader,
       count(DISTINCT week_start) AS duration_weeks
FROM hyp GROUP BY campaign_id""")
def q_campaign_aggregate(spark, sf_dir):
    a = IN.campaign_aggregate(campaigns(spark, sf_dir).hypothesis("brand_category"))
    return tidy(a, rounded=[c for c in _AGG if c not in ("is_leader", "duration_weeks")])


@register("calendar_features", W + """SELECT booking_number, level, node, ds, year(ds) AS year, weekofyear(ds) AS woy,
       isodow(ds) - 1 AS dow, round(sin(2 * pi() * month(ds) / 12), 6) + 0.0 AS month_sin,
       round(cos(2 * pi() * month(ds) / 12), 6) + 0.0 AS month_cos, round(sin(2 * pi() * weekofyear(ds) / 52), 6) + 0.0 AS woy_sin,
       round(cos(2 * pi() * weekofyear(ds) / 52), 6) + 0.0 AS woy_cos FROM cmp""")
def q_calendar_features(spark, sf_dir):
    c = campaigns(spark, sf_dir).compare().select("booking_number", "level", "node", "ds")
    return tidy(IN.calendar_features(c), rounded=["month_sin", "month_cos", "woy_sin", "woy_cos"])


@register("weekly_uplift_export", W + """SELECT booking_number, level, node, ds, CAST(y AS DOUBLE) AS y,
       CAST(yhat AS DOUBLE) AS yhat, CAST(uplift AS DOUBLE) AS uplift FROM cmp""")
def q_weekly_uplift_export(spark, sf_dir):
    """S14 -> S10 -> D41: compare rows written as one partitioned dataset and
    read back as a whole before export."""
    c = campaigns(spark, sf_dir)
    path = sinks.table_path(spark, f"compare-{uuid.uuid4().hex}")   # an earlier result may still read its own
    rows = c.compare()
    sinks.write_compare(rows, path)
    back = readers.read_many(spark, path, rows.schema).drop("source_file")
    return tidy(IN.weekly_uplift_export(back).select("booking_number", "level", "node", "ds", "y", "yhat", "uplift"))


# ---- models (no SQL oracle: NumPy solves on Spark-computed sufficient statistics) ----

def _types(c) -> list[str]:
    """Media types. A linear model has a fixed list of features, so their names are read once (one row each)."""
    return sorted(r[0] for r in c.exposure_doses().select("media_type").distinct().collect())


def _weekly_features(c, grain):
    """Hypothesis rows with a column per media type."""
    types = _types(c)
    return IN.dose_columns(c.hypothesis(grain), types), [IN.dose_col(t) for t in types]


def _grid(c, rows, keys):
    """(hypothesis rows of every grain stacked, with a column per media type; the names of these columns)."""
    stacked = None
    for g in GRAINS:
        h = rows(g).select("campaign_id", *keys, "week_start", "uplift", *IN.FILL, "doses").withColumn("grain", F.lit(g))
        stacked = h if stacked is None else stacked.unionByName(h)
    types = _types(c)
    return IN.dose_columns(stacked, types), [IN.dose_col(t) for t in types]


@register("within_campaign_coefs")
def q_within_campaign_coefs(spark, sf_dir):
    c = campaigns(spark, sf_dir)
    h, doses = _weekly_features(c, "brand_category")
    return ML.fit_weekly_within_campaign(h, ML.WEEKLY_BASE + doses, alpha=c.p.ridge_alpha,
                                         min_weeks=c.p.min_weeks)


@register("campaign_coefs")
def q_campaign_coefs(spark, sf_dir):
    c = campaigns(spark, sf_dir)
    h, doses = _weekly_features(c, "brand_category")
    agg = IN.campaign_aggregate(h, doses)
    return ML.fit_campaign_level(agg, ML.CAMPAIGN_BASE + [f"{d}_avg" for d in doses])


@register("top_drivers")
def q_top_drivers(spark, sf_dir):
    c = campaigns(spark, sf_dir)
    h, doses = _weekly_features(c, "brand_category")
    coefs = ML.fit_weekly_within_campaign(h, ML.WEEKLY_BASE + doses, alpha=c.p.ridge_alpha)
    return IN.top_drivers(coefs, k=c.p.top_k)


@register("model_grid_coefs")
def q_model_grid(spark, sf_dir):
    """M7: within-campaign ridge for every grain in one Spark job (grouped sums), doses included."""
    c = campaigns(spark, sf_dir)
    rows, doses = _grid(c, c.hypothesis, [])
    return ML.fit_weekly_within_campaign(rows, ML.WEEKLY_BASE + doses, alpha=c.p.ridge_alpha,
                                         min_weeks=c.p.min_weeks, keys=("grain",))


@register("scenario_scores")
def q_scenario_scores(spark, sf_dir):
    """M5: score every campaign-week of the table itself as a scenario."""
    c = campaigns(spark, sf_dir)
    h, doses = _weekly_features(c, "brand_category")
    feats = ML.WEEKLY_BASE + doses
    coefs = ML.fit_weekly_within_campaign(h, feats, alpha=c.p.ridge_alpha)
    hh = h.withColumn("woy_sin", F.sin(2 * 3.141592653589793 * F.weekofyear("week_start") / 52.0)) \
          .withColumn("woy_cos", F.cos(2 * 3.141592653589793 * F.weekofyear("week_start") / 52.0))
    sc = hh.select(F.concat_ws("|", "campaign_id", "node", F.col("week_start").cast("string")).alias("scenario_id"),
                   F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                                       for f in feats])).alias("kv")).select("scenario_id", "kv.feature", "kv.value")
    return ML.score_weekly(sc, coefs)


@register("campaign_scenario_scores")
def q_campaign_scenario_scores(spark, sf_dir):
    """M6: score every campaign's own aggregate as a scenario with the campaign model."""
    c = campaigns(spark, sf_dir)
    h, doses = _weekly_features(c, "brand_category")
    agg = IN.campaign_aggregate(h, doses)
    feats = ML.CAMPAIGN_BASE + [f"{d}_avg" for d in doses]
    coefs = ML.fit_campaign_level(agg, feats)
    sc = agg.select(F.col("campaign_id").alias("scenario_id"),
                    F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                                        for f in feats])).alias("kv")).select("scenario_id", "kv.feature", "kv.value")
    return ML.score_campaign(sc, coefs)


def _full_weekly(c):
    rows, doses = _grid(c, c.hypothesis_full, ["metric"])
    return ML.fit_weekly_within_campaign(rows, ML.WEEKLY_BASE + doses, alpha=c.p.ridge_alpha, min_weeks=c.p.min_weeks, keys=("metric", "grain"))


def _full_campaign(c):
    rows, doses = _grid(c, c.hypothesis_full, ["metric"])
    agg = IN.campaign_aggregate(rows, doses, keys=("metric", "grain"))
    return ML.fit_campaign_level(agg, ML.CAMPAIGN_BASE + [f"{d}_avg" for d in doses], keys=("metric", "grain"))


@register("model_grid_full_coefs")
def q_model_grid_full(spark, sf_dir):
    """M7 over ten metrics × six grains: 60 within-campaign ridge models from
    one grouped aggregate of sufficient statistics (one Spark job)."""
    return _full_weekly(campaigns(spark, sf_dir))


_GRID_AGG = """SELECT metric, grain, campaign_id, sum(uplift) AS uplift_total, sum(n_assets_cov) AS n_assets_total,
         avg(n_types) AS n_types_avg, avg(esov) AS esov_avg, avg(disc_depth) AS disc_depth_avg, max(is_leader) AS is_leader,
         count(DISTINCT week_start) AS duration_weeks
  FROM grid GROUP BY metric, grain, campaign_id"""
_GRID_R = ["uplift_total", "n_assets_total", "n_types_avg", "esov_avg", "disc_depth_avg"]


@register("campaign_aggregate_grid", O.with_(*O.GRID_CTES) + "SELECT metric, grain, campaign_id, "
          + ", ".join(f"round({x}, 6) + 0.0 AS {x}" for x in _GRID_R) + f", is_leader, duration_weeks FROM ({_GRID_AGG})")
def q_campaign_aggregate_grid(spark, sf_dir):
    """D38 / A27 for ten metrics × six grains."""
    rows, _ = _grid(campaigns(spark, sf_dir), campaigns(spark, sf_dir).hypothesis_full, ["metric"])
    a = IN.campaign_aggregate(rows, keys=("metric", "grain"))
    return tidy(a, rounded=_GRID_R)


@register("campaign_grid_coefs")
def q_campaign_grid_coefs(spark, sf_dir):
    """M3 inside M7: 60 campaign-level models, solved together; tests compare them with NumPy."""
    return _full_campaign(campaigns(spark, sf_dir))


@register("driver_report")
def q_driver_report(spark, sf_dir):
    """O4 + F29 + S16: top three drivers of both models for every metric and grain, written as text in order and read
    back with the place of every line."""
    c = campaigns(spark, sf_dir)
    path = sinks.table_path(spark, f"drivers-{uuid.uuid4().hex}")
    # every section reads the coefficients several times: solved once
    weekly, campaign = c._m("coefs_full_weekly", lambda: _full_weekly(c)), c._m("coefs_full_campaign", lambda: _full_campaign(c))
    sinks.write_lines(IN.driver_report(weekly, campaign), path, order=["metric", "grain", "section", "ordinal"])
    return readers.read_lines(spark, path).orderBy("file", "at").select("line")


@register("campaign_grid_slopes", O.with_(*O.GRID_CTES) + f"""SELECT metric, grain, round(regr_slope(uplift_total, n_assets_total), 4) + 0.0 AS slope,
       round(regr_intercept(uplift_total, n_assets_total), 4) + 0.0 AS intercept FROM ({_GRID_AGG}) WHERE uplift_total IS NOT NULL
GROUP BY metric, grain HAVING var_pop(n_assets_total) > 1e-12""")
def q_campaign_grid_slopes(spark, sf_dir):
    """M3 on one feature for every metric and grain whose campaigns differ in it."""
    c = campaigns(spark, sf_dir)
    agg = IN.campaign_aggregate(_grid(c, c.hypothesis_full, ["metric"])[0], keys=("metric", "grain"))
    fit = ML.fit_campaign_level(agg, ["n_assets_total"], keys=("metric", "grain"))
    of = lambda f: F.max(F.when(F.col("feature") == f, F.col("coef")))
    spread = agg.where("uplift_total is not null").groupBy("metric", "grain").agg(F.var_pop("n_assets_total").alias("v")).where("v > 1e-12")
    out = fit.groupBy("metric", "grain").agg(of("n_assets_total").alias("slope"), of("(intercept)").alias("intercept"))
    return tidy(out.join(spread, ["metric", "grain"], "left_semi"), rounded=["slope", "intercept"], digits=4)


_DRIVERS = ["n_assets_cov", "n_types", "disc_depth", "sov", "esov", "running_carto_media"]


@register("within_campaign_slopes", W + ", " + O.hypothesis_cte("brand_category") + ", hl AS (\n  "
          + "\n  UNION ALL ".join(f"SELECT '{d}' AS driver, campaign_id, week_start, uplift, {d} AS x FROM hyp WHERE uplift IS NOT NULL" for d in _DRIVERS)
          + """), hk AS (SELECT driver, campaign_id FROM hl GROUP BY ALL HAVING count(DISTINCT week_start) >= 2),
hd AS (SELECT driver, x - avg(x) OVER (PARTITION BY driver, campaign_id) AS x, uplift - avg(uplift) OVER (PARTITION BY driver, campaign_id) AS y
  FROM hl JOIN hk USING (driver, campaign_id)),
hs AS (SELECT driver, count(*) AS n, CASE WHEN stddev_pop(x) <= 1e-9 THEN 1.0 ELSE stddev_pop(x) END AS sd, sum(x * y) AS xy, sum(x * x) AS xx,
         regr_slope(y, x) AS slope FROM hd GROUP BY driver)
SELECT driver, round(sd, 6) + 0.0 AS scale, round(CASE WHEN sd = 1.0 AND xx < 1e-12 THEN 0.0 ELSE xy / sd / (xx / sd / sd + 10.0) END, 4) + 0.0 AS coef,
       CASE WHEN xx > 1e-9 THEN round(slope, 4) + 0.0 END AS slope FROM hs""")
def q_within_campaign_slopes(spark, sf_dir):
    """M2 one driver at a time: the ridge coefficient on the standardised scale, and the plain slope (no ridge)."""
    c = campaigns(spark, sf_dir)
    h = c.hypothesis("brand_category")
    rows = h.select("campaign_id", "week_start", "uplift", F.inline(F.array(*[
        F.struct(F.lit(d).alias("driver"), F.col(d).alias("x")) for d in _DRIVERS])))
    ridge = ML.fit_weekly_within_campaign(rows, ["x"], alpha=c.p.ridge_alpha, min_weeks=c.p.min_weeks, keys=("driver",))
    plain = ML.within_campaign(rows, ["x"], min_weeks=c.p.min_weeks, keys=("driver",)).select(
        "driver", F.when(F.col("c_0_0") > 1e-9, F.col("c_0_y") / F.col("c_0_0")).alias("slope"))
    return tidy(ridge.join(plain, "driver").select("driver", F.round("scale", 6).alias("scale"), "coef", "slope"), rounded=["coef", "slope"], digits=4)
