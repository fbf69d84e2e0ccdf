"""Array-column algebra and the learners built on it, against NumPy."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from upshelf.functions.linalg import dot, solve_spd
from upshelf.functions.weeks import calendar_features
from upshelf.operators import cohort as CO
from upshelf.operators import forecast as FC
from upshelf.operators import models as ML
from upshelf.operators.nodes import REGRESSORS
from upshelf.plans.pipeline import campaigns

SF = os.environ.get("UPSHELF_TEST_SF", "/root/testdata/sf0.01")
KEYS = ["booking_number", "level", "node"]


def test_solve_spd_matches_numpy(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for i in range(40):
        x, b = rng.normal(size=(12, 6)), rng.normal(size=6)
        a = x.T @ x + 0.5 * np.eye(6)
        rows.append((i, np.hstack([a, b[:, None]]).tolist()))
        want[i] = np.linalg.solve(a, b)
    df = spark.createDataFrame(rows, "id int, m array<array<double>>")
    for r in df.select("id", solve_spd(F.col("m"), 6).alias("x"), dot(F.col("m")[0], F.col("m")[1]).alias("d")).collect():
        assert np.allclose(r.x, want[r.id], rtol=1e-9)
        assert np.isclose(r.d, np.dot(rows[r.id][1][0], rows[r.id][1][1]))


def _node_ridge(pdf, feats, alpha):
    """The textbook solve of one node: standardise, centre, ridge."""
    tr, te = pdf[pdf.is_train], pdf[pdf.is_test]
    if te.empty:
        return pd.DataFrame()
    if tr.empty:
        return te.assign(yhat=np.nan)
    x, y = tr[feats].fillna(0.0).to_numpy(float), tr["y"].to_numpy(float)
    mu, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd <= 1e-9 * np.maximum(1.0, np.abs(mu))] = 1.0
    z = (x - mu) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(len(feats)), z.T @ (y - y.mean()))
    return te.assign(yhat=y.mean() + (te[feats].fillna(0.0).to_numpy(float) - mu) / sd @ w)


def test_ridge_of_every_node_matches_numpy(spark):
    c = campaigns(spark, "/root/testdata/sf0.001")
    names = ["year", "woy", "dow", "month_sin", "month_cos", "woy_sin", "woy_cos"]
    cal = dict(zip(names, calendar_features("week_start")))
    w = c.windows
    x = (c.panel().join(w, "booking_number").join(c.regressors(), ["booking_number", "week_start"], "left")
         .select(*KEYS, "week_start", F.col("y").cast("double").alias("y"), *[cal[f].alias(f) for f in FC.CAL_FEATURES],
                 *[F.col(r).cast("double").alias(r) for r in REGRESSORS],
                 ((F.col("week_start") >= F.col("min_d")) & (F.col("week_start") < F.col("cutoff_week"))).alias("is_train"),
                 F.col("week_start").between(F.col("first_week"), F.col("last_week")).alias("is_test"))).toPandas()
    feats = [*FC.CAL_FEATURES, *REGRESSORS]
    want = pd.concat([_node_ridge(g, feats, 1.0) for _, g in x.groupby(KEYS)]).sort_values([*KEYS, "week_start"])
    got = FC.counterfactual_ridge(c.panel(), w, c.regressors(), alpha=1.0).toPandas().sort_values([*KEYS, "ds"])
    assert len(got) == len(want) > 0 and got["node"].tolist() == want["node"].tolist()
    a, b = got["yhat"].to_numpy(float), want["yhat"].to_numpy(float)
    assert np.allclose(a, b, rtol=1e-9, atol=1e-9 * np.nanmax(np.abs(b)), equal_nan=True)
    assert np.allclose(got["uplift"].to_numpy(float), got["y"].to_numpy(float) - a, equal_nan=True)


def test_exog_zero_only_changes_the_prediction(spark):
    c = campaigns(spark, "/root/testdata/sf0.001")
    one = FC.counterfactual_ridge(c.panel(), c.windows, c.regressors(), exog="zero").toPandas().sort_values([*KEYS, "ds"])
    two = FC.counterfactual_ridge(c.panel(), c.windows, c.regressors()).toPandas().sort_values([*KEYS, "ds"])
    assert (one["y"].to_numpy() == two["y"].to_numpy()).all() and not np.allclose(one["yhat"], two["yhat"], equal_nan=True)


def test_within_sums_equal_demeaned_rows(spark):
    rng = np.random.default_rng(8)
    rows = [("big", f"2001-{1 + i % 12:02d}-03", float(v), float(v * 3 + e), 0.3333333) for i, (v, e) in enumerate(rng.normal(size=(5000, 2)) + 100)]
    rows += [("one week", "2001-01-03", 5.0, 9.0, 0.1)] * 4 + [("none", "2001-01-03", 5.0, None, 0.1), ("none", "2001-01-10", 5.0, None, 0.1)]
    rows += [("small", "2001-01-03", 1.0, 7.0, 0.9), ("small", "2001-01-10", None, 5.0, 0.9)]
    df = spark.createDataFrame(rows, "campaign_id string, d string, x double, uplift double, flat double").withColumn("week_start", F.to_date("d"))
    got = ML.within_campaign(df, ["x", "flat"]).first()
    pdf = df.where("uplift is not null and campaign_id in ('big', 'small')").fillna(0.0).toPandas()
    dm = pdf[["x", "flat", "uplift"]] - pdf.groupby("campaign_id")[["x", "flat", "uplift"]].transform("mean")
    assert got.n == 5002 and got.c_1_1 == got.c_0_1 == got.c_1_y == 0.0            # a flat feature cancels exactly
    assert np.isclose(got.c_0_0, (dm.x ** 2).sum(), rtol=1e-10) and np.isclose(got.c_0_y, (dm.x * dm.uplift).sum(), rtol=1e-10)


def test_campaign_models_of_every_key_match_numpy(spark):
    rng = np.random.default_rng(9)
    rows = [(m, f"c{i}", float(a), float(b), float(a + b), float(2 * a - b + e)) for m, n in (("wide", 3), ("tall", 30), ("single", 1))
            for i, (a, b, e) in enumerate(rng.normal(size=(n, 3)))]
    df = spark.createDataFrame(rows, "metric string, campaign_id string, a double, b double, c double, uplift_total double")
    got = ML.fit_campaign_level(df, ["a", "b", "c"], keys=("metric",)).toPandas()
    for m, g in df.toPandas().groupby("metric"):
        x, y = g[["a", "b", "c"]].to_numpy(), g["uplift_total"].to_numpy()
        w = np.linalg.pinv(x - x.mean(0)) @ (y - y.mean())
        own = got[got.metric == m].set_index("feature")["coef"]
        assert np.allclose(own[["a", "b", "c"]], w, atol=1e-8) and np.isclose(own["(intercept)"], y.mean() - x.mean(0) @ w)
    assert (got.groupby("metric")["coef"].diff().dropna() <= 0).all()


def test_cohort_panel_holds_one_node_a_level(spark):

    rows = [("b1", "Br", "Ca", None, 1, 2, 3, 4, 5, 6), ("b2", None, None, None, 1, 2, 3, 4, 5, 6)]
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], *r[4:]) for r in rows], "booking_number string, brand string, category string, subcategory string, "
                               + ", ".join(f"{c} long" for c in CO.TARGETS)).withColumn("week_start", F.to_date(F.lit("2001-01-03")))
    got = {(r.booking_number, r.level, r.metric): (r.node, float(r.y)) for r in CO.cohort_panel(df).collect()}
    assert len(got) == 6 * (4 + 1)
    assert got[("b1", "sku", "sales")] == ("sku=ALL", 1.0) and got[("b1", "brand_category", "new_to_brand_shoppers")] == ("brand=Br|cat=Ca", 6.0)
    assert ("b1", "subcategory", "sales") not in got and ("b2", "brand", "sales") not in got
