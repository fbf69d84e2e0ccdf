"""Learners and models: same compare keys across learners; Gram-sum ridge and
OLS equal the closed forms computed directly on the collected table."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from upshelf.operators import cohort as CO
from upshelf.operators import forecast as FC
from upshelf.operators import insights as IN
from upshelf.operators import models as ML
from upshelf.operators import nodes as NODES
from upshelf.plans import inputs as I
from upshelf.plans import q_scope
from upshelf.plans.pipeline import campaigns

SF = os.environ.get("UPSHELF_TEST_SF", "/root/testdata/sf0.01")


def test_learners_share_compare_keys(spark):
    c = campaigns(spark, SF)
    keys = ["booking_number", "level", "node", "ds"]
    mean = c.compare().select(*keys)
    ridge = FC.counterfactual_ridge(c.panel(), c.windows)
    assert mean.exceptAll(ridge.select(*keys)).count() == 0
    assert ridge.select(*keys).exceptAll(mean).count() == 0
    bad = ridge.where(F.col("yhat").isNotNull() & (F.abs("yhat") > 1e12)).count()
    assert bad == 0


def test_within_campaign_ridge_matches_closed_form(spark):
    c = campaigns(spark, SF)
    h = c.hypothesis("brand_category")
    feats = ML.WEEKLY_BASE
    coefs = {r.feature: r.coef for r in ML.fit_weekly_within_campaign(h, feats, alpha=10.0).collect()}
    pdf = h.toPandas()
    pdf["uplift"] = pdf["uplift"].astype(float)
    pdf = pdf[pdf["uplift"].notna()]
    pdf = pdf[pdf.groupby("campaign_id")["week_start"].transform("nunique") >= 2].copy()
    woy = pd.to_datetime(pdf["week_start"]).dt.isocalendar().week.astype(int)
    pdf["woy_sin"], pdf["woy_cos"] = np.sin(2 * np.pi * woy / 52.0), np.cos(2 * np.pi * woy / 52.0)
    X = pdf[feats].fillna(0.0).astype(float)
    X = (X - X.groupby(pdf["campaign_id"]).transform("mean")).to_numpy()
    y = (pdf["uplift"] - pdf.groupby("campaign_id")["uplift"].transform("mean")).to_numpy(float)
    mu, sd = X.mean(0), X.std(0)
    sd[sd <= 1e-9 * np.maximum(1.0, np.sqrt((X ** 2).mean(0)))] = 1.0
    Z = (X - mu) / sd
    w = np.linalg.solve(Z.T @ Z + 10.0 * np.eye(len(feats)), Z.T @ y)
    got = np.array([coefs[f] for f in feats])
    assert np.allclose(got, w, rtol=1e-6, atol=1e-6 * max(1.0, np.abs(w).max()))


def test_campaign_ols_matches_lstsq(spark):
    c = campaigns(spark, SF)
    agg = IN.campaign_aggregate(c.hypothesis("brand_category"))
    feats = ML.CAMPAIGN_BASE
    co = {r.feature: r.coef for r in ML.fit_campaign_level(agg, feats).collect()}
    pdf = agg.toPandas()
    pdf = pdf[pdf["uplift_total"].notna()]
    X = pdf[feats].fillna(0.0).to_numpy(float)
    y = pdf["uplift_total"].to_numpy(float)
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.pinv(Xc) @ yc
    pred_ref = Xc @ w
    pred = Xc @ np.array([co[f] for f in feats])
    assert np.allclose(pred, pred_ref, rtol=1e-6, atol=1e-3)


def test_regressors_reach_the_learners(spark):
    sf = "/root/testdata/sf0.001"
    c = campaigns(spark, sf)
    got = c.regressors().toPandas().set_index(["booking_number", "week_start"]).sort_index().astype(float)
    ic = CO.internal_features_by_booking(c.slice_rows(), I.promo(spark, sf)).toPandas()
    rows = c.slice_rows().toPandas()
    k = ["booking_number", "week_start", "store_id", "brand", "category"]
    rows = rows.merge(ic[[*k, "max_internal_competitor_discount_percent"]], on=k, how="left")
    want = {}
    for key, x in rows.groupby(["booking_number", "week_start"]):
        s = x["sales"].astype(float)
        of = [(x[r].astype(float).fillna(0) * s).sum() / s.sum() for r in NODES.NUMERIC_REGRESSORS]
        of += [s[x["brochure"] == "Not on brochure"].sum() / s.sum(), s[x["multibuy"] == "Not on Multibuy"].sum() / s.sum()]
        want[key] = of
    assert len(want) == len(got) and got["max_internal_competitor_discount_percent"].abs().sum() > 0
    assert np.allclose(got[NODES.REGRESSORS].to_numpy(), np.array([want[key] for key in got.index]), rtol=1e-9, atol=1e-9, equal_nan=True)
    keys = ["booking_number", "level", "node", "ds"]
    for query, plain in ((q_scope.q_counterfactual_ridge, FC.counterfactual_ridge), (q_scope.q_counterfactual_gbt, FC.counterfactual_gbt)):
        full = query(spark, sf).toPandas().sort_values(keys)
        bare = plain(c.panel(), c.windows).toPandas().sort_values(keys)
        assert (full[keys].to_numpy() == bare[keys].to_numpy()).all()
        assert not np.allclose(full["yhat"].astype(float), bare["yhat"].astype(float), equal_nan=True)
