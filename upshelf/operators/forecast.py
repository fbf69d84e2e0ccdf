"""Counterfactual forecasts.

One plan for all bookings × levels × nodes × weeks. Learners share one
contract: train on panel weeks before the booking's cutoff week, predict the
campaign weeks that have actuals (weeks without actuals are dropped, as the
modelled app does).

* ``mean``  : yhat = average training y (built-in aggregate; SQL-checkable);
* ``ridge`` : per-node ridge on calendar features + weekly regressors, from
  Gram sums (``groupBy.agg``) solved as array columns: JVM-side throughout,
  and no group of rows is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upshelf.functions.linalg import dot, gram_rows, solve_spd
from upshelf.functions.weeks import calendar_features
from upshelf.operators.nodes import REGRESSORS

COMPARE_COLS = ["booking_number", "level", "node", "ds", "y", "yhat", "uplift"]
CAL_FEATURES = ["month_sin", "month_cos", "woy_sin", "woy_cos"]


def _node_cols(panel: DataFrame) -> list[str]:
    """Level, node text and, where the panel carries it, the typed key."""
    return ["level", "node", *(["key"] if "key" in panel.columns else [])]


def _split(panel: DataFrame, windows: DataFrame, cutoff: str = "week"):
    """(training rows, campaign rows). ``cutoff="week"`` trains before the week of the first media day (decision 3);
    ``"raw"`` up to the day before it, which lets that week itself in unless it starts with the media."""
    end = {"week": "cutoff_week", "raw": "train_end_raw"}[cutoff]
    w = windows.select("booking_number", "min_d", F.col(end).alias("_end"), "first_week", "last_week")
    j = panel.join(w, "booking_number")
    before = F.col("week_start") < F.col("_end") if cutoff == "week" else F.col("week_start") <= F.col("_end")
    train = j.where((F.col("week_start") >= F.col("min_d")) & before)
    test = j.where(F.col("week_start").between(F.col("first_week"), F.col("last_week")))
    return train, test


def micro(x):
    """Round a double to 6 decimals by one fixed IEEE recipe (floor(x·1e6 + ½)/1e6)
    and return it as an exact decimal, so every engine gets the same value."""
    return (F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).cast("decimal(38,6)")


def counterfactual_mean(panel: DataFrame, windows: DataFrame, keys: tuple[str, ...] = (), cutoff: str = "week") -> DataFrame:
    """D24 with the ``mean`` learner, D25 uplift = y - yhat.

    yhat is the training mean in micro-units (exact decimal); uplift is then
    exact, so totals and caps do not depend on summation order."""
    train, test = _split(panel, windows, cutoff)
    g = ["booking_number", *keys, *_node_cols(panel)]
    yhat = train.groupBy(*g).agg(micro(F.sum("y").cast("double") / F.count("y")).alias("yhat"))
    return (test.join(yhat, g, "left")
            .select(*g, F.col("week_start").alias("ds"), "y", "yhat", (F.col("y") - F.col("yhat")).alias("uplift")))


def _is_constant(mean: Column, sd: Column) -> Column:
    """A feature whose spread is floating-point noise: it is left unscaled."""
    return sd <= 1e-9 * F.greatest(F.lit(1.0), F.abs(mean))


def fit_node_ridge(train: DataFrame, keys: list[str], features: list[str], alpha: float) -> DataFrame:
    """(keys, ybar, mu, sd, w): ridge of ``y`` on standardised features per key.

    Two aggregations on the same key: means and spreads first, then the Gram
    sums of the centred and scaled features, so nothing cancels."""
    p = len(features)
    stats = train.groupBy(*keys).agg(
        F.avg("y").alias("ybar"), F.array(*[F.avg(f) for f in features]).alias("mu"),
        F.array(*[F.when(_is_constant(F.avg(f), F.stddev_pop(f)), F.lit(1.0)).otherwise(F.stddev_pop(f)) for f in features]).alias("sd"))
    z = train.join(stats, keys).select(*keys, (F.col("y") - F.col("ybar")).alias("_y"),
                                       *[((F.col(f) - F.col("mu")[i]) / F.col("sd")[i]).alias(f"_z{i}") for i, f in enumerate(features)])
    sums = z.groupBy(*keys).agg(
        *[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"_s{i}_{j}") for i in range(p) for j in range(i, p)],
        *[F.sum(F.col(f"_z{i}") * F.col("_y")).alias(f"_t{i}") for i in range(p)])
    rows = gram_rows(p, lambda i, j: F.col(f"_s{i}_{j}"), lambda i: F.col(f"_t{i}"), alpha)
    return stats.join(sums.select(*keys, solve_spd(rows, p).alias("w")), keys)


def counterfactual_ridge(panel: DataFrame, windows: DataFrame, regressors: DataFrame | None = None,
                         alpha: float = 1.0, exog: str = "actual", keys: tuple[str, ...] = (),
                         features: list[str] | None = None) -> DataFrame:
    """D24 with a per-node ridge learner.

    ``features`` defaults to the cyclic calendar plus all weekly regressors,
    where given (null counts as 0). ``exog="actual"`` uses the observed
    regressors of the predicted week (decision 2); ``"zero"`` sets them to 0
    at prediction time for parity. Nodes without a training week keep their
    actuals with a null yhat. ``keys`` are further panel keys (``metric``)."""
    feats = features or [*CAL_FEATURES, *(REGRESSORS if regressors is not None else [])]
    if regressors is not None:
        panel = panel.join(regressors, ["booking_number", "week_start"], "left")
    names = ["year", "woy", "dow", "month_sin", "month_cos", "woy_sin", "woy_cos"]
    cal = dict(zip(names, calendar_features("week_start")))
    g = ["booking_number", *keys, *_node_cols(panel)]

    def rows(df: DataFrame, zero: bool) -> DataFrame:
        of = [cal[f] if f in CAL_FEATURES else F.lit(0.0) if zero else F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in feats]
        return df.select(*g, "week_start", F.col("y").cast("double").alias("y"), *[c.alias(f) for c, f in zip(of, feats)])

    train, test = _split(panel, windows)
    model = fit_node_ridge(rows(train, False), g, feats, alpha)
    x = F.array(*[(F.col(f) - F.col("mu")[i]) / F.col("sd")[i] for i, f in enumerate(feats)])
    yhat = F.col("ybar") + dot(x, F.col("w"))
    return (rows(test, exog == "zero").join(model, g, "left")
            .select(*g, F.col("week_start").alias("ds"), "y", yhat.alias("yhat"), (F.col("y") - yhat).alias("uplift")))


def counterfactual_gbt(panel: DataFrame, windows: DataFrame, regressors: DataFrame | None = None, max_iter: int = 20,
                       max_depth: int = 5, seed: int = 42) -> DataFrame:
    """D24 with a pooled gradient-boosted-trees learner (MLlib, distributed).

    One model over every booking, level and node: features are the node's
    training mean (target encoding), the level, the cyclic calendar and the
    observed weekly regressors (null as 0); the label is y. Training rows are the pre-cutoff weeks of every node; the
    campaign weeks are predicted. (The modelled app fits one boosted model
    per series; pooling keeps this one distributed job instead of millions of
    tiny fits.)"""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    more = REGRESSORS if regressors is not None else []
    if regressors is not None:
        panel = panel.join(regressors, ["booking_number", "week_start"], "left")
    train, test = _split(panel, windows)
    g = ["booking_number", *_node_cols(panel)]
    nm = train.groupBy(*g).agg(F.avg(F.col("y").cast("double")).alias("node_mean"))
    names = ["year", "woy", "dow", "month_sin", "month_cos", "woy_sin", "woy_cos"]

    def feats(df):
        cal = dict(zip(names, calendar_features("week_start")))
        return df.join(nm, g).select(*g, "week_start", F.col("y").cast("double").alias("label"), "node_mean",
                                     *[cal[c] for c in CAL_FEATURES],
                                     *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in more])

    tr, te = feats(train), feats(test)
    # nodes without any training week keep their actuals with a null yhat
    orphans = test.join(nm, g, "left_anti").select(*g, F.col("week_start").alias("ds"),
                                                   F.col("y").cast("double").alias("y"),
                                                   F.lit(None).cast("double").alias("yhat"),
                                                   F.lit(None).cast("double").alias("uplift"))
    pipe = Pipeline(stages=[
        StringIndexer(inputCol="level", outputCol="level_idx", handleInvalid="keep"),
        VectorAssembler(inputCols=["node_mean", "level_idx", *CAL_FEATURES, *more], outputCol="features"),
        GBTRegressor(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=max_depth, seed=seed)])
    model = pipe.fit(tr)
    pred = model.transform(te)
    return pred.select(*g, F.col("week_start").alias("ds"), F.col("label").alias("y"),
                       F.col("prediction").alias("yhat"),
                       (F.col("label") - F.col("prediction")).alias("uplift")).unionByName(orphans)
