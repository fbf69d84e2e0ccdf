"""Customers: valid ids (P5, P6), shoppers (D4) and the "new-to" metrics.

Three definitions exist and are kept apart:

* ``lag``   (D5/D6/D9): a purchase day is new if the customer's previous purchase
  day of the key inside the lookback is missing or at least ``new_to_months``
  calendar-month boundaries back;
* ``first`` (D7): only the first purchase day inside [lookback start, max] is new;
* ``week``  (D8): as ``lag`` on distinct purchase weeks.

Physical plan: one *global* plane of distinct (customer, key, day) with the
previous day from a ``lag`` window. Because groups are distinct days, every
window partition is bounded by the number of calendar days, whatever the
skew of a customer or key. Campaign windows only move the lookback start, so
per-campaign flags are a column expression on the same plane
(``prev if prev >= lookback_start``); no per-campaign window is run.

Campaign queries read the *customer plane*: customer lines with the previous
purchase days of all keys, attached once, before any booking fans the lines
out, and written in buckets by article (``sources.sinks.materialise``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upshelf.functions.weeks import month_diff, week_start
from upshelf.plans.params import DEFAULT, Params

# Output grains used by the slice variants.
SKU_GRAIN = ["week_start", "store_id", "product_number", "article_id", "brand", "category", "subcategory"]
KEYS = {
    "sku": ["product_number"],
    "brand": ["brand"],
    "brand_subcat": ["brand", "subcategory"],
    "category": ["category"],
    "subcategory": ["subcategory"],
}


def valid_customer_regex(raw) -> Column:
    """P5: trimmed text of at least three digits, else null."""
    t = F.trim(F.col(raw) if isinstance(raw, str) else raw)
    return F.when(t.rlike(r"^[0-9]{3,}$"), t)


def valid_customer_cast(raw) -> Column:
    """Castable to an integer and at least three characters (untrimmed), then trimmed."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.when(c.try_cast("long").isNotNull() & (F.length(c) >= 3), F.trim(c))


def customer_lines(tx: DataFrame, p: Params = DEFAULT, validator: str = "regex") -> DataFrame:
    """P1 + P5/P6: eligible sale lines with ``d``, ``week_start`` and ``customer_id``."""
    v = valid_customer_regex("customer_raw") if validator == "regex" else valid_customer_cast("customer_raw")
    return (tx.where((F.col("sales_org") == p.sales_org) & (F.col("sales_amount") > 0)
                     & (F.lower("channel") == p.channel))
            .select(F.col("txn_date").alias("d"), week_start("txn_date").alias("week_start"),
                    "store_id", "price_family", "product_number", "article_id", "brand", "category",
                    "subcategory", v.alias("customer_id"), "sales_amount"))


def global_window(lines: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Attach the open window of the modelled app's defaults (no campaign)."""
    return lines.select("*", F.lit(p.min_date).alias("min_d"), F.lit(p.max_date).alias("max_d"),
                        F.date_sub(F.lit(p.min_date), p.lookback_days).alias("lookback_start"))


def purchase_days(lines: DataFrame, key: list[str]) -> DataFrame:
    """W1 plane: distinct (customer, key, day) with the previous purchase day."""
    w = Window.partitionBy("customer_id", *key).orderBy("d")
    return (lines.where(F.col("customer_id").isNotNull()).select("customer_id", *key, "d").distinct()
            .select("customer_id", *key, "d", F.lag("d").over(w).alias("prev_d")))


def purchase_weeks(lines: DataFrame, key: list[str]) -> DataFrame:
    """W2 plane: distinct (customer, key, week) with the previous purchase week
    and the last purchase day of that previous week (to test it against a
    lookback start that falls inside a week)."""
    w = Window.partitionBy("customer_id", *key).orderBy("week_start")
    return (lines.where(F.col("customer_id").isNotNull())
            .groupBy("customer_id", *key, "week_start").agg(F.max("d").alias("last_d"))
            .select("customer_id", *key, "week_start",
                    F.lag("week_start").over(w).alias("prev_week"),
                    F.lag("last_d").over(w).alias("prev_last_d")))


#: Buckets of a hot article: the plane's bucket key is (article_id, salt).
SALTS = 8


def customer_days(lines: DataFrame) -> DataFrame:
    """Lines of valid customers summed to one row per customer, day, store and article."""
    return (lines.where(F.col("customer_id").isNotNull())
            .groupBy("customer_id", "d", *SKU_GRAIN, "price_family").agg(F.sum("sales_amount").alias("sales_amount")))


def customer_plane(lines: DataFrame, days: tuple[str, ...] = tuple(KEYS), weeks: tuple[str, ...] = (), once=None) -> DataFrame:
    """The rows of ``customer_days`` with ``prev_<key>`` (previous purchase day) for every key
    of ``days`` and ``prevw_<key>`` / ``prevl_<key>`` (previous purchase week and its last day)
    for those of ``weeks``.

    ``once(name, table)``, if given, writes a table: the rows, as every key reads them, each key's days or weeks, and the
    rows with them. Every key deals out all rows, so a plan of all keys would hold that many copies on disk at a time.

    A day or week is on the join keys, so a customer or key that holds a third
    of all rows spreads over its days. Rows whose key is null have no previous
    day. ``salt`` spreads an article over the plane's buckets."""
    once = once or (lambda name, table: table)
    out = x = once("days", customer_days(lines))
    keys = [(k, "day") for k in days] + [(k, "week") for k in weeks]
    for k, unit in keys:
        if unit == "day":
            plane, at = purchase_days(x, KEYS[k]).withColumnRenamed("prev_d", f"prev_{k}"), "d"
        else:
            plane, at = purchase_weeks(x, KEYS[k]).withColumnRenamed("prev_week", f"prevw_{k}").withColumnRenamed("prev_last_d", f"prevl_{k}"), "week_start"
        out = once(f"with_{unit}_{k}", out.join(once(f"{unit}_{k}", plane), ["customer_id", *KEYS[k], at], "left"))
    return out.withColumn("salt", F.pmod(F.xxhash64("customer_id"), F.lit(SALTS)).cast("int"))


def _in_lookback(prev: Column, lookback_start: Column) -> Column:
    return F.when(prev >= lookback_start, prev)


def flag_days(wlines: DataFrame, key_name: str, grain: list[str], mode: str, p: Params = DEFAULT,
              history: DataFrame | None = None) -> DataFrame:
    """Lines of the window (columns min_d, max_d, lookback_start present),
    pre-aggregated to (grain, customer, day) and flagged new or not.

    ``history``: the lines the lookback reads (all stores, all campaigns,
    once); defaults to ``wlines`` for the campaign-free form. Lines of the
    customer plane bring the previous day along and join nothing."""
    key, own = KEYS[key_name], f"prev_{key_name}"
    extra = [c for c in ["booking_number"] if c in wlines.columns and c not in grain]
    cols = list(dict.fromkeys(extra + grain + key + ["min_d", "max_d", "lookback_start"]))
    known = [F.min(own).alias("prev_d")] if own in wlines.columns else []
    j = (wlines.where(F.col("customer_id").isNotNull() & F.col("d").between(F.col("min_d"), F.col("max_d")))
         .groupBy(*cols, "customer_id", "d").agg(F.sum("sales_amount").alias("amount"), *known))
    if not known:
        src = wlines if history is None else history
        j = j.join(purchase_days(src.select("customer_id", *key, "d"), key), ["customer_id", *key, "d"], "left")
    prev = _in_lookback(F.col("prev_d"), F.col("lookback_start"))
    if mode == "lag":
        new = prev.isNull() | (month_diff(F.col("d"), prev) >= p.new_to_months)
    elif mode == "first":
        new = prev.isNull()
    else:
        raise ValueError(mode)
    return j.select(*cols, "customer_id", "d", "amount", new.alias("is_new"))


def new_to(lines_w: DataFrame, key_name: str, grain: list[str], mode: str = "lag",
           prefix: str | None = None, p: Params = DEFAULT, history: DataFrame | None = None) -> DataFrame:
    """New-to-key shoppers and sales at ``grain``.

    ``lines_w`` are customer lines with window columns attached (see
    ``global_window``); groups are those with at least one valid customer."""
    prefix = prefix or f"new_to_{key_name}"
    f = flag_days(lines_w, key_name, grain, mode, p, history)
    extra = [c for c in ["booking_number"] if c in f.columns and c not in grain]
    return (f.groupBy(*extra, *grain).agg(
        F.count_distinct(F.when(F.col("is_new"), F.col("customer_id"))).alias(f"{prefix}_shoppers_13m"),
        F.sum(F.when(F.col("is_new"), F.col("amount")).otherwise(F.lit(0))).alias(f"{prefix}_sales_13m")))


def shoppers(lines_w: DataFrame, grain: list[str], name: str = "shoppers") -> DataFrame:
    """Exact distinct valid customers per grain inside the window."""
    extra = [c for c in ["booking_number"] if c in lines_w.columns and c not in grain]
    return (lines_w.where(F.col("customer_id").isNotNull() & F.col("d").between(F.col("min_d"), F.col("max_d")))
            .groupBy(*extra, *grain).agg(F.count_distinct("customer_id").alias(name)))


def new_to_week(lines_w: DataFrame, key_name: str, grain: list[str], cohort: DataFrame | None = None,
                prefix: str | None = None, p: Params = DEFAULT, history: DataFrame | None = None) -> DataFrame:
    """Weekly new-to flags on distinct customer-weeks; spend is the whole
    customer-week spend on the key inside the cohort (store-scoped) lines.

    ``lines_w``: history lines with window columns (all stores). ``cohort``:
    the store-scoped lines of the window (defaults to ``lines_w``). The pair key
    is carried in the join, so several pairs cannot duplicate spend."""
    key = KEYS[key_name]
    prefix = prefix or f"new_to_{key_name}"
    cohort = lines_w if cohort is None else cohort
    extra = [c for c in ["booking_number"] if c in cohort.columns and c not in grain]
    known = [F.min(f"prevw_{key_name}").alias("prev_week"), F.min(f"prevl_{key_name}").alias("prev_last_d")] if f"prevw_{key_name}" in cohort.columns else []
    j = (cohort.where(F.col("customer_id").isNotNull() & F.col("d").between(F.col("min_d"), F.col("max_d")))
         .groupBy(*dict.fromkeys(extra + grain + key + ["lookback_start", "customer_id", "week_start"]))
         .agg(F.sum("sales_amount").alias("amount"), *known))
    if not known:
        src = lines_w if history is None else history
        j = j.join(purchase_weeks(src.select("customer_id", *key, "d", "week_start"), key), ["customer_id", *key, "week_start"], "left")
    prev = F.when(F.col("prev_last_d") >= F.col("lookback_start"), F.col("prev_week"))
    new = prev.isNull() | (month_diff(F.col("week_start"), prev) >= p.new_to_months)
    return (j.withColumn("is_new", new).groupBy(*extra, *grain).agg(
        F.count_distinct(F.when(F.col("is_new"), F.col("customer_id"))).alias(f"{prefix}_shoppers_13m"),
        F.sum(F.when(F.col("is_new"), F.col("amount")).otherwise(F.lit(0))).alias(f"{prefix}_sales_13m")))


def scoped_lines(lines: DataFrame, articles: DataFrame, windows: DataFrame, stores: DataFrame | None) -> DataFrame:
    """Campaign lines: articles of each booking (``articles``: booking,
    article_id), inside [min_d, max_d], in the cohort stores (``stores`` None
    keeps all stores), with the booking's window columns attached. Lines of
    the customer plane keep their previous purchase days."""
    from upshelf.operators.scope import cohort_filter
    w = windows.select("booking_number", "min_d", "max_d", "lookback_start")
    on = ["article_id"]
    if "salt" in lines.columns:                 # the plane's bucket key: the articles, not the lines, are dealt out
        on, articles = ["article_id", "salt"], articles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    j = (lines.join(articles, on).drop("salt").join(w, "booking_number")
         .where(F.col("d").between(F.col("min_d"), F.col("max_d"))))
    return j if stores is None else cohort_filter(j, windows, stores)
