"""Small keys for primitive families no composite covers (§2.2-2.8):
label mode (A21), flexible list parsing (F20), week arithmetic (F1-F5),
one-hot labels (F28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from upshelf.functions import lists as L
from upshelf.functions import weeks as Wk
from upshelf.operators import nodes as N
from upshelf.plans import inputs as I
from upshelf.plans import oracle as O
from upshelf.plans.catalog import register, tidy
from upshelf.plans.params import DEFAULT


@register("label_mode_brochure", O.with_(*O.BASE_CTES) + f""", lm AS (
  SELECT week_start, brochure, count(*) AS n FROM base WHERE brochure IS NOT NULL GROUP BY week_start, brochure),
lm_r AS (SELECT *, row_number() OVER (PARTITION BY week_start ORDER BY n DESC, brochure ASC) AS rk FROM lm)
SELECT w.week_start, COALESCE(r.brochure, '{DEFAULT.no_brochure_label}') AS brochure
FROM (SELECT DISTINCT week_start FROM base) w LEFT JOIN lm_r r ON r.week_start = w.week_start AND r.rk = 1""")
def q_label_mode(spark, sf_dir):
    return N.label_mode(I.weekly_base(spark, sf_dir), ["week_start"], "brochure", DEFAULT.no_brochure_label)


@register("list_parse", O.with_(O.FX_BOOKINGS) + """, lp AS (
  SELECT booking_number, media_type, store_list,
         list_filter(list_transform(string_split(trim(store_list), ','), lambda v: trim(trim(v), '''"')),
                     lambda v: v <> '') AS items
  FROM fx_bookings)
SELECT booking_number, media_type, len(items) AS n_items, items[1] AS first_item, items[len(items)] AS last_item,
       array_to_string(items, ',') = store_list AS roundtrip
FROM lp""")
def q_list_parse(spark, sf_dir):
    b = I.bookings(spark, sf_dir).select("booking_number", "media_type", "store_list",
                                         L.parse_list("store_list").alias("items"))
    return tidy(b.select("booking_number", "media_type", F.size("items").alias("n_items"),
                         F.get("items", 0).alias("first_item"),
                         F.get("items", F.size("items") - 1).alias("last_item"),
                         (F.array_join("items", ",") == F.col("store_list")).alias("roundtrip")))


_ANCHOR = "DATE '1998-01-07'"


@register("week_funcs", O.with_(O.FX_TX) + f"""
SELECT txn_date, {O.wed('txn_date')} AS week_wed,
       (txn_date - CAST((dayofweek(txn_date) + 3) % 7 AS INTEGER)) AS week_thu,
       CAST(({O.sun('txn_date')} - {O.sun(_ANCHOR)}) / 7 AS BIGINT) AS weeks_since_anchor,
       {O.month_diff('txn_date', _ANCHOR)} AS months_since_anchor,
       CAST(txn_date - 400 AS DATE) AS lookback_start, CAST(txn_date - INTERVAL 13 MONTH AS DATE) AS minus_13_months,
       weekofyear(txn_date) AS iso_week
FROM (SELECT DISTINCT txn_date FROM fx_tx) t""")
def q_week_funcs(spark, sf_dir):
    d = I.tx(spark, sf_dir).select("txn_date").distinct()
    anchor = F.lit("1998-01-07").cast("date")
    return d.select("txn_date", Wk.week_start("txn_date").alias("week_wed"),
                    Wk.week_start("txn_date", "THU").alias("week_thu"),
                    Wk.week_diff_sunday("txn_date", anchor).alias("weeks_since_anchor"),
                    Wk.month_diff("txn_date", anchor).cast("long").alias("months_since_anchor"),
                    F.date_sub("txn_date", 400).alias("lookback_start"),
                    F.add_months("txn_date", -13).alias("minus_13_months"),
                    F.weekofyear("txn_date").cast("long").alias("iso_week"))
