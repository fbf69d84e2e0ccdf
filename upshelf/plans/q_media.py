"""Catalogue entries for D13-D18 (bookings from the driver's part/supplier tables)."""

from __future__ import annotations

from upshelf.operators import media as M
from upshelf.plans import inputs as I
from upshelf.plans import oracle as O
from upshelf.plans.catalog import register, tidy


def media(spark, sf_dir):
    return M.media_master(I.bookings(spark, sf_dir))


@register("media_master", O.with_(*O.MEDIA_CTES) + "SELECT * FROM media_master")
def q_media_master(spark, sf_dir):
    return tidy(media(spark, sf_dir))


@register("select_bookings", O.with_(*O.MEDIA_CTES) + "SELECT DISTINCT booking_number FROM media_master")
def q_select_bookings(spark, sf_dir):
    return M.select_bookings(media(spark, sf_dir), "all")


@register("select_bookings_window", O.with_(*O.MEDIA_CTES) + """SELECT DISTINCT booking_number FROM media_master
WHERE campaign_start_date >= DATE '1998-06-01' AND campaign_end_date <= DATE '1999-06-30'""")
def q_select_bookings_window(spark, sf_dir):
    return M.select_bookings(media(spark, sf_dir), "window", "1998-06-01", "1999-06-30")


@register("campaign_windows", O.with_(*O.SCOPE_CTES) + "SELECT * FROM bk_win")
def q_campaign_windows(spark, sf_dir):
    return tidy(M.campaign_windows(media(spark, sf_dir)))


@register("booking_skus", O.with_(*O.SCOPE_CTES) + "SELECT * FROM bk_skus")
def q_booking_skus(spark, sf_dir):
    return M.booking_skus(media(spark, sf_dir))


@register("campaign_windows_weeks", O.with_(*O.SCOPE_CTES) + f"""SELECT booking_number, media_start, media_end, train_end_raw, cutoff_week,
       first_week, last_week, {O.wed('(media_start - 728)')} AS min_d, max_d, all_stores, {O.wed('(media_start - 728)')} - 400 AS lookback_start FROM bk_win""")
def q_campaign_windows_weeks(spark, sf_dir):
    """The pull window of 104 weeks."""
    return tidy(M.campaign_windows(media(spark, sf_dir), pull="weeks"))


@register("booking_stores", O.with_(*O.SCOPE_CTES) + "SELECT * FROM bk_stores")
def q_booking_stores(spark, sf_dir):
    return M.booking_stores(media(spark, sf_dir))


_CAL = O.with_(*O.SCOPE_CTES, """cal_weeks AS (
  SELECT booking_number, all_stores, unnest(generate_series(first_week, last_week, INTERVAL 7 DAY))::DATE AS week_start
  FROM bk_win)""", """cal AS (
  SELECT w.booking_number, w.week_start, s.store_id, w.all_stores
  FROM cal_weeks w JOIN bk_stores s ON s.booking_number = w.booking_number WHERE NOT w.all_stores
  UNION ALL
  SELECT booking_number, week_start, CAST(NULL AS VARCHAR) AS store_id, all_stores FROM cal_weeks WHERE all_stores)""")


@register("store_calendar", _CAL + "SELECT * FROM cal")
def q_store_calendar(spark, sf_dir):
    m = media(spark, sf_dir)
    return M.store_calendar(m, M.campaign_windows(m))


@register("store_sets", _CAL + """SELECT booking_number, week_start,
       COALESCE(array_to_string(list_sort(list(store_id)), ','), '') AS stores,
       count(store_id) AS n_stores, bool_or(all_stores) AS all_stores
FROM cal GROUP BY booking_number, week_start""")
def q_store_sets(spark, sf_dir):
    m = media(spark, sf_dir)
    return M.store_sets(M.store_calendar(m, M.campaign_windows(m)))


@register("fleet_stores", O.with_(*O.BASE_CTES) + "SELECT DISTINCT store_id FROM base")
def q_fleet_stores(spark, sf_dir):
    return M.fleet_stores(I.weekly_base(spark, sf_dir))


@register("store_calendar_dynamic", O.with_(*O.SCOPE_CTES, """dyn AS (
  SELECT booking_number,
         unnest(generate_series(media_start_date - CAST((dayofweek(media_start_date) + 4) % 7 AS INTEGER),
                                media_end_date - CAST((dayofweek(media_end_date) + 4) % 7 AS INTEGER),
                                INTERVAL 7 DAY))::DATE AS week_start,
         list_filter(string_split(sorted_store_list, ','), lambda s: trim(s) <> '') AS st
  FROM media_master)""") + """SELECT DISTINCT booking_number, week_start, unnest(st) AS store_id, false AS all_stores
FROM dyn WHERE len(st) > 0
UNION
SELECT DISTINCT booking_number, week_start, CAST(NULL AS VARCHAR) AS store_id, true AS all_stores FROM dyn WHERE len(st) = 0""")
def q_store_calendar_dynamic(spark, sf_dir):
    m = media(spark, sf_dir)
    return M.store_calendar(m, M.campaign_windows(m), cohort="dynamic")
