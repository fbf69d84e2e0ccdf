"""Week anchors and calendar arithmetic.

Weeks start on Wednesday everywhere (the warehouse convention). The pandas
``W-WED`` period convention, whose weeks start on Thursday, is available as
``anchor="THU"`` for parity checks only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark dayofweek: 1 = Sunday ... 7 = Saturday.
_ANCHOR_OFFSET = {"WED": 3, "THU": 2}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def week_start(d, anchor: str = "WED") -> Column:
    """floor a date to the first day of its week."""
    d = _c(d)
    off = _ANCHOR_OFFSET[anchor]
    return F.date_sub(d, (F.dayofweek(d) + off) % 7)


def week_range(a, b, anchor: str = "WED") -> Column:
    """inclusive list of week starts from week(a) to week(b), 7-day step.

    Empty when b's week is before a's (``sequence`` would raise)."""
    wa, wb = week_start(a, anchor), week_start(b, anchor)
    return F.when(wb >= wa, F.sequence(wa, wb, F.expr("INTERVAL 7 DAYS"))).otherwise(
        F.array().cast("array<date>"))


def month_diff(a, b) -> Column:
    """calendar-month boundaries crossed from b to a (BigQuery DATE_DIFF MONTH)."""
    a, b = _c(a), _c(b)
    return (F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))


def sunday_floor(d) -> Column:
    d = _c(d)
    return F.date_sub(d, F.dayofweek(d) - 1)


def week_diff_sunday(a, b) -> Column:
    """Sunday-based week boundaries crossed from b to a (DATE_DIFF WEEK)."""
    return (F.datediff(sunday_floor(a), sunday_floor(b)) / 7).cast("long")


def calendar_features(ds) -> list[Column]:
    """Year, ISO week, weekday (Mon=0), cyclic month / week-of-year."""
    ds = _c(ds)
    two_pi = 2 * math.pi
    return [
        F.year(ds).alias("year"),
        F.weekofyear(ds).alias("woy"),
        F.weekday(ds).alias("dow"),
        F.sin(two_pi * F.month(ds) / 12).alias("month_sin"),
        F.cos(two_pi * F.month(ds) / 12).alias("month_cos"),
        F.sin(two_pi * F.weekofyear(ds) / 52).alias("woy_sin"),
        F.cos(two_pi * F.weekofyear(ds) / 52).alias("woy_cos"),
    ]
