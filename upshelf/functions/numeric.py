"""Null-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a, b) -> Column:
    """a / nullif(b, 0); null instead of an error on zero (ANSI mode)."""
    return F.try_divide(_c(a), F.nullif(_c(b), F.lit(0)))


def clip_upper(x, hi: float = 1.0) -> Column:
    """clip above; null stays null (plain ``least`` would turn it into hi)."""
    x = _c(x)
    return F.when(x > hi, F.lit(hi)).otherwise(x)


def cap_child(child, parent) -> Column:
    """sign(child) * min(|child|, |parent|); a null parent leaves the child."""
    c, p = _c(child), _c(parent)
    m = F.least(F.abs(c), F.abs(p))
    return F.when(p.isNull(), c).otherwise(F.when(c < 0, -m).otherwise(m))


def smaller_abs(a, b) -> Column:
    """The value of smaller magnitude; ties take b (as the modelled app does)."""
    a, b = _c(a), _c(b)
    return F.when(F.abs(a) < F.abs(b), a).otherwise(b)


def weighted_mean(x, w) -> Column:
    """sum(coalesce(x,0) * w) / nullif(sum(w), 0): exact sums, divided as doubles (a quotient of decimals
    keeps six places)."""
    return safe_div(F.sum(F.coalesce(_c(x), F.lit(0)) * _c(w)).cast("double"), F.sum(_c(w)).cast("double"))
