"""List columns: clean and flexible parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quoted items inside a bracketed list: 'x' or "x".
_QUOTED = r"""'([^']+)'|"([^"]+)\""""


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strip_ws(x: Column) -> Column:
    # Python str.strip() also removes tabs/newlines; Spark trim() only blanks.
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_ids(arr) -> Column:
    """Trim, drop null / blank / 'nan', de-duplicate keeping first-seen order."""
    a = F.transform(_c(arr), lambda v: F.trim(v))
    a = F.filter(a, lambda v: v.isNotNull() & (v != "") & (F.lower(v) != "nan"))
    return F.array_distinct(a)


def parse_list(x) -> Column:
    """parse list-like text into array<string>.

    Accepts blank/null (empty list), bracketed quoted lists ``['a', "b"]``,
    bracketed bare lists ``[a, b]``, comma lists and blank-separated lists.
    """
    s = _strip_ws(_c(x))
    is_bracketed = s.startswith("[") & s.endswith("]")
    inner = F.regexp_replace(s, r"^\[(.*)\]$", "$1")
    quoted = F.regexp_extract_all(inner, F.lit(_QUOTED), 0)
    quoted_items = F.transform(quoted, lambda v: _strip_ws(F.substring(v, 2, F.length(v) - 2)))
    base = F.when(is_bracketed, inner).otherwise(s)
    parts = F.when(base.contains(","), F.split(base, ",")).otherwise(F.split(_strip_ws(base), r"\s+"))
    bare_items = F.transform(parts, lambda v: F.regexp_replace(_strip_ws(v), r"""^['"]+|['"]+$""", ""))
    out = (F.when(s.isNull() | (s == ""), F.array().cast("array<string>"))
           .when(is_bracketed & (F.size(quoted) > 0), quoted_items)
           .otherwise(bare_items))
    return F.filter(out, lambda v: v != "")


def sorted_distinct_text(arr, sep: str = ",") -> Column:
    """A17 + F19: ordered distinct array joined to text (text order)."""
    return F.array_join(F.array_sort(F.array_distinct(_c(arr))), sep)


def coerce_id(x) -> Column:
    """Strip; numeric text loses leading zeros, other text is kept."""
    s = F.trim(_c(x))
    n = s.try_cast("long") if hasattr(s, "try_cast") else F.expr("try_cast(NULL as long)")
    return F.coalesce(n.cast("string"), s)
