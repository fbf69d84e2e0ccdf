"""Query catalogue: one entry per operator, each reading the driver tables.

Every entry is ``fn(spark, sf_dir) -> DataFrame`` and (where SQL can express
it) has DuckDB oracle SQL with the same column names. Money is summed as
decimal and cast to double last; computed ratios are rounded to 6 places on
both sides so value hashes compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def tidy(df: DataFrame, rounded: tuple[str, ...] | list[str] = (), digits: int = 6) -> DataFrame:
    """Output hygiene: decimals -> double, small ints -> bigint, arrays -> text,
    listed columns rounded."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        if f.name in rounded:
            c = F.round(c.cast("double"), digits) + F.lit(0.0)   # also turns -0.0 into 0.0
        cols.append(c.alias(f.name))
    return df.select(*cols)


_loaded = False


def _load() -> None:
    global _loaded
    if not _loaded:
        _loaded = True
        from upshelf.plans import q_base  # noqa: F401  (registers entries)
        for mod in ("q_customers", "q_media", "q_scope", "q_slices", "q_insights", "q_primitives"):
            try:
                __import__(f"upshelf.plans.{mod}")
            except ModuleNotFoundError as e:
                if e.name != f"upshelf.plans.{mod}":
                    raise
