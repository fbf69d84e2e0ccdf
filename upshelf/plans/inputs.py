"""Inputs shared by catalogue entries: the four logical tables from the
driver tables, plus the weekly base built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from upshelf.operators import base as B
from upshelf.plans.params import DEFAULT, Params
from upshelf.sources import fixtures as fx
from upshelf.sources.sinks import input_version, materialise


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.transactions(spark, sf_dir)


def comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.competitor_prices(spark, sf_dir)


def promo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.promotions(spark, sf_dir)


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.bookings(spark, sf_dir)


def weekly_base(spark: SparkSession, sf_dir: str, p: Params = DEFAULT) -> DataFrame:
    """The weekly base, written once per session and input as a table partitioned by
    week and sorted by product and store (the modelled app keeps it as a precomputed table too)."""
    return materialise(spark, lambda: B.weekly_base(tx(spark, sf_dir), comp(spark, sf_dir), promo(spark, sf_dir), p),
                       "weekly_base", (sf_dir, input_version(spark, sf_dir), repr(p)), partition_by=["week_start"],
                       range_by=["week_start", "product_number", "store_id"])


def weekly_base_lazy(spark: SparkSession, sf_dir: str, p: Params = DEFAULT) -> DataFrame:
    return B.weekly_base(tx(spark, sf_dir), comp(spark, sf_dir), promo(spark, sf_dir), p)
