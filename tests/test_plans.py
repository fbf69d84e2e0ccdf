"""Plan hygiene for every registered query: no cartesian product and no
nested-loop join (all joins are equi-joins), and fact scans read only the
columns they use."""

import os

import pytest

import __spark_entry__ as E

SF = os.environ.get("UPSHELF_TEST_SF", "/root/testdata/sf0.001")
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(E.queries()))
def test_no_cartesian_or_nested_loop(spark, key):
    plan = _plan(E.queries()[key](spark, SF))
    for op in FORBIDDEN:
        assert op not in plan, f"{key}: {op} in plan"


def test_fact_scan_is_pruned(spark):
    plan = _plan(E.queries()["weekly_base"](spark, SF))
    # lineitem is read for 8 of its 11 columns at most; quantity and status are never read
    assert "l_quantity" not in plan and "l_linestatus" not in plan


def test_written_tables_have_no_cartesian_or_nested_loop(spark, monkeypatch):
    """The plans of the tables that campaign queries write and read back, not only of their last step."""
    from upshelf.plans import inputs, pipeline
    from upshelf.plans.params import DEFAULT
    seen = {}

    def checked(session, df_fn, name, key=(), **kw):
        def build():
            df = df_fn()
            seen[name] = _plan(df)
            return df
        return materialise(session, build, name, key, **kw)

    materialise = pipeline.materialise
    monkeypatch.setattr(pipeline, "materialise", checked)
    monkeypatch.setattr(inputs, "materialise", checked)
    c = pipeline.campaigns(spark, SF, DEFAULT.with_(extra={"plans": 1}))
    for rows in (c.panel_full(), c.cohort_week_totals(), c.regressors(), c.hypothesis("sku"), c.depth_cohort(), c.compare_dynamic(), c.universe("narrow")):
        assert rows is not None
    assert {"weekly_base", "media_master", "plane_regex", "scoped_wide", "slice_agg_wide", "panel_full", "cohort_week_totals", "depth_store_sums"} <= set(seen)
    for name, plan in seen.items():
        for op in FORBIDDEN:
            assert op not in plan, f"{name}: {op} in plan"


def test_base_partitions_are_pruned_by_the_windows(spark):
    from upshelf.plans import pipeline
    c = pipeline.campaigns(spark, SF)
    plan = _plan(c.slice_rows())
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x and "weekly_base" in x)
    filters = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "week_start" in filters and "subquery" in filters.lower()
    lo, hi = c.windows.selectExpr("min(min_d)", "max(max_d)").first()
    weeks = {r[0] for r in c.window_base.select("week_start").distinct().collect()}
    assert weeks == {r[0] for r in c.base.select("week_start").distinct().collect() if lo <= r[0] <= hi}
    assert c.base.where("week_start < date'1900-01-01'").count() == 0


def test_rewritten_inputs_give_new_tables(spark, tmp_path):
    from upshelf.sources.sinks import input_version
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    one = input_version(spark, str(tmp_path))
    assert one == input_version(spark, str(tmp_path))
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert one != input_version(spark, str(tmp_path))
