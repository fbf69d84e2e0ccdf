"""Assembly of the campaign pipeline from the driver tables (used by the
catalogue and the bench).

The weekly base and the campaign tables are written once per run under the
checkpoint folder and read back (``materialise``): later stages then plan
against plain scans, lineage is cut, and a lost executor only recomputes
from the last written table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upshelf.operators import cohort as CO
from upshelf.operators import customers as CU
from upshelf.operators import dynamic as DY
from upshelf.operators import exposure as EX
from upshelf.operators import forecast as FC
from upshelf.operators import insights as IN
from upshelf.operators import market as MK
from upshelf.operators import media as M
from upshelf.operators import nodes as N
from upshelf.operators import reconcile as R
from upshelf.operators import scope as S
from upshelf.plans import inputs as I
from upshelf.plans.params import DEFAULT, Params
from upshelf.sources.sinks import input_version, materialise


@dataclass
class Campaigns:
    spark: SparkSession
    sf_dir: str
    p: Params = DEFAULT
    version: str = ""
    _memo: dict = field(default_factory=dict)

    def _m(self, name: str, fn, **kw) -> DataFrame:
        if name not in self._memo:
            self._memo[name] = materialise(self.spark, fn, name, (self.sf_dir, self.version, repr(self.p)), **kw)
        return self._memo[name]

    @property
    def base(self) -> DataFrame:
        return I.weekly_base(self.spark, self.sf_dir, self.p)

    @property
    def window_base(self) -> DataFrame:
        """The base from the first to the last week of any booking's window: the two bounds are scalars of the plan
        and prune the base's week partitions before a file is opened."""
        lo, hi = self.windows.select(F.min("min_d")).scalar(), self.windows.select(F.max("max_d")).scalar()
        return self.base.where(F.col("week_start").between(lo, hi))

    @property
    def media(self) -> DataFrame:
        return self._m("media_master", lambda: M.media_master(I.bookings(self.spark, self.sf_dir), self.p))

    # Booking-level tables are read many times in one plan: written, each of
    # these reads is a scan, and plans stay small on the driver.
    @property
    def skus(self) -> DataFrame:
        return self._m("booking_skus", lambda: M.booking_skus(self.media))

    @property
    def stores(self) -> DataFrame:
        return self._m("booking_stores", lambda: M.booking_stores(self.media))

    @property
    def windows(self) -> DataFrame:
        return self._m("campaign_windows", lambda: M.campaign_windows(self.media, self.p))

    @property
    def promo(self) -> DataFrame:
        return self._m("promotions", lambda: I.promo(self.spark, self.sf_dir))

    @property
    def promo_dim(self) -> DataFrame:
        return self._m("promo_dim", lambda: S.promo_dim(self.window_base, self.skus, self.windows))

    def universe(self, mode: str = "wide") -> DataFrame:
        return self._m(f"universe_{mode}",
                       lambda: S.sku_universe(self.window_base, self.skus, self.windows, mode, self.promo_dim, self.dim))

    def candidates(self, mode: str = "wide") -> DataFrame:
        return self._m(f"candidates_{mode}", lambda: S.candidates(self.skus, self.promo_dim, self.dim, mode))

    def slice_rows(self, mode: str = "wide") -> DataFrame:
        """Store-grain slice rows (lazy; used where stores matter)."""
        return S.slice_rows(self.window_base, self.candidates(mode), self.windows, self.stores)

    def slice_agg(self, mode: str = "wide") -> DataFrame:
        """The slice summed to (booking, week, article hierarchy): store detail
        is dropped before anything is written."""
        return self._m(f"slice_agg_{mode}", lambda: N.slice_article_week(self.slice_rows(mode)))

    def registry(self) -> DataFrame:
        return self._m("registry", lambda: N.node_registry(self.skus, self.promo_dim))

    def panel(self, target: str = "sales") -> DataFrame:
        if self.p.panel_plan == "levels":
            return self._m(f"panel_{target}_levels", lambda: N.weekly_panel_direct(
                self.base, self.registry(), self.windows, self.stores, target, self.candidates()))
        return self._m(f"panel_{target}", lambda: N.weekly_panel(self.slice_agg(), self.registry(), target))

    def regressors(self) -> DataFrame:
        """Sales-weighted regressors per (booking, week) over the slice."""
        return self._m("regressors", self.weekly_regressors)

    def preflight(self) -> DataFrame:
        return S.preflight(self.window_base, self.skus, self.windows, self.stores, EX.asset_counts(self.media, self.dim))

    def weekly_regressors(self, weighting: str = "sales") -> DataFrame:
        rows = self.slice_rows()
        means = N.weekly_regressors(rows, weighting, self.p)
        most = CO.weekly_internal_discount(rows, self.promo, weighting)
        return means.join(most, ["booking_number", "week_start"]).select("booking_number", "week_start", *N.REGRESSORS)

    def compare(self) -> DataFrame:
        return FC.counterfactual_mean(self.panel(), self.windows)

    def compare_dynamic(self) -> DataFrame:
        """D24 over dynamic cohorts (each week's own treated stores)."""
        sig, members = DY.week_cohorts(self.media, self.windows)
        panel = self._m("panel_dynamic", lambda: DY.dynamic_panel(
            self.window_base, self.candidates(), self.windows, sig, members, self.registry()))
        return DY.counterfactual_dynamic(panel, self.windows, sig)

    def plane(self, validator: str = "regex") -> DataFrame:
        """Customer lines with the previous purchase days of every key: computed once, before bookings fan out."""
        keys = {"days": tuple(CU.KEYS)} if validator == "regex" else {"days": (), "weeks": ("sku", "brand_subcat")}
        return self._m(f"plane_{validator}", lambda: CU.customer_plane(
            self.lines(validator), once=lambda name, x: self._m(f"customer_{name}_{validator}", lambda: x), **keys), bucket_by=["article_id", "salt"])

    def scoped_lines(self, mode: str = "wide") -> DataFrame:
        """Lines of each booking's universe, window and cohort; all customer metrics of the slices and panels read them."""
        return self._m(f"scoped_{mode}", lambda: CU.scoped_lines(self.plane(), self.candidates(mode), self.windows, self.stores))

    def panel_full(self) -> DataFrame:
        """D29 panel: ten metrics per (booking, level, node, week)."""
        return self._m("panel_full", lambda: N.long_panel(
            self.panel(), N.customer_panel(self.scoped_lines(), self.registry(), self.p)))

    def compare_full(self) -> DataFrame:
        return self._m("compare_full", lambda: FC.counterfactual_mean(self.panel_full(), self.windows, keys=("metric",)))

    def grid(self) -> DataFrame:
        return R.uplift_grid(R.cap_hierarchy(R.uplift_totals(self.compare())))

    # ---- slices ---------------------------------------------------------
    def lines(self, validator: str = "regex") -> DataFrame:
        """Eligible customer lines, all stores: the global lookback history."""
        return CU.customer_lines(I.tx(self.spark, self.sf_dir), self.p, validator)

    def cohort_week_totals(self) -> DataFrame:
        return self._m("cohort_week_totals", lambda: CO.cohort_week_totals(
            self.window_base, self.promo, self.plane("cast"), self.skus, self.windows, self.stores,
            self.p))

    def cohort_panel(self) -> DataFrame:
        """Six metrics x six levels of the cohort-week totals, for forecasts of whole cohorts."""
        return CO.cohort_panel(self.cohort_week_totals())

    def compare_cohort(self) -> DataFrame:
        return FC.counterfactual_mean(self.cohort_panel(), self.windows, keys=("metric",))

    def exog_cohort_week(self) -> DataFrame:
        return CO.exog_cohort_week(CO.base_cohort(self.window_base, self.skus, self.windows, self.stores), self.p)

    def scoped_slice(self, variant: str = "lag") -> DataFrame:
        return CO.scoped_slice(self.window_base, self.promo, self.scoped_lines(), self.candidates(),
                               self.windows, self.stores, variant, self.p, once=lambda name, x: self._m(f"slice_{name}", x))

    # ---- insights -------------------------------------------------------
    @property
    def dim(self) -> DataFrame:
        return self._m("product_dim", lambda: S.product_dim(self.base))

    def exposure_calendar(self, weights: DataFrame | None = None) -> DataFrame:
        return self._m("exposure_calendar", lambda: EX.exposure_calendar(
            self.media, self.dim, EX.fleet_size(self.base), weights, self.p))

    def exposure_doses(self, weights: DataFrame | None = None) -> DataFrame:
        return self._m("exposure_doses", lambda: EX.exposure_doses(
            self.media, self.dim, EX.fleet_size(self.base), weights, self.p))

    def share(self) -> DataFrame:
        return self._m("preperiod_share", lambda: MK.preperiod_share(self.base, self.windows, self.p))

    def sov(self) -> DataFrame:
        return self._m("sov_esov", lambda: EX.sov_esov(self.exposure_calendar(), self.share()))

    def exposure_by_grain(self, grain: str) -> DataFrame:
        return EX.exposure_by_grain(self.sov(), self.promo_dim, grain, self.exposure_doses())

    def depth(self, grain: str) -> DataFrame:
        """All six grains come from one written table, that is one pass over the base."""
        return MK.discount_depth(self._m("depth_sums", lambda: MK.depth_sums(self.base, self.p)), grain, self.p)

    def depth_cohort(self) -> DataFrame:
        sums = self._m("depth_store_sums", lambda: MK.depth_sums(self.base, self.p, by=("store_id",)))
        return MK.discount_depth_cohort(sums, self.windows, self.stores, self.p)

    def share_cohort(self) -> DataFrame:
        return MK.preperiod_share(self.base, self.windows, self.p, self.stores)

    def hypothesis_full(self, grain: str) -> DataFrame:
        """D37 for every metric: hypothesis rows with a ``metric`` column."""
        return self._m(f"hypothesis_full_{grain}", lambda: IN.hypothesis_table(
            self.compare_full(), self.exposure_by_grain(grain), self.depth(grain), grain))

    def hypothesis(self, grain: str) -> DataFrame:
        return self._m(f"hypothesis_{grain}", lambda: IN.hypothesis_table(
            self.compare(), self.exposure_by_grain(grain), self.depth(grain), grain))


_CACHE: dict = {}


def campaigns(spark: SparkSession, sf_dir: str, p: Params = DEFAULT) -> Campaigns:
    version = input_version(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, version, repr(p))
    if key not in _CACHE:
        _CACHE[key] = Campaigns(spark, sf_dir, p, version)
    return _CACHE[key]
