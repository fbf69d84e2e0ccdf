"""The set-based campaign plan equals a per-booking loop: running
the operators on one booking's media at a time gives the same panel and
counterfactual as running them on all bookings at once."""

import os

from pyspark.sql import functions as F

from upshelf.operators import forecast as FC
from upshelf.operators import media as M
from upshelf.operators import nodes as N
from upshelf.operators import scope as S
from upshelf.plans import inputs as I
from upshelf.sources.sinks import materialise

SF = os.environ.get("UPSHELF_TEST_SF", "/root/testdata/sf0.001")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _run(base, media):
    skus, stores, windows = M.booking_skus(media), M.booking_stores(media), M.campaign_windows(media)
    promo_dim = S.promo_dim(base, skus, windows)
    cand = S.candidates(skus, promo_dim, S.product_dim(base))
    panel = N.weekly_panel(N.slice_article_week(S.slice_rows(base, cand, windows, stores)),
                           N.node_registry(skus, promo_dim))
    return panel, FC.counterfactual_mean(panel, windows)


def test_set_based_equals_per_booking_loop(spark):
    base = I.weekly_base(spark, SF)
    media = materialise(spark, lambda: M.media_master(I.bookings(spark, SF)), "test_media", (SF,))
    all_panel, all_cmp = _run(base, media)
    full_p, full_c = _rows(all_panel), _rows(all_cmp)
    ids = sorted({r[0] for r in full_c})[:2]
    assert ids
    for b in ids:
        p, c = _run(base, media.where(F.col("booking_number") == b))
        assert _rows(p) == [r for r in full_p if r[0] == b], b
        assert _rows(c) == [r for r in full_c if r[0] == b], b


def test_panel_plans_agree(spark):
    from upshelf.plans.params import DEFAULT
    from upshelf.plans.pipeline import campaigns
    a = _rows(campaigns(spark, SF).panel())
    b = _rows(campaigns(spark, SF, DEFAULT.with_(panel_plan="levels")).panel())
    assert a == b and len(a) > 0
