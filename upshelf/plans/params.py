"""Default parameters (names follow the modelled app; values are its defaults
except the two dates, which the fixture mapping fixes so results repeat)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Params:
    as_of: dt.date = dt.date(2001, 12, 1)            # replaces "today" so runs repeat
    min_campaign_start: dt.date = dt.date(1998, 1, 1)
    sales_org: str = "S1"                            # kept sales organisation
    channel: str = "in store"                        # kept channel (lower-cased)
    history_years: int = 3
    lookback_days: int = 400
    new_to_months: int = 13
    pull_lookback_weeks: int = 104
    pad_weeks: int = 2
    pull_lookback_months: int = 13
    preperiod_weeks: int = 13
    ridge_alpha: float = 10.0
    min_weeks: int = 2
    weight_eps: float = 1e-9
    discount_threshold: float = 1.5
    default_type_weight: float = 1.0
    top_k: int = 5
    no_brochure_label: str = "Not on brochure"
    no_multibuy_label: str = "Not on Multibuy"
    min_date: dt.date = dt.date(1900, 1, 1)          # open window defaults
    max_date: dt.date = dt.date(2100, 1, 1)
    # Node-panel plan: "slice" joins article-level rows of each booking's universe
    # (faster when stores carry few articles per week, as in the test data);
    # "levels" sums the base to each level's grain first (far fewer replicated
    # rows when many articles share a node, as in full-size retail data).
    panel_plan: str = "slice"
    extra: dict = field(default_factory=dict)

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()
