"""Run parameters, one frozen dataclass passed through every stage."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # temporal train / test split on the basket mean time (reference default 2011-10-01)
    cut_date: _dt.date = _dt.date(2011, 10, 1)
    # lines of one customer and item that the cancellation match takes as one time bucket
    match_group_rows: int = 100_000
    # product clustering
    n_product_clusters: int = 5
    silhouette_floor: float = 0.145
    max_cluster_attempts: int = 5
    # report periods: None = last 30 days of data
    period: str | None = None
    # premium members are the top share of spenders
    premium_share: float = 0.2
    # test-period profile scale (count *= 5)
    test_count_scale: int = 5
    # model selection
    seed: int = 42
    train_fraction: float = 0.8
    n_folds: int = 5
    grid: str = "full"  # "full" = reference grids, "small" = a reduced grid
    # explanations
    explain_rows: int = 500
    background_rows: int = 200
    shap_sample_rows: int = 100
    # labels
    default_label: int = 7
    extra: dict = field(default_factory=dict, compare=False, hash=False)


# Cut date used on the driver's generated tables (their dates end in 2001).
DRIVER_CUT = _dt.date(2000, 10, 1)


def driver_params(**kw) -> Params:
    return Params(cut_date=DRIVER_CUT, **kw)
