"""Parameters of training and serving, each with an environment variable of its upper-case name."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    svd_factors: int = 64
    knn_top_k: int = 50
    knn_shrink: float = 10.0
    recency_halflife_days: float = 30.0
    eval_top_k: tuple[int, ...] = (5, 10, 20)
    eval_holdout_per_user: int = 5
    tuning_val_size: int = 2
    #: None: all users with validation items, which one job covers; a number: that many by a seeded hash.
    tuning_max_users: int | None = None
    tuning_seed: int = 7
    tuning_coverage_weight: float = 0.05
    default_top_k: int = 10
    max_top_k: int = 100

    @classmethod
    def from_env(cls) -> Settings:
        found = {}
        for f in fields(cls):
            text = os.environ.get(f.name.upper())
            if text is not None:
                found[f.name] = tuple(map(int, text.split(","))) if f.name == "eval_top_k" else int(text) if f.default is None else type(f.default)(text)
        return cls(**found)
