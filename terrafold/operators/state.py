"""The parameters of a query over places."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class QueryState:
    """None means no constraint. district may be "main" for the main districts; located is all, yes or no."""

    district: str | None = None
    kind: str = "school"
    query: str = ""
    year: str = "2026"
    admission: str = "all"
    school_id: str | None = None
    official_only: bool = False
    candidate_only: bool = False
    favorite_only: bool = False
    located: str = "all"
    primary_only: bool = True
    min_budget: float | None = None
    max_budget: float | None = None
    min_area: float | None = None
    max_area: float | None = None
    built_after: int | None = None
    price_kind: str = "deal"
    include_unknown: bool = False
    deal_from: str | None = None
    deal_to: str | None = None
    fresh_only: bool = False
    bounds: tuple[float, float, float, float] | None = None
    rectangle: tuple[float, float, float, float] | None = None
    today: str | None = None
    context_homes: bool = True
    markers: str = "all"
    labels: str = "all"
    favorites: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name, lo, hi in (("budget", self.min_budget, self.max_budget), ("area", self.min_area, self.max_area), ("deal date", self.deal_from, self.deal_to)):
            if lo is not None and hi is not None and lo > hi:
                warnings.warn(f"the {name} range is empty: {lo} to {hi}", stacklevel=3)

    def but(self, **changes) -> "QueryState":
        return replace(self, **changes)

    @property
    def price_active(self) -> bool:
        return any(x is not None for x in (self.min_budget, self.max_budget, self.min_area, self.max_area, self.deal_from, self.deal_to)) or self.fresh_only

    @property
    def housing_active(self) -> bool:
        return self.price_active or self.candidate_only or self.built_after is not None
