"""Byte budgets: exact rounding, the largest parameter that fits, and checked plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from ..errors import IndistinguishableCostError, InvalidConfigError
from ..operators.base import Sketch

#: Distinct keys that a state is sized for.
PROBE_KEYS = 2_000


def largest_remainder(fractions: Sequence[float], total: int) -> list[int]:
    """Whole parts of ``total`` in these proportions that add up to it; ties go to the first."""
    f = np.asarray(fractions, np.float64)
    if not np.isfinite(f).all() or f.sum() <= 0:
        raise IndistinguishableCostError("fractions must be finite and have a positive sum", fractions=list(fractions))
    exact = f / f.sum() * total
    whole = np.floor(exact).astype(int)
    for i in np.argsort(-(exact - whole), kind="stable")[: total - int(whole.sum())]:
        whole[i] += 1
    return whole.tolist()


def fit_parameter(kind: type[Sketch], budget: int, keys: int = PROBE_KEYS) -> int:
    """The largest size parameter whose state fits the budget; the smallest allowed one if none does."""
    lo, hi = kind.axis_range
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if kind.size_bytes(mid, keys) <= budget:
            lo = mid
        else:
            hi = mid - 1
    return lo


@dataclass(frozen=True)
class BudgetPlan:
    alloc: dict[str, int]
    total_bytes: int
    strategy: str

    def __post_init__(self):
        if self.total_bytes <= 0 or any(v < 0 for v in self.alloc.values()) or sum(self.alloc.values()) > self.total_bytes:
            raise InvalidConfigError("a plan's parts must not be negative or exceed a positive total", alloc=self.alloc, total=self.total_bytes)
