"""The budgeted system: one plan, three modules, four families of answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..operators import exact, folds
from ..operators.base import CARDINALITY, FREQUENCY, HEAVY_HITTERS, QUANTILE, Query, Sketch
from ..operators.bottom_k import ENTRY_BYTES, BottomK, shared_seed
from ..operators.heavy_hitters import SpaceSavingTop
from ..operators.quantile import CentroidDigest
from ..sources.stream import Stream
from .allocate import MODULE_OF, Context, Laws, Strategy
from .budget import fit_parameter
from .score import cardinality_loss, frequency_loss, gate_score, heavy_hitter_loss, quantile_loss


def core_size(budget: int) -> int:
    lo, hi = BottomK.axis_range
    return max(lo, min(hi, budget // ENTRY_BYTES))


class BudgetedSystem:
    """Modules sized by a strategy's plan, over a Spark stream. States are made once and kept by the caller's persist."""

    def __init__(self, budget: int, strategy: Strategy, laws: Laws, context: Context | None = None, *, seed: int = 0, quantile: type[Sketch] = CentroidDigest, heavy: type[Sketch] = SpaceSavingTop):
        self.context = context or Context()
        self.plan = strategy.allocate(laws, budget, self.context)
        self.modules: dict[str, Sketch] = {
            "shared": BottomK(core_size(self.plan["shared"]), seed=seed),
            "quantile": quantile(fit_parameter(quantile, self.plan["quantile"]), seed=seed),
            "heavy": heavy(fit_parameter(heavy, self.plan["heavy"]), seed=seed),
        }

    def states(self, s: Stream) -> dict[str, DataFrame]:
        return {name: m.state(s) for name, m in self.modules.items()}

    def estimate(self, states: dict[str, DataFrame] | Stream, query: Query, by: tuple[str, ...] = ()) -> DataFrame:
        module = MODULE_OF[query.kind]
        if isinstance(states, Stream):
            return self.modules[module].estimate(states, query)
        return self.modules[module].estimate(states[module], query, by)

    def size_bytes(self, keys: int) -> int:
        return sum(m.size_bytes(m.size, keys) for m in self.modules.values())

    def losses(self, s: Stream, top_k: int = 10, q: float = 0.5) -> dict[str, float]:
        """Losses against the exact answers; a handful of single rows come to the driver."""
        states, ask = self.states(s), lambda d: d.first().value
        heaviest = exact.top_k(s, 1).first().key
        found = {r.key for r in self.estimate(states, Query(HEAVY_HITTERS, top_k=top_k)).collect()}
        estimate = ask(self.estimate(states, Query(QUANTILE, q=q)))
        return {
            CARDINALITY: cardinality_loss(ask(self.estimate(states, Query(CARDINALITY))), ask(exact.cardinality(s))),
            FREQUENCY: frequency_loss(ask(self.estimate(states, Query(FREQUENCY, key=heaviest))), ask(exact.frequency(s, heaviest))),
            QUANTILE: quantile_loss(ask(exact.rank(s, estimate)), q),
            HEAVY_HITTERS: heavy_hitter_loss(found, {r.key for r in exact.top_k(s, top_k).collect()}),
        }

    def score(self, s: Stream) -> float:
        return gate_score(self.losses(s))


class Truth:
    """Exact answers about arrays, for cells of an experiment that fit one task."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.counts = np.unique(keys, return_counts=True)
        self.values = np.sort(values)
        order = np.lexsort((self.keys, -self.counts))
        self.top = list(zip(self.keys[order[:10]].tolist(), self.counts[order[:10]].tolist(), strict=True))

    def rank(self, v: float) -> float:
        return float(np.searchsorted(self.values, v, "right")) / len(self.values)


def local_losses(plan: dict[str, int], keys: np.ndarray, values: np.ndarray, truth: Truth, seed: int) -> dict[str, float]:
    """Losses of a plan's modules over arrays, by the folds as they are written."""
    core = folds.BottomK(core_size(plan["shared"]), shared_seed(seed))
    digest = folds.ClosestPairDigest(1 << fit_parameter(CentroidDigest, plan["quantile"]))
    heavy = folds.SpaceSaving(1 << fit_parameter(SpaceSavingTop, plan["heavy"]), as_written=True)
    core.add(keys)
    digest.add(values)
    heavy.add(keys)
    key, count = truth.top[0]
    return {
        CARDINALITY: cardinality_loss(core.cardinality(), len(truth.keys)),
        FREQUENCY: frequency_loss(core.frequency(key), count),
        QUANTILE: quantile_loss(truth.rank(digest.quantile(0.5)), 0.5),
        HEAVY_HITTERS: heavy_hitter_loss({k for k, _ in heavy.top(10)}, {k for k, _ in truth.top}),
    }


