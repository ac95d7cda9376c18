"""The shared core: counts of the k keys of smallest hash, which answer distinct counts and frequencies.

Whether a key is kept depends on its hash alone, so one aggregation and a bounded sort give exactly what an
incremental summary holds, in any order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import derive, hashed
from ..sources.stream import Stream
from .base import CARDINALITY, FREQUENCY, Query, Sketch, register
from .cardinality import from_smallest, smallest

#: Nominal bytes of an entry: key, hash and count.
ENTRY_BYTES = 24


def shared_seed(seed: int) -> int:
    return derive(seed, "core:shared")


@register
class BottomK(Sketch):
    name, query_types, mergeable = "bottom_k", (CARDINALITY, FREQUENCY), True
    axis, axis_range, default = "k", (16, 8192), 1024

    def state(self, s: Stream) -> DataFrame:
        counts = s.keys().groupBy(*s.by, "key").agg(F.count("*").alias("count"))
        return smallest(hashed(counts, "key", shared_seed(self.seed), "h"), self.size, s.by)

    def combine(self, state: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return smallest(state.groupBy(*by, "key", "h").agg(F.sum("count").alias("count")), self.size, by)

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        if query.kind == CARDINALITY:
            return from_smallest(state, self.size, by)
        hit = F.coalesce(F.max(F.when(F.col("key") == query.key, F.col("count"))), F.lit(0)).alias("value")
        return state.groupBy(*by).agg(hit) if by else state.agg(hit)

    def lookup(self, state: DataFrame, keys: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """Counts of the keys in ``keys``; 0 for those that are not kept."""
        held = state if by else F.broadcast(state)  # k rows; with groups, k for each
        return keys.join(held, [*by, "key"], "left").select(*by, "key", F.coalesce("count", F.lit(0)).alias("value"))

    @classmethod
    def size_bytes(cls, size: int, keys: int) -> int:
        return ENTRY_BYTES * size

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("entries", 2, ENTRY_BYTES * size)]
