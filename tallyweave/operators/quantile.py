"""Quantiles under a size bound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hashed, unsigned_order
from ..sources.stream import Stream, grouped
from . import folds
from .base import QUANTILE, Query, Sketch, register
from .exact import check_q
from .ordered import by_partition, in_order, merge_parts, numbered

_CENTROIDS = "mean double, weight double"


def _interpolated(kept: DataFrame, q: float, by: tuple[str, ...]) -> DataFrame:
    return grouped(kept, by, F.coalesce(F.percentile("value", check_q(q)), F.lit(0.0)).alias("value"))


@register
class ReservoirQuantile(Sketch):
    """A uniform sample of k values: those whose arrival has the smallest hash, so samples merge and reruns agree.

    ``as_written`` folds the values in order with replacement by a seeded generator instead.
    """

    name, query_types, deterministic, mergeable, order_free = "reservoir_quantile", (QUANTILE,), False, True, False
    axis, axis_range, default = "k", (16, 8192), 1024

    def __init__(self, size: int | None = None, *, seed: int = 0, as_written: bool = False):
        super().__init__(size, seed=seed)
        self.as_written = as_written

    def state(self, s: Stream) -> DataFrame:
        if self.as_written:
            k, seed = self.size, self.derived("reservoir")
            return in_order(s.values(), "value", s.by, lambda: folds.Reservoir(k, seed), lambda f: [(x,) for x in f.sample], "value double")
        return self.combine(hashed(s.values(), "seq", self.derived("reservoir"), "h").select(*s.by, "h", "value"), s.by)

    def combine(self, state: DataFrame, by: tuple[str, ...]) -> DataFrame:
        order = [unsigned_order("h"), F.col("value")]
        if not by:
            return state.orderBy(*order).limit(self.size)
        return state.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= self.size).drop("_n")

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        return _interpolated(state, query.q, by)

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("sample", 1, 8 * min(size, keys))]


def _with_running_extremes(values: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``lo`` and ``hi``: the extremes up to each row in the order of ``seq``.

    A group's rows fall into as many ranges of ``seq`` as there are shuffle partitions, so no task reads them all; a
    range's extremes are one row.
    """
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = values.agg(F.percentile_approx("seq", [i / n for i in range(1, n)], 1_000)).first()[0] if n > 1 else None
    range_of = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("seq"))) if cuts else F.lit(0)
    ranged = values.withColumn("_range", range_of)
    ends = ranged.groupBy(*by, "_range").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*(F.col(c).alias(f"_e_{c}") for c in (*by, "_range")), F.min("a").over(before).alias("_lo"), F.max("b").over(before).alias("_hi"))
    met = ranged.join(ends, [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in (*by, "_range")])
    within = Window.partitionBy(*by, "_range").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return met.withColumns({"lo": F.least(F.min("value").over(within), "_lo"), "hi": F.greatest(F.max("value").over(within), "_hi")}).select(*values.columns, "lo", "hi")


@register
class EqualWidthHistogram(Sketch):
    """Counts in equal bins between the smallest and the largest value; answers with the middle of a bin.

    Two passes bin every value by the final range, as plain aggregations at any scale. ``as_written`` bins
    each value by the range at its arrival and never again; values that come while the range is empty are in
    no bin. That needs running extremes: windows over ranges of ``seq``, with the extremes of the ranges before.
    """

    name, query_types, mergeable, order_free = "equal_width_histogram", (QUANTILE,), True, False
    axis, axis_range, default = "bins", (8, 4096), 256

    def __init__(self, size: int | None = None, *, seed: int = 0, as_written: bool = False):
        super().__init__(size, seed=seed)
        self.as_written = as_written

    def state(self, s: Stream) -> DataFrame:
        values, bins = s.values(), F.lit(self.size)
        if self.as_written:
            ranged = _with_running_extremes(values, s.by)
        else:
            ends = grouped(values, s.by, F.min("value").alias("lo"), F.max("value").alias("hi"))
            # One row a group, which may be many; without groups, one row.
            ranged = values.join(ends, list(s.by)) if s.by else values.crossJoin(F.broadcast(ends))
        at = F.least(F.greatest(((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int"), F.lit(0)), bins - 1)
        return ranged.withColumn("bin", F.when(F.col("hi") > F.col("lo"), at)).groupBy(*s.by, "bin").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))

    def combine(self, state: DataFrame, by: tuple[str, ...]) -> DataFrame:
        """Counts go to the bins of the range of all parts by the middles of their own bins: off by one part's bin at most."""
        group = Window.partitionBy(*(by or [F.lit(0)]))  # at most ``bins`` rows a part
        middle = F.when(F.col("bin").isNull(), F.col("lo")).otherwise(F.col("lo") + (F.col("bin") + 0.5) * ((F.col("hi") - F.col("lo")) / self.size))
        wide = state.withColumns({"middle": middle, "a": F.min("lo").over(group), "b": F.max("hi").over(group)})
        at = F.least(F.greatest(((F.col("middle") - F.col("a")) / ((F.col("b") - F.col("a")) / self.size)).cast("int"), F.lit(0)), F.lit(self.size - 1))
        return wide.withColumn("bin", F.when(F.col("b") > F.col("a"), at)).groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.min("a").alias("lo"), F.max("b").alias("hi"))

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        group = Window.partitionBy(*(by or [F.lit(0)]))  # at most ``bins`` rows a group
        whole = state.withColumns({"total": F.sum("n").over(group), "a": F.min("lo").over(group), "b": F.max("hi").over(group)})
        reached = F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))).over(group.orderBy(F.col("bin").asc_nulls_first()))
        target = F.lit(check_q(query.q)) * (F.col("total") - 1)
        width = (F.col("b") - F.col("a")) / F.lit(self.size)
        first = F.min(F.when(F.col("reached") > target, F.col("bin")))
        found = grouped(whole.withColumn("reached", reached), by, F.min("a").alias("a"), F.min("b").alias("b"), first.alias("bin"), F.min(width).alias("width"))
        middle = F.col("a") + F.coalesce("bin", F.lit(self.size - 1)) * F.col("width") + F.col("width") * 0.5
        return found.select(*by, F.when(F.col("a").isNull(), F.lit(0.0)).when(F.col("b") <= F.col("a"), F.col("a")).otherwise(middle).alias("value"))

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("counts", 1, 8 * size), ("range", 1, 16)]


@register
class ExactPrefix(Sketch):
    """The exact quantile of the first ``capacity`` values to arrive."""

    name, query_types, order_free = "exact_prefix", (QUANTILE,), False
    axis, axis_range, default = "capacity", (64, 500_000), 4096

    def state(self, s: Stream) -> DataFrame:
        if not s.by:
            return s.values().orderBy("seq").limit(self.size).select("value")
        return s.values().withColumn("_n", F.row_number().over(Window.partitionBy(*s.by).orderBy("seq"))).where(F.col("_n") <= self.size).select(*s.by, "value")

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        return _interpolated(state, query.q, by)

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("values", 1, 8 * min(size, keys))]


@register
class CentroidDigest(Sketch):
    """At most 2**delta_exp centroids, small ones at the ends, by the merging digest with the arc-sine scale.

    Each partition makes its own centroids, which are then merged. ``as_written`` is one fold in order whose closest
    neighbours become one when there are too many.
    """

    name, query_types, mergeable, order_free = "centroid_digest", (QUANTILE,), True, False
    axis, axis_range, default = "delta_exp", (3, 12), 8

    def __init__(self, size: int | None = None, *, seed: int = 0, as_written: bool = False):
        super().__init__(size, seed=seed)
        self.as_written = as_written

    def state(self, s: Stream) -> DataFrame:
        most = 1 << self.size
        if self.as_written:
            return in_order(s.values(), "value", s.by, lambda: folds.ClosestPairDigest(most), lambda f: list(zip(f.means, f.weights, strict=True)), _CENTROIDS)
        return by_partition(s.values(), "value", s.by, lambda: folds.ScaledDigest(most), lambda f: f.rows(), _merge_digests(most), _CENTROIDS)

    def union(self, states: list[DataFrame]) -> DataFrame:
        return numbered(states)

    def combine(self, state: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return merge_parts(state, by, _merge_digests(1 << self.size), _CENTROIDS).drop("_part")

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        group = Window.partitionBy(*(by or [F.lit(0)]))  # at most 2**delta_exp rows a group
        reached = state.withColumns({"r": F.sum("weight").over(group.orderBy("mean")), "total": F.sum("weight").over(group)})
        return grouped(reached, by, F.coalesce(F.min(F.when(F.col("r") >= F.lit(check_q(query.q)) * F.col("total"), F.col("mean"))), F.max("mean"), F.lit(0.0)).alias("value"))

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("centroids", 2, 16 * min(1 << size, keys))]


def _merge_digests(most: int):
    def merged(parts: list[list[tuple]]) -> list[tuple]:
        one = folds.ScaledDigest(most)
        for part in parts:
            one.waiting.append(tuple(np.array(c) for c in zip(*part, strict=True)))
        return one.rows()

    return merged


@register
class NativeKll(Sketch):
    """Spark's built-in KLL sketch; its draws are random, so answers vary within its rank error."""

    name, query_types, tier, deterministic, mergeable = "native_kll", (QUANTILE,), 0, False, True
    axis, axis_range, default = "k", (8, 2048), 200

    def state(self, s: Stream) -> DataFrame:
        return grouped(s.values(), s.by, F.kll_sketch_agg_double("value", F.lit(self.size)).alias("sketch"))

    def combine(self, state: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return grouped(state, by, F.kll_merge_agg_double("sketch", F.lit(self.size)).alias("sketch"))

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        return state.select(*by, F.kll_sketch_get_quantile_double("sketch", F.lit(check_q(query.q))).alias("value"))

    def declared_error(self) -> float:
        """Normalised rank error that the sketch family declares for one quantile: a fitted power of k."""
        return 2.296 / self.size**0.9723

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("sketch", 1, 8 * min(3 * size, keys) + 20)]


@register
class NativePercentile(Sketch):
    """k + 1 evenly spaced quantiles by Spark's percentile_approx; an answer is the nearest one. It stands where a
    relative-error quantile sketch would, which Spark lacks."""

    name, query_types, tier = "native_percentile", (QUANTILE,), 0
    axis, axis_range, default = "k", (4, 10_000), 100

    def state(self, s: Stream) -> DataFrame:
        marks = F.array(*(F.lit(i / self.size) for i in range(self.size + 1)))
        return grouped(s.values(), s.by, F.percentile_approx("value", marks, 10 * self.size).alias("marks"))

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        return state.select(*by, F.element_at("marks", round(check_q(query.q) * self.size) + 1).alias("value"))

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("marks", 1, 8 * (size + 1))]
