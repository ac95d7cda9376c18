"""Distinct counts: all four are order-free aggregations over hashes made inside generated code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bit_length, hashed, unsigned_order, unsigned_value
from ..sources.stream import Stream, grouped
from .base import CARDINALITY, Query, Sketch, register


@register
class HyperLogLog(Sketch):
    """2**p registers of the longest run of leading zeros; small counts by empty registers."""

    name, query_types, mergeable = "hyper_log_log", (CARDINALITY,), True
    axis, axis_range, default = "p", (4, 18), 12

    def state(self, s: Stream) -> DataFrame:
        p = self.size
        h = hashed(s.keys(), "key", self.derived("hll"), "h")
        rows = h.select(*s.by, F.col("h").bitwiseAND(F.lit((1 << p) - 1).cast("long")).cast("int").alias("idx"), (F.lit(64 - p + 1) - bit_length(F.shiftrightunsigned("h", p))).alias("rho"))
        return self.combine(rows, s.by)

    def combine(self, state: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return state.groupBy(*by, "idx").agg(F.max("rho").alias("rho"))

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        m = float(1 << self.size)
        alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(int(m), 0.7213 / (1 + 1.079 / m))
        sums = grouped(state, by, F.count("*").alias("used"), F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rho"))), F.lit(0.0)).alias("mass"))
        zeros = F.lit(m) - F.col("used")
        raw = F.lit(alpha * m * m) / (zeros + F.col("mass"))
        value = F.when((raw < 2.5 * m) & (zeros > 0), F.lit(m) * F.log(F.lit(m) / zeros)).otherwise(raw)
        return sums.select(*by, value.alias("value"))

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("registers", 1, 1 << size)]


def smallest(hashes: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    """The rows of the k smallest unsigned hashes ``h``; with ``by``, of each group."""
    if not by:
        return hashes.orderBy(unsigned_order("h")).limit(k)
    return hashes.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(unsigned_order("h")))).where(F.col("_n") <= k).drop("_n")


def from_smallest(kept: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    """The distinct count that the k smallest hashes tell: exact while fewer are there."""
    last = F.max(unsigned_order("h")).bitwiseXOR(F.lit(-(1 << 63)))
    found = grouped(kept, by, F.count("*").alias("n"), last.alias("last"))
    return found.select(*by, F.when(F.col("n") < k, F.col("n").cast("double")).otherwise(F.lit(float(k - 1)) * F.lit(2.0**64) / (unsigned_value("last") + 1)).alias("value"))


@register
class KMinimumValues(Sketch):
    name, query_types, mergeable = "k_minimum_values", (CARDINALITY,), True
    axis, axis_range, default = "k", (16, 8192), 1024

    def state(self, s: Stream) -> DataFrame:
        return self.combine(hashed(s.keys(), "key", self.derived("kmv"), "h").select(*s.by, "h"), s.by)

    def combine(self, state: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return smallest(state.distinct(), self.size, by)

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        return from_smallest(state, self.size, by)

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("hashes", 1, 8 * min(size, keys))]


@register
class LinearCounting(Sketch):
    name, query_types, mergeable = "linear_counting", (CARDINALITY,), True
    axis, axis_range, default = "bits_exp", (8, 24), 14

    def state(self, s: Stream) -> DataFrame:
        bit = F.col("h").bitwiseAND(F.lit((1 << self.size) - 1).cast("long")).cast("int").alias("bit")
        return hashed(s.keys(), "key", self.derived("lc"), "h").select(*s.by, bit).distinct()

    def combine(self, state: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return state.distinct()

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        m = float(1 << self.size)
        zeros = F.lit(m) - F.col("used")
        return grouped(state, by, F.count("*").alias("used")).select(*by, F.when(zeros <= 0, F.lit(m)).otherwise(-F.lit(m) * F.log(zeros / m)).alias("value"))

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("bits", 1, (1 << size) // 8)]


@register
class ExactTruncate(Sketch):
    """The exact distinct count up to a capacity."""

    name, query_types = "exact_truncate", (CARDINALITY,)
    axis, axis_range, default = "capacity", (1, 500_000), 4096

    def state(self, s: Stream) -> DataFrame:
        return grouped(s.keys(), s.by, F.least(F.countDistinct("key"), F.lit(self.size)).alias("n"))

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        return state.select(*by, F.col("n").cast("double").alias("value"))

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("keys", 1, 8 * min(size, keys))]


@register
class NativeHll(Sketch):
    """Spark's built-in HLL sketch, a binary state."""

    name, query_types, tier, mergeable = "native_hll", (CARDINALITY,), 0, True
    axis, axis_range, default = "lg_k", (4, 21), 12

    def state(self, s: Stream) -> DataFrame:
        return grouped(s.keys(), s.by, F.hll_sketch_agg("key", F.lit(self.size)).alias("sketch"))

    def combine(self, state: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return grouped(state, by, F.hll_union_agg("sketch").alias("sketch"))

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        return state.select(*by, F.hll_sketch_estimate("sketch").cast("double").alias("value"))

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("sketch", 1, (1 << size) + 40)]


@register
class NativeTheta(Sketch):
    """Spark's built-in theta sketch; it stands where a compressed-probability sketch would, which Spark lacks."""

    name, query_types, tier, mergeable = "native_theta", (CARDINALITY,), 0, True
    axis, axis_range, default = "lg_k", (4, 26), 11

    def state(self, s: Stream) -> DataFrame:
        return grouped(s.keys(), s.by, F.theta_sketch_agg("key", F.lit(self.size)).alias("sketch"))

    def combine(self, state: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return grouped(state, by, F.theta_union_agg("sketch", F.lit(self.size)).alias("sketch"))

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        return state.select(*by, F.theta_sketch_estimate("sketch").cast("double").alias("value"))

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("sketch", 1, 8 * min(1 << size, keys) + 24)]
