"""Exact answers: what sketches are measured against, as plain aggregations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidSpecError
from ..sources.stream import Stream, grouped


def check_q(q: float) -> float:
    if not 0 <= q <= 1:
        raise InvalidSpecError("a quantile is between 0 and 1", q=q)
    return q


def cardinality(s: Stream) -> DataFrame:
    return grouped(s.keys(), s.by, F.countDistinct("key").alias("value"))


#: Values that one task sorts, and the accuracy of the brackets.
KEPT, ACCURACY = 100_000, 10_000


def quantile(s: Stream, q: float) -> DataFrame:
    """Linear interpolation between the neighbours of rank q * (n - 1).

    Without groups no task holds all values: brackets around the rank, from Spark's approximate percentiles, narrow until
    few values are strictly inside, and those are counted and sorted. With groups a group's distinct values are one state.
    """
    check_q(q)
    if s.by:
        return grouped(s.values(), s.by, F.percentile("value", q).alias("value"))
    values, spark = s.values().select("value"), s.df.sparkSession
    n, lo, hi = values.agg(F.count("*"), F.min("value"), F.max("value")).first()
    if not n:
        return spark.createDataFrame([(None,)], "value double")
    position = q * (n - 1)
    first, last = math.floor(position), math.ceil(position)
    below, inside = 0, n
    while inside > KEPT and lo < hi:
        within = values.where(F.col("value").between(lo, hi))
        held = within.count()
        marks = [min(1.0, max(0.0, (r - below) / held + e)) for r, e in ((first, -2 / ACCURACY), (last, 2 / ACCURACY))]
        a, b = within.agg(F.percentile_approx("value", marks, ACCURACY)).first()[0]
        less, upto, strictly = values.agg(F.count_if(F.col("value") < a), F.count_if(F.col("value") <= b), F.count_if((F.col("value") > a) & (F.col("value") < b))).first()
        if not (less <= first and last < upto and strictly < inside):
            break
        lo, hi, below, inside = a, b, less, strictly
    counted = values.where(F.col("value").between(lo, hi)).groupBy("value").agg(F.count("*").alias("n"))
    reached = counted.withColumn("upto", F.sum("n").over(Window.orderBy("value")) + below)  # KEPT values and two, unless no bracket narrows
    at = reached.agg(F.min(F.when(F.col("upto") > first, F.col("value"))).alias("a"), F.min(F.when(F.col("upto") > last, F.col("value"))).alias("b"))
    return at.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((last - position) * F.col("a") + (position - first) * F.col("b")).alias("value"))


def rank(s: Stream, v: float) -> DataFrame:
    """The share of values at most v."""
    return grouped(s.values(), s.by, F.avg((F.col("value") <= v).cast("double")).alias("value"))


def frequency(s: Stream, key: int) -> DataFrame:
    return grouped(s.keys(), s.by, F.count_if(F.col("key") == key).alias("value"))


def frequencies(s: Stream, keys: DataFrame) -> DataFrame:
    """Counts of the keys in ``keys`` (a column ``key``), 0 for those that don't occur."""
    counts = s.keys().groupBy("key", *s.by).agg(F.count("*").alias("n"))
    return keys.join(counts, "key", "left").withColumn("value", F.coalesce("n", F.lit(0))).drop("n")


def counts(s: Stream) -> DataFrame:
    return s.keys().groupBy(*s.by, "key").agg(F.count("*").alias("count"))


def top(counted: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k keys of largest count, ties to the smaller key; with ``by``, of each group."""
    if k <= 0:
        raise InvalidSpecError("k must be positive", k=k)
    order = [F.desc("count"), F.asc("key")]
    if not by:
        return counted.orderBy(*order).limit(k)
    return counted.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def top_k(s: Stream, k: int) -> DataFrame:
    return top(counts(s), k, s.by)


def total(s: Stream) -> DataFrame:
    return grouped(s.df, s.by, F.count("*").alias("value"))
