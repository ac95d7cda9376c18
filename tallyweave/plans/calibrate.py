"""Calibration of sketches: errors over repeated streams, each run a group of one job."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import derive, hashed
from ..operators.base import CARDINALITY, QUANTILE, Query, Sketch
from ..sources.generate import StreamSpec, generate_native
from ..sources.stream import Stream
from .laws import ErrorLaw, fit_error_law


def repeated(spark: SparkSession, spec: StreamSpec, runs: int) -> Stream:
    """``runs`` streams of one kind, grouped by ``run``: each of ``spec.n`` rows and draws of its own."""
    n = spec.n
    whole = generate_native(spark, StreamSpec(spec.kind, n * runs, spec.domain, spec.seed, spec.zipf_alpha))
    return Stream(whole.select((F.col("seq") % n).alias("seq"), "key", "value", F.floor(F.col("seq") / n).cast("int").alias("run")), ("run",))


def rank_errors(spark: SparkSession, make, sizes: Sequence[int], spec: StreamSpec, runs: int, quantiles: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(size, mean, most): the distance of an estimated quantile's rank from q, over runs and quantiles."""
    s = repeated(spark, spec, runs)
    out = None
    for size in sizes:
        sketch: Sketch = make(size)
        state = sketch.state(s)
        for q in quantiles:
            found = sketch.estimate(state, Query(QUANTILE, q=q), s.by).withColumnRenamed("value", "estimate")
            # With ties a value's rank is any between the shares below it and up to it.
            met = s.values().join(found, "run").groupBy("run").agg(F.avg((F.col("value") < F.col("estimate")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("estimate")).cast("double")).alias("upto"))
            off = met.select(F.lit(size).alias("size"), F.greatest(F.lit(0.0), F.col("below") - q, q - F.col("upto")).alias("error"))
            out = off if out is None else out.unionByName(off)
    return out.groupBy("size").agg(F.avg("error").alias("mean"), F.max("error").alias("most"))


def count_spread(spark: SparkSession, make, sizes: Sequence[int], n: int, runs: int, seed: int = 0) -> DataFrame:
    """(size, bias, sd): of the relative errors of distinct counts of ``n`` random keys, over runs."""
    keys = hashed(spark.range(n * runs), "id", derive(seed, "spread"), "key")
    s = Stream(keys.select(F.col("id").alias("seq"), "key", F.lit(0.0).alias("value"), F.floor(F.col("id") / n).cast("int").alias("run")), ("run",))
    out = None
    for size in sizes:
        off = make(size).estimate(s, Query(CARDINALITY)).select(F.lit(size).alias("size"), (F.col("value") / n - 1).alias("error"))
        out = off if out is None else out.unionByName(off)
    return out.groupBy("size").agg(F.avg("error").alias("bias"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("sd"))


def scaling(errors: DataFrame, column: str = "mean") -> ErrorLaw:
    """The law of errors by size, whose exponent says how fast they fall (a row a size)."""
    rows = errors.orderBy("size").collect()
    return fit_error_law([float(r["size"]) for r in rows], [float(r[column]) for r in rows])


def register_theory(lg: int) -> float:
    """The relative standard deviation that 2**lg registers are known for."""
    return 1.04 / math.sqrt(1 << lg)
