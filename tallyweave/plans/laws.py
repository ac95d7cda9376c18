"""Error laws: error = max(a * bytes**-c, floor), fitted in logarithms."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_ERROR = 1e-6


@dataclass(frozen=True)
class ErrorLaw:
    a: float
    c: float
    floor: float
    r2: float
    n_points: int
    n_points_clamped: int = 0
    degenerate: bool = False
    reason: str = ""

    def predict(self, budget: float) -> float:
        return self.a + self.floor if budget <= 0 else max(self.a * budget**-self.c, self.floor)

    def elasticity(self) -> float:
        return 0.0 if self.degenerate else self.c


def fit_error_law(budgets: Sequence[float], errors: Sequence[float]) -> ErrorLaw:
    """Least squares of log error on log bytes; laws that explain little or rise are marked degenerate."""
    b, e = np.asarray(budgets, np.float64), np.asarray(errors, np.float64)
    if len(b) < 2:
        return ErrorLaw(float(e[0]) if len(e) else 0.0, 0.0, 0.0, 0.0, len(b), 0, True, "fewer than 2 points")
    use = b > 0
    b, e = b[use], e[use]
    floor = float(e.min()) if len(e) else 0.0
    clamped = int((e <= LEAST_ERROR).sum())
    if len(b) < 4:
        return ErrorLaw(float(e.mean()) if len(e) else 0.0, 0.0, floor, 0.0, len(b), clamped, True, "fewer than 4 positive budgets")
    x, y = np.log(b), np.log(np.maximum(e, LEAST_ERROR))
    dx, dy = x - x.mean(), y - y.mean()
    sxx, syy = float(dx @ dx), float(dy @ dy)
    if sxx == 0:
        return ErrorLaw(float(np.exp(y.mean())), 0.0, floor, 0.0, len(b), clamped, True, "all budgets equal")
    c = -float(dx @ dy) / sxx
    a = math.exp(y.mean() + c * x.mean())
    r2 = 1 - float(((dy + c * dx) ** 2).sum()) / syy if syy > 0 else 0.0
    reason = "error does not fall" if c <= 0 else "poor fit" if r2 < 0.9 else ""
    return ErrorLaw(a, c, floor, r2, len(b), clamped, bool(reason), reason)


def fit_error_laws(points: DataFrame, family: str = "family") -> DataFrame:
    """One law for each family of (family, budget, error) rows, as one aggregation: what ``fit_error_law`` gives for its rows."""
    used = F.col("budget") > 0
    only = lambda c: F.when(used, c)
    kept = points.select(family, used.alias("used"), only(F.log("budget")).alias("x"), only(F.log(F.greatest("error", F.lit(LEAST_ERROR)))).alias("y"), only(F.col("error")).alias("e"), "error")
    fit = kept.groupBy(family).agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"), F.regr_r2("y", "x").alias("r"), F.regr_syy("y", "x").alias("syy"), F.avg("y").alias("middle"), F.min("e").alias("least"), F.max("x").alias("hi"), F.min("x").alias("lo"), F.avg("e").alias("mean"), F.max("error").alias("single"), F.count("*").alias("rows"), F.count("y").alias("used"), F.count_if(F.col("e") <= LEAST_ERROR).alias("n_points_clamped"))
    n, c = F.col("used"), F.coalesce(-F.col("s"), F.lit(0.0))
    few, short, equal = F.col("rows") < 2, F.col("used") < 4, F.col("hi") == F.col("lo")
    r2 = F.when(few | short | equal | (F.col("syy") == 0), 0.0).otherwise(F.coalesce("r", F.lit(0.0)))
    reason = F.when(few, "fewer than 2 points").when(short, "fewer than 4 positive budgets").when(equal, "all budgets equal").when(c <= 0, "error does not fall").when(r2 < 0.9, "poor fit").otherwise("")
    a = F.when(few, F.col("single")).when(short, F.coalesce("mean", F.lit(0.0))).when(equal, F.exp("middle")).otherwise(F.exp("i"))
    laws = fit.select(family, a.alias("a"), F.when(few | short | equal, 0.0).otherwise(c).alias("c"), F.when(few, 0.0).otherwise(F.coalesce("least", F.lit(0.0))).alias("floor"), r2.alias("r2"), F.when(few, F.col("rows")).otherwise(n).alias("n_points"), F.when(few, F.lit(0)).otherwise(F.col("n_points_clamped")).alias("n_points_clamped"), reason.alias("reason"))
    return laws.withColumn("degenerate", F.col("reason") != "")


def crosscheck(law: ErrorLaw, budgets: Sequence[float], errors: Sequence[float], rounds: int = 50) -> tuple[float, float]:
    """a and c refined on the errors themselves (Gauss-Newton), to compare with the closed form."""
    b, e = np.asarray(budgets, np.float64), np.asarray(errors, np.float64)
    a, c = law.a, law.c
    for _ in range(rounds):
        f = a * b**-c
        step, *_ = np.linalg.lstsq(np.stack([f / a, -f * np.log(b)], 1), e - f, rcond=None)
        a, c = max(a + step[0], 1e-12), c + step[1]
        if np.abs(step).max() < 1e-12:
            break
    return float(a), float(c)
