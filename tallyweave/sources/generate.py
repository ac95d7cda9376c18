"""Synthetic streams: one draw-for-draw reproducible kind per name in NumPy, and native ones for any size.

``generate`` draws with NumPy's default generator from a derived seed, in one process. ``generate_native``
makes the same distributions from ``spark.range`` and hashes of the row number, so rows are independent of
the partitioning and no generator's state is passed along: other draws, the same shapes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidSpecError
from ..functions.hashing import derive, hashed

KINDS = ("uniform", "zipf", "pareto", "gmm", "drift_abrupt", "drift_gradual", "low_card", "high_card", "elephant_mice")


#: Ranks of a native Zipf stream that are drawn by their exact shares.
HEAD = 64


@dataclass(frozen=True)
class StreamSpec:
    kind: str
    n: int
    domain: int
    seed: int
    zipf_alpha: float = 1.1
    drift_rate: float = 0.0
    value_dist: str = "normal"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise InvalidSpecError("unknown kind of stream", kind=self.kind)
        if self.n <= 0 or self.domain <= 0 or self.zipf_alpha <= 0 or not 0 <= self.drift_rate <= 1:
            raise InvalidSpecError("out of range", **asdict(self))

    def to_dict(self) -> dict:
        return asdict(self)


def values_of(keys: np.ndarray) -> np.ndarray:
    x = keys.astype(np.float64)
    return np.log1p(np.abs(x)) + 0.25 * np.sin(x * 0.017)


def zipf_cdf(domain: int, alpha: float) -> np.ndarray:
    mass = np.cumsum(np.arange(1, domain + 1, dtype=np.float64) ** -alpha)
    return mass / mass[-1]


def _zipf(rng: np.random.Generator, n: int, domain: int, alpha: float) -> np.ndarray:
    return np.searchsorted(zipf_cdf(domain, alpha), rng.random(n), side="right").astype(np.int64)


def _mixture(s: StreamSpec, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = int(rng.integers(2, 6))
    weights = rng.dirichlet(np.ones(k))
    centres = rng.uniform(0, max(1, s.domain - 1), size=k)
    return weights, centres, rng.uniform(max(0.5, s.domain / 100.0), max(1.0, s.domain / 8.0), size=k)


def _keys(s: StreamSpec, rng: np.random.Generator) -> np.ndarray:
    whole = lambda hi, n: rng.integers(0, hi, size=n, dtype=np.int64)
    match s.kind:
        case "uniform":
            return whole(s.domain, s.n)
        case "zipf":
            return _zipf(rng, s.n, s.domain, s.zipf_alpha)
        case "pareto":
            return np.clip(np.floor((1.0 - rng.random(s.n)) ** (-1.0 / s.zipf_alpha) - 1.0), 0, s.domain - 1).astype(np.int64)
        case "gmm":
            weights, centres, spread = _mixture(s, rng)
            of = rng.choice(len(weights), size=s.n, p=weights)
            return np.clip(np.rint(rng.normal(centres[of], spread[of])), 0, s.domain - 1).astype(np.int64)
        case "drift_abrupt":
            third = s.n // 3
            head, middle = _zipf(rng, third, s.domain, 1.0), whole(10_000, third)
            return np.concatenate([head, middle, _zipf(rng, s.n - 2 * third, s.domain, 1.5) + s.domain + 10_000])
        case "drift_gradual":
            old, new = _zipf(rng, s.n, s.domain, max(1.0, s.zipf_alpha)), whole(s.domain, s.n) + s.domain
            return np.where(rng.random(s.n) < np.arange(s.n) / max(1, s.n - 1), new, old)
        case "low_card":
            return whole(10, s.n)
        case "high_card":
            return np.arange(s.n, dtype=np.int64)
        case _:
            elephants = whole(5, s.n // 2)
            keys = np.concatenate([elephants, np.arange(5, 5 + s.n - s.n // 2, dtype=np.int64)])
            rng.shuffle(keys)
            return keys


def arrays(spec: StreamSpec) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a reproducible stream."""
    keys = _keys(spec, np.random.default_rng(derive(spec.seed, "data"))).astype(np.int64)
    return keys, values_of(keys)


def generate(spark: SparkSession, spec: StreamSpec) -> DataFrame:
    """seq, key and value, draw for draw the reproducible stream."""
    import pyarrow as pa

    keys, values = arrays(spec)
    return spark.createDataFrame(pa.table({"seq": np.arange(spec.n, dtype=np.int64), "key": keys, "value": values}))


def generate_native(spark: SparkSession, spec: StreamSpec) -> DataFrame:
    """seq, key and value of the same distribution, made where the rows are."""
    df = spark.range(spec.n).withColumnRenamed("id", "seq")

    def draw(name: str) -> Column:
        """Uniform in [0, 1)."""
        nonlocal df
        df = hashed(df, "seq", derive(spec.seed, f"native:{name}"), f"_{name}")
        return F.shiftrightunsigned(f"_{name}", 11).cast("double") / F.lit(float(1 << 53))

    def zipf(u: Column, alpha: float) -> Column:
        """By the inverse: exact for the first ``HEAD`` ranks, then that of the integral between half ranks, which is off by
        less than a part in ten thousand of a rank's share. No table of the domain is sent around."""
        nonlocal df
        name = f"_zipf_{alpha}".replace(".", "_")
        df = df.withColumn(name, u)
        x, d = F.col(name), spec.domain
        head = np.cumsum(np.arange(1, min(HEAD, d) + 1, dtype=np.float64) ** -alpha)
        primitive = (lambda t: math.log(t)) if abs(alpha - 1) < 1e-9 else (lambda t: t ** (1 - alpha) / (1 - alpha))
        start = primitive(HEAD + 0.5)
        rest = primitive(d + 0.5) - start if d > HEAD else 0.0
        reached = (head / (head[-1] + rest)).tolist()

        def rank(lo: int, hi: int) -> Column:
            if hi - lo == 1:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(x < reached[mid - 1], rank(lo, mid)).otherwise(rank(mid, hi))

        if not rest:
            return rank(0, len(reached)).cast("long")
        at = start + (x - reached[-1]) / (1 - reached[-1]) * rest
        inverse = F.exp(at) if abs(alpha - 1) < 1e-9 else F.pow(at * (1 - alpha), F.lit(1 / (1 - alpha)))
        tail = F.least(F.greatest(F.floor(inverse + 0.5), F.lit(HEAD + 1)), F.lit(d)) - 1
        return F.when(x < reached[-1], rank(0, len(reached))).otherwise(tail).cast("long")

    below = lambda u, hi: F.floor(u * hi).cast("long")
    n, third = spec.n, spec.n // 3
    makers: dict[str, Callable[[], Column]] = {
        "uniform": lambda: below(draw("u"), spec.domain),
        "zipf": lambda: zipf(draw("u"), spec.zipf_alpha),
        "pareto": lambda: F.least(F.floor(F.pow(1 - draw("u"), F.lit(-1 / spec.zipf_alpha)) - 1), F.lit(spec.domain - 1)).cast("long"),
        "gmm": lambda: _native_mixture(spec, draw),
        "drift_abrupt": lambda: F.when(F.col("seq") < third, zipf(draw("u"), 1.0)).when(F.col("seq") < 2 * third, below(draw("v"), 10_000)).otherwise(zipf(draw("w"), 1.5) + spec.domain + 10_000),
        "drift_gradual": lambda: F.when(draw("m") < F.col("seq") / max(1, n - 1), below(draw("v"), spec.domain) + spec.domain).otherwise(zipf(draw("u"), max(1.0, spec.zipf_alpha))),
        "low_card": lambda: below(draw("u"), 10),
        "high_card": lambda: F.col("seq"),
        # Every second row is an elephant's; mice are keys of their own.
        "elephant_mice": lambda: F.when((F.col("seq") % 2 == 1) & (F.col("seq") < 2 * (n // 2)), below(draw("u"), 5)).otherwise(5 + F.floor((F.col("seq") + 1) / 2)).cast("long"),
    }
    key = makers[spec.kind]()
    # A generator that makes one row of each: filters on the key stop here instead of repeating the hash's steps below.
    keyed = df.select("seq", F.explode(F.array(key)).alias("key"))
    return keyed.withColumn("value", F.log1p(F.abs("key").cast("double")) + 0.25 * F.sin(F.col("key") * 0.017))


def _native_mixture(spec: StreamSpec, draw: Callable[[str], Column]) -> Column:
    weights, centres, spread = _mixture(spec, np.random.default_rng(derive(spec.seed, "native:mixture")))
    pick, reached, out = draw("u"), 0.0, None
    normal = F.sqrt(-2 * F.log(1 - draw("v"))) * F.cos(2 * math.pi * draw("w"))
    for w, c, d in zip(weights, centres, spread, strict=True):
        reached += float(w)
        made = F.lit(float(c)) + F.lit(float(d)) * normal
        out = F.when(pick < reached, made) if out is None else out.when(pick < reached, made)
    return F.least(F.greatest(F.rint(out.otherwise(float(centres[-1]))), F.lit(0)), F.lit(spec.domain - 1)).cast("long")
