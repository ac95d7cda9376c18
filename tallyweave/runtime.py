"""Probes of the driver and the session."""

from __future__ import annotations

import importlib.metadata
import platform
import resource
import sys
import tempfile
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import BackendMissingError, InvalidBackendModeError


def now_sec() -> float:
    return time.perf_counter()


def rss_bytes() -> int:
    """The driver's largest resident size so far."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024


class PeakTracker:
    """How far the driver's largest resident size rose inside a ``with`` block."""

    def __enter__(self) -> PeakTracker:
        self.before, self.peak = rss_bytes(), 0
        return self

    def __exit__(self, *_: object) -> None:
        self.peak = max(0, rss_bytes() - self.before)


def env_probe(spark: SparkSession | None = None) -> dict[str, str]:
    found = {"python": sys.version.split()[0], "platform": platform.platform()}
    for name in ("pyspark", "numpy", "pyarrow"):
        found[name] = importlib.metadata.version(name)
    if spark is not None:
        found |= {"master": spark.sparkContext.master, "parallelism": str(spark.sparkContext.defaultParallelism)}
    return found


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for intermediate files, in the one that ``spark.checkpoint.dir`` names; on one machine, where that is
    unset, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        return "file://" + tempfile.mkdtemp(prefix="tallyweave-")
    return f"{where.rstrip('/')}/tallyweave/{uuid.uuid4().hex}"


#: Functions that the built-in sketches need.
BUILT_INS = ("hll_sketch_agg", "theta_sketch_agg", "kll_sketch_agg_double", "approx_top_k")


def backend_available() -> bool:
    """Whether this Spark has the built-in sketches."""
    return all(hasattr(F, name) or name == "approx_top_k" for name in BUILT_INS)


def require_backend(mode: str = "auto") -> str:
    """The tier that a mode stands for: 0 for built-in sketches, 1 for this library's."""
    if mode not in {"auto", "tier0", "tier1"}:
        raise InvalidBackendModeError("backend is auto, tier0 or tier1", backend=mode)
    if mode == "tier0" and not backend_available():
        raise BackendMissingError("this Spark lacks built-in sketches", needed=BUILT_INS)
    return "tier1" if mode == "tier1" or not backend_available() else "tier0"
