"""The gate experiment: every cell (kind of stream, budget, seed) is one row and one task."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import CARDINALITY, FREQUENCY, HEAVY_HITTERS, QUANTILE
from ..sources.generate import StreamSpec, arrays
from .adaptive import Truth, local_losses
from .allocate import Context, FixedSplit, GridSearch, Laws, PerSegment, Uniform
from .gates import evaluate_gates
from .laws import fit_error_law
from .score import gate_score

#: What separates an evaluation stream's seed from its calibration's.
EVALUATION_SEED = 7_000_003
_SCHEMA = "kind string, budget long, seed long, flagship double, fixed double, uniform double, segment double, ratio double, ablation double, segment_ratio double, predicted double, plan map<string,long>"


def budgets_up_to(most: int) -> list[int]:
    return sorted({most, *(64 << i for i in range(max(0, most.bit_length() - 6)) if 64 << i <= most)})


def calibrated_laws(kind: str, n: int, domain: int, most: int, seed: int, streams: int = 3) -> Laws:
    """Laws of a kind of stream, each error averaged over several streams of other seeds."""
    made = [arrays(StreamSpec(kind, n, domain, seed + 1000 * i)) for i in range(streams)]
    truths = [Truth(*x) for x in made]
    budgets = budgets_up_to(most)
    losses = [[local_losses(dict.fromkeys(("shared", "quantile", "heavy"), b), *x, t, seed) for x, t in zip(made, truths, strict=True)] for b in budgets]
    return {f: fit_error_law(budgets, [float(np.mean([x[f] for x in at])) for at in losses]) for f in (CARDINALITY, FREQUENCY, QUANTILE, HEAVY_HITTERS)}


def run_cell(kind: str, budget: int, seed: int, n: int, domain: int, streams: int) -> dict:
    laws, context = calibrated_laws(kind, n, domain, budget, seed, streams), Context()

    def scores(of: int, *strategies) -> list[float]:
        x = arrays(StreamSpec(kind, n, domain, of))
        truth = Truth(*x)
        return [gate_score(local_losses(s.allocate(laws, budget, context), *x, truth, seed)) for s in strategies]

    over = lambda a, b: a / b if b > 0 else math.nan
    flagship, fixed, uniform, segment = scores(seed + EVALUATION_SEED, GridSearch(), FixedSplit(), Uniform(), PerSegment())
    return {
        "kind": kind, "budget": budget, "seed": seed, "flagship": flagship, "fixed": fixed, "uniform": uniform, "segment": segment,
        "ratio": over(flagship, fixed), "ablation": over(flagship, uniform), "segment_ratio": over(flagship, segment),
        "predicted": over(*scores(seed, GridSearch(), FixedSplit())), "plan": list(GridSearch().allocate(laws, budget, context).items()),
    }


def run_experiment(spark: SparkSession, kinds: Sequence[str], budgets: Sequence[int], seeds: Sequence[int], *, n: int = 20_000, domain: int = 100_000, streams: int = 3) -> DataFrame:
    """One row for each cell with the scores of four strategies and their ratios."""
    cells = [(k, int(b), int(s)) for k in kinds for b in budgets for s in seeds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [run_cell(r["kind"], r["budget"], r["seed"], n, domain, streams) for r in batch.to_pylist()]
            kinds = [("kind", pa.string()), ("budget", pa.int64()), ("seed", pa.int64()), *((c, pa.float64()) for c in ("flagship", "fixed", "uniform", "segment", "ratio", "ablation", "segment_ratio", "predicted")), ("plan", pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    frame = spark.createDataFrame(cells, "kind string, budget long, seed long")
    return frame.repartition(max(1, len(cells)), *(F.col(c) for c in frame.columns)).mapInArrow(run, _SCHEMA)


def write_runs(runs: DataFrame, path: str) -> None:
    """An experiment's rows as a table of JSON lines: whole or not at all, by Spark's committer."""
    runs.write.mode("overwrite").json(path)


def gate(runs: DataFrame, delta: float = 0.15) -> dict:
    """The gates over an experiment's rows (one a cell), with notes."""
    rows = runs.collect()
    predicted = [r.predicted for r in rows if math.isfinite(r.predicted)]
    return evaluate_gates([r.ratio for r in rows], [r.segment_ratio for r in rows], [r.ablation for r in rows], float(np.mean(predicted)) if predicted else math.nan, delta)
