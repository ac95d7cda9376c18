"""Sketches over unbounded streams with Structured Streaming.

Order-free, mergeable sketches keep their relational state by merging each micro-batch's state into a
table: ``foreachBatch`` writes one version of the state for each batch number, so a batch that is run again
after a failure writes the same version again. Windowed counts use event time and a watermark. Order-bound
summaries that don't merge keep their state by group in ``applyInPandasWithState``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import EstimateUnavailableError
from ..operators.base import Query, Sketch
from ..sources.stream import Stream


class RunningSketch:
    """A mergeable sketch's state under ``path``, one version for each micro-batch.

    The versions in the folder are all that is remembered, so a new object on the same path goes on where an earlier
    one stopped. The two newest are kept: a batch that is run again starts from the one before.
    """

    def __init__(self, sketch: Sketch, path: str, by: tuple[str, ...] = ()):
        self.sketch, self.path, self.by = sketch, path.rstrip("/"), by

    def _version(self, batch: int) -> str:
        return f"{self.path}/v={batch}"

    def _folder(self, spark: SparkSession):
        """Hadoop's file system and path: wherever Spark writes, versions are found."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def versions(self, spark: SparkSession) -> list[int]:
        """Batches whose states are complete, ascending."""
        system, path = self._folder(spark)
        if not system.exists(path):
            return []
        names = [str(x.getPath().getName()) for x in system.listStatus(path)]
        done = lambda name: system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS"))
        return sorted(int(name[2:]) for name in names if name.startswith("v=") and done(name))

    def update(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch`` over rows with seq, key, value and the ``by`` columns."""
        spark, state = batch.sparkSession, self.sketch.state(Stream(batch, self.by))
        earlier = [v for v in self.versions(spark) if v < number]
        if earlier:
            before = spark.read.parquet(self._version(earlier[-1]))
            state = self.sketch.merge(before, state.select(*before.columns), by=self.by)
        elif number > 0:
            raise EstimateUnavailableError("the state of earlier batches is gone", path=self.path, batch=number)
        state.write.mode("overwrite").parquet(self._version(number))
        system, _ = self._folder(spark)
        for old in earlier[:-1]:
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(self._version(old)), True)

    def estimate(self, spark: SparkSession, query: Query, batch: int | None = None) -> DataFrame:
        """The answer after the newest complete batch, or after a given one of the two that are kept."""
        known = self.versions(spark)
        if not known or batch is not None and batch not in known:
            raise EstimateUnavailableError("no state of this batch", path=self.path, batch=batch, known=known)
        return self.sketch.estimate(spark.read.parquet(self._version(known[-1] if batch is None else batch)), query, self.by)


def windowed_distinct(events: DataFrame, time: str, key: str, window: str, late: str, *by: str) -> DataFrame:
    """Distinct keys by event-time window, by Spark's built-in sketch; rows later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.hll_sketch_estimate(F.hll_sketch_agg(key)).alias("value"))


def windowed_counts(events: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Rows by event-time window and the ``by`` columns."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))


def folded(rows: DataFrame, by: str, column: str, make: Callable[[], object], answer: Callable[[object], float]) -> DataFrame:
    """(by, value): an order-bound fold kept for each group, its answer given anew with each batch that has rows of it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        one = pickle.loads(state.get[0]) if state.exists else make()  # noqa: S301  what this function wrote
        for batch in batches:
            one.add(batch.sort_values("seq")[column].to_numpy())
        state.update((pickle.dumps(one),))
        yield pd.DataFrame({by: [key[0]], "value": [float(answer(one))]})

    kind = dict(rows.dtypes)[by]
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, value double", "fold binary", "update", GroupStateTimeout.NoTimeout)
