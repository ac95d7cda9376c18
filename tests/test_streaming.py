import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave import errors
from tallyweave.operators import folds
from tallyweave.operators.base import CARDINALITY, Query
from tallyweave.operators.bottom_k import BottomK
from tallyweave.operators.cardinality import HyperLogLog
from tallyweave.sources.stream import Stream
from tallyweave.streaming.running import RunningSketch, folded, windowed_distinct


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("s") / "in")
    rows = spark.range(3000).select(F.col("id").alias("seq"), (F.col("id") * 7919 % 613).alias("key"), F.rand(3).alias("value"), F.timestamp_seconds(F.col("id")).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"))
    rows.repartition(6).write.parquet(path)
    return path


@pytest.mark.parametrize("sketch", [HyperLogLog(9, seed=1), BottomK(128, seed=1)], ids=repr)
def test_running_state_equals_batch(spark, files, tmp_path, sketch):
    whole = spark.read.parquet(files)
    running = RunningSketch(sketch, str(tmp_path / "state"))
    source = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 2).parquet(files).select("seq", "key", "value")
    query = source.writeStream.foreachBatch(running.update).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert running.versions(spark)[-1] >= 2 and len(running.versions(spark)) == 2
    batch = sketch.estimate(Stream(whole.select("seq", "key", "value")), Query(CARDINALITY)).first().value
    assert running.estimate(spark, Query(CARDINALITY)).first().value == batch
    # A new object on the same folder goes on from there; a batch that is run again changes nothing.
    again = RunningSketch(sketch, str(tmp_path / "state"))
    assert again.estimate(spark, Query(CARDINALITY)).first().value == batch
    last = again.versions(spark)[-1]
    more = spark.range(5000, 5400).select(F.col("id").alias("seq"), F.col("id").alias("key"), F.lit(0.5).alias("value"))
    for _ in range(2):
        again.update(more, last + 1)
        all_rows = whole.select("seq", "key", "value").unionByName(more)
        assert RunningSketch(sketch, str(tmp_path / "state")).estimate(spark, Query(CARDINALITY)).first().value == sketch.estimate(Stream(all_rows), Query(CARDINALITY)).first().value
    nothing = RunningSketch(sketch, str(tmp_path / "none"))
    with pytest.raises(errors.EstimateUnavailableError):
        nothing.estimate(spark, Query(CARDINALITY))
    with pytest.raises(errors.EstimateUnavailableError):
        nothing.update(more, 3)
    with pytest.raises(errors.MergeTypeError):
        RunningSketch(type(sketch)(sketch.size, seed=77), str(tmp_path / "state")).update(more, last + 2)


def test_windows(spark, files, tmp_path):
    whole = spark.read.parquet(files)
    source = spark.readStream.schema(whole.schema).parquet(files)
    query = windowed_distinct(source, "ts", "key", "10 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {r.start: r.value for r in spark.sql("SELECT window.start AS start, value FROM windows").collect()}
    exact = {r.start: r.n for r in whole.groupBy(F.window("ts", "10 minutes")).agg(F.countDistinct("key").alias("n")).select("window.start", "n").collect()}
    assert set(found) == set(exact) and all(abs(found[k] - n) <= 0.05 * n for k, n in exact.items())


def test_folds_by_group(spark, files, tmp_path):
    whole = spark.read.parquet(files)
    source = spark.readStream.schema(whole.schema).parquet(files).select("g", "seq", "value")
    out = folded(source, "g", "value", lambda: folds.ClosestPairDigest(32), lambda f: f.quantile(0.5))
    query = out.writeStream.outputMode("update").format("memory").queryName("folds").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {r.g: r.value for r in spark.sql("SELECT * FROM folds").collect()}
    for g, at in (("a", 0), ("b", 1)):
        values = np.array([r.value for r in whole.where(F.col("seq") % 2 == at).collect()])
        assert abs((values <= found[g]).mean() - 0.5) < 0.1
