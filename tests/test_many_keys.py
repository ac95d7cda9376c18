"""Heavy hitters over more keys than a summary holds: the registered queries return what their SQL does."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators.base import HEAVY_HITTERS, Query
from tallyweave.operators.heavy_hitters import LossyCountingTop, MisraGriesTop, NativeTopK, SketchAndTableTop, SpaceSavingTop
from tallyweave.plans.catalog import ORACLE_SQL, QUERIES
from tallyweave.sources.stream import Stream

#: More keys than the largest summary (65,536) in one type of event, every key twice and far apart, so that all tie.
KEYS = 70_000
NAMES = ["approx_top_k", "cm_heap", "cm_heap_as_written", "lossy_as_written_wide", "lossy_wide", "merge_misra_gries", "misra_gries_wide", "space_saving_by_group", "space_saving_wide"]


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    where = tmp_path_factory.mktemp("many")
    duckdb.sql(f"COPY (SELECT i AS event_id, (i * 7919) % {KEYS} AS user_id, 'a' AS event_type, 1.0::DOUBLE AS value FROM range({2 * KEYS}) t(i)) TO '{where}/events.parquet' (FORMAT parquet)")
    return str(where)


@pytest.mark.parametrize("name", NAMES)
def test_more_keys_than_places(spark, many, name):
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS SELECT * FROM '{many}/events.parquet'")
        wanted = db.sql(ORACLE_SQL[name]).fetchall()
    assert sorted(tuple(r) for r in QUERIES[name](spark, many).collect()) == sorted(wanted)


SMALL = [SpaceSavingTop(6), SpaceSavingTop(6, as_written=True), MisraGriesTop(6), LossyCountingTop(6), LossyCountingTop(6, as_written=True), SketchAndTableTop(6), SketchAndTableTop(6, as_written=True), NativeTopK(6)]


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("rooms", [None, 1])
@pytest.mark.parametrize("sketch", SMALL, ids=lambda s: s.label())
def test_whole_is_exact(spark, monkeypatch, sketch, rooms, grouped):
    """With as many parts as the keys need, and with one, whose summary lets keys go; null groups and keys included."""
    if rooms:
        monkeypatch.setattr(type(sketch), "rooms", lambda self, keys, rows: rooms)
    rng = np.random.default_rng(7)
    rows = [(i, None if i % 50 == 0 else int(k), None if k % 3 == 0 else "b") for i, k in enumerate(np.minimum(rng.zipf(1.3, 1500), 400))]
    by = ("g",) if grouped else ()
    s = Stream(spark.createDataFrame(rows, "seq long, key long, g string").withColumn("value", F.lit(None).cast("double")).repartition(3), by)
    counts = Counter((*((g,) if by else ()), k) for _, k, g in rows if k is not None)
    wanted = []
    for group in {x[:-1] for x in counts}:
        wanted += sorted(((*x, n) for x, n in counts.items() if x[:-1] == group), key=lambda x: (-x[-1], x[-2]))[:6]
    assert Counter(tuple(r) for r in sketch.whole(s, Query(HEAVY_HITTERS, top_k=6)).collect()) == Counter(wanted)


def test_whole_of_nothing(spark):
    s = Stream(spark.createDataFrame([], "seq long, key long, value double"))
    assert [x.whole(s, Query(HEAVY_HITTERS, top_k=3)).count() for x in SMALL] == [0] * len(SMALL)
