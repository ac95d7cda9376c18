from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave import errors
from tallyweave.functions.hashing import derive, hash_array_u64
from tallyweave.operators import all_sketches, exact, folds
from tallyweave.operators.base import CARDINALITY, FREQUENCY, HEAVY_HITTERS, QUANTILE, Query, all_names, discover, spec_of
from tallyweave.operators.bottom_k import BottomK, shared_seed
from tallyweave.operators.cardinality import ExactTruncate, HyperLogLog, KMinimumValues, LinearCounting
from tallyweave.operators.codec import check_size, pack, pack_rows, unpack
from tallyweave.operators.frequency import ConservativeCountMin, CountMin, CountSketch, FirstKeysCounts
from tallyweave.operators.heavy_hitters import FirstKeysTop, LossyCountingTop, MisraGriesTop, SketchAndTableTop, SpaceSavingTop
from tallyweave.operators.quantile import CentroidDigest, EqualWidthHistogram, ExactPrefix, ReservoirQuantile
from tallyweave.sources.stream import Stream

N = 3000


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(5)
    keys = np.minimum(rng.zipf(1.3, N), 700).astype(np.int64) - 3
    return keys, rng.normal(10, 3, N)


@pytest.fixture(scope="module")
def frame(spark, arrays):
    keys, values = arrays
    rows = [(i, int(k), float(v), "ab"[i % 2]) for i, (k, v) in enumerate(zip(*arrays, strict=True))] + [(N, None, None, "a")]
    order = np.random.default_rng(1).permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], "seq long, key long, value double, g string").cache()


@pytest.fixture(scope="module")
def stream(frame):
    return Stream(frame.select("seq", "key", "value"))


def value(df):
    return df.first().value


def test_exact(stream, arrays):
    keys, values = arrays
    counts = Counter(keys.tolist())
    assert value(exact.cardinality(stream)) == len(counts)
    assert value(exact.quantile(stream, 0.73)) == pytest.approx(np.quantile(values, 0.73))
    assert value(exact.rank(stream, 10.0)) == pytest.approx((values <= 10).mean())
    assert value(exact.frequency(stream, 0)) == counts[0] and value(exact.frequency(stream, 10**9)) == 0
    assert [(r.key, r["count"]) for r in exact.top_k(stream, 8).collect()] == sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:8]
    assert value(exact.total(stream)) == N + 1
    for bad in (lambda: exact.quantile(stream, 1.1), lambda: exact.top_k(stream, 0)):
        with pytest.raises(errors.InvalidSpecError):
            bad()


def hll_brute(keys, p, seed):
    h = hash_array_u64(np.unique(keys), derive(seed, "hll"))
    m = 1 << p
    reg = np.zeros(m, int)
    for x in h.tolist():
        reg[x & (m - 1)] = max(reg[x & (m - 1)], 64 - p + 1 - (x >> p).bit_length())
    raw = 0.7213 / (1 + 1.079 / m) * m * m / (2.0**-reg).sum()
    zeros = (reg == 0).sum()
    return m * np.log(m / zeros) if raw < 2.5 * m and zeros else raw


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_cardinalities(frame, arrays, partitions):
    keys, _ = arrays
    s, ask = Stream(frame.repartition(partitions).select("seq", "key", "value")), Query(CARDINALITY)
    distinct = np.unique(keys)
    assert value(HyperLogLog(8, seed=3).estimate(s, ask)) == pytest.approx(hll_brute(keys, 8, 3), rel=1e-12)
    h = np.sort(hash_array_u64(distinct, derive(3, "kmv")))
    assert value(KMinimumValues(64, seed=3).estimate(s, ask)) == pytest.approx(63 * 2.0**64 / (float(h[63]) + 1), rel=1e-12)
    assert value(KMinimumValues(8192, seed=3).estimate(s, ask)) == len(distinct)
    bits = len(set((hash_array_u64(distinct, derive(3, "lc")) & np.uint64(1023)).tolist()))
    assert value(LinearCounting(10, seed=3).estimate(s, ask)) == pytest.approx(-1024 * np.log((1024 - bits) / 1024))
    assert value(ExactTruncate(50).estimate(s, ask)) == 50
    core = folds.BottomK(64, shared_seed(3))
    core.add(np.random.default_rng(0).permutation(keys))
    assert value(BottomK(64, seed=3).estimate(s, ask)) == pytest.approx(core.cardinality(), rel=1e-12)
    assert {r.key: r["count"] for r in BottomK(64, seed=3).state(s).collect()} == core.counts


@pytest.mark.parametrize("sketch", [HyperLogLog(6), KMinimumValues(64), LinearCounting(10), BottomK(64), CountMin(6), CountSketch(6), EqualWidthHistogram(16), ReservoirQuantile(64)], ids=repr)
def test_merging_halves_gives_the_whole(frame, sketch):
    parts = [frame.where(F.col("seq") % 3 == i).select("seq", "key", "value") for i in range(3)]
    if isinstance(sketch, EqualWidthHistogram):  # bins are those of each part's own range: totals only
        merged = sketch.merge(*(sketch.state(Stream(p)) for p in parts))
        assert merged.agg(F.sum("n")).first()[0] == N
        return
    states = [sketch.state(Stream(p)) for p in parts]
    whole = sketch.state(Stream(frame.select("seq", "key", "value")))
    columns = sorted(whole.columns)
    for merged in (sketch.merge(*states), sketch.merge(sketch.merge(states[2], states[0]), states[1])):
        assert sorted(map(tuple, merged.select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))


def test_by_groups(frame, arrays):
    keys, _ = arrays
    s = Stream(frame, by=("g",))
    found = {r.g: r.value for r in HyperLogLog(8, seed=3).estimate(s, Query(CARDINALITY)).collect()}
    assert found == {g: pytest.approx(hll_brute(keys[i::2], 8, 3), rel=1e-12) for i, g in enumerate("ab")}
    top = {g: [] for g in "ab"}
    for r in SpaceSavingTop(4, as_written=True).estimate(s, Query(HEAVY_HITTERS, top_k=3)).collect():
        top[r.g].append((r.key, r["count"]))
    for i, g in enumerate("ab"):
        one = folds.SpaceSaving(16, as_written=True)
        one.add(keys[i::2])
        assert sorted(top[g]) == sorted(one.top(3))


def test_quantiles(stream, arrays):
    _, values = arrays
    ask = Query(QUANTILE, q=0.3)
    assert value(ExactPrefix(100).estimate(stream, ask)) == pytest.approx(np.quantile(values[:100], 0.3))
    h = hash_array_u64(np.arange(N), derive(2, "reservoir"))
    assert value(ReservoirQuantile(128, seed=2).estimate(stream, ask)) == pytest.approx(np.quantile(values[np.argsort(h)[:128]], 0.3))
    rank = lambda v: (values <= v).mean()
    assert abs(rank(value(ReservoirQuantile(512, seed=2, as_written=True).estimate(stream, ask))) - 0.3) < 0.08
    lo, hi, counts = np.inf, -np.inf, np.zeros(32, int)
    for v in values:
        lo, hi = min(lo, v), max(hi, v)
        if hi > lo:
            counts[min(max(int((v - lo) / ((hi - lo) / 32)), 0), 31)] += 1
    at = min(int(np.searchsorted(np.cumsum(counts), 0.3 * (N - 1), "right")), 31)
    assert value(EqualWidthHistogram(32, as_written=True).estimate(stream, ask)) == pytest.approx(lo + at * (hi - lo) / 32 + (hi - lo) / 64)
    assert abs(rank(value(EqualWidthHistogram(64).estimate(stream, ask))) - 0.3) < 0.03
    centroids = []
    for v in values[:400].tolist():
        centroids = sorted([*centroids, (v, 1.0)], key=lambda c: c[0])
        if len(centroids) > 16:
            i = min(range(16), key=lambda i: centroids[i + 1][0] - centroids[i][0])
            (a, m), (b, n) = centroids[i : i + 2]
            centroids[i : i + 2] = [((a * m + b * n) / (m + n), m + n)]
    short = Stream(stream.df.where("seq < 400"))
    assert sorted(r.mean for r in CentroidDigest(4, as_written=True).state(short).collect()) == pytest.approx([c for c, _ in centroids])
    assert abs(rank(value(CentroidDigest(7).estimate(stream, ask))) - 0.3) < 0.05


def test_frequencies(spark, stream, arrays):
    keys, _ = arrays
    counts = Counter(keys.tolist())
    asked = spark.createDataFrame([(k,) for k in sorted(counts)] + [(10**6,)], "key long")
    cells = folds.ConservativeUpdate(6, 4)
    plain = np.zeros_like(cells.cells)
    for r, at in enumerate(cells.places(keys)):
        np.add.at(plain[r], at, 1)
    cells.add(keys)
    min_of = lambda table, k: int(table[np.arange(4), cells.places(np.array([k]))[:, 0]].min())
    for sketch, table in ((CountMin(6, seed=4), plain), (ConservativeCountMin(6, seed=4, as_written=True), plain), (ConservativeCountMin(6, seed=4, in_order=True), cells.cells)):
        found = {r.key: r.value for r in sketch.lookup(sketch.state(stream), asked).collect()}
        assert found == {k: min_of(table, k) for k in [*counts, 10**6]}
        assert all(found[k] >= n for k, n in counts.items())
        assert value(sketch.estimate(stream, Query(FREQUENCY, key=0))) == found[0]
    sketch, plainly = ConservativeCountMin(6, seed=4), CountMin(6, seed=4)
    low = {r.key: r.value for r in sketch.lookup(sketch.state(stream), asked).collect()}
    high = {r.key: r.value for r in plainly.lookup(plainly.state(stream), asked).collect()}
    assert all(counts[k] <= n <= high[k] for k, n in low.items()) and sum(low.values()) < sum(high.values())
    signed = {r.key: r.value for r in CountSketch(8, seed=4).lookup(CountSketch(8, seed=4).state(stream), asked).collect()}
    assert abs(np.mean([signed[k] - n for k, n in counts.items()])) < 5
    first = list(dict.fromkeys(keys.tolist()))[:20]
    assert {r.key: r["count"] for r in FirstKeysCounts(20).state(stream).collect()} == {k: counts[k] for k in first}
    assert value(FirstKeysCounts(20).estimate(stream, Query(FREQUENCY, key=first[0]))) == counts[first[0]]
    assert value(BottomK(64).estimate(stream, Query(FREQUENCY, key=10**6))) == 0


def brute_space_saving(keys, width, as_written):
    counts = {}
    for k in keys.tolist():
        if k in counts:
            counts[k] += 1
        else:
            start = 1
            if len(counts) >= width:
                gone = min(counts, key=counts.get)
                start = 1 if as_written else counts.pop(gone) + 1
                counts.pop(gone, None)
            counts[k] = start
    return counts


def test_heavy_hitters(stream, arrays):
    keys, _ = arrays
    counts = Counter(keys.tolist())
    state = lambda sketch: {r.key: r["count"] for r in sketch.state(stream).collect()}
    assert state(SpaceSavingTop(4, as_written=True)) == brute_space_saving(keys, 16, True)
    one = folds.SpaceSaving(16)
    one.add(keys)
    assert one.counts == brute_space_saving(keys, 16, False)
    table = {}
    for k in keys.tolist():
        if k in table or len(table) < 15:
            table[k] = table.get(k, 0) + 1
        else:
            table = {a: n - 1 for a, n in table.items() if n > 1}
    assert state(MisraGriesTop(4)) is not None
    whole = folds.MisraGries(15)
    whole.add(keys)
    assert whole.counts == table
    for k, n in state(SpaceSavingTop(5)).items():
        assert counts[k] <= n <= counts[k] + N / 32
    for k, n in state(MisraGriesTop(5)).items():
        assert counts[k] - N / 32 <= n <= counts[k]
    kept = LossyCountingTop(6).state(stream).collect()
    assert all(r["count"] <= counts[r.key] <= r["count"] + r.error <= r["count"] + N / 64 for r in kept) and {r.missed for r in kept} == {kept[0].missed}
    assert all(n <= kept[0].missed <= N / 64 for k, n in counts.items() if k not in {r.key for r in kept})
    assert len(state(LossyCountingTop(6, as_written=True))) <= 64
    truth = sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:5]
    for sketch in (SketchAndTableTop(10, seed=1), SketchAndTableTop(10, seed=1, as_written=True), FirstKeysTop(4096), SpaceSavingTop(12)):
        assert [(r.key, r["count"]) for r in sketch.estimate(stream, Query(HEAVY_HITTERS, top_k=5)).collect()] == truth


def test_empty_streams(spark):
    s = Stream(spark.createDataFrame([], "seq long, key long, value double"))
    for sketch in (HyperLogLog(6), KMinimumValues(64), LinearCounting(8), BottomK(64), ExactTruncate()):
        assert value(sketch.estimate(s, Query(CARDINALITY))) == 0
    for sketch in (ReservoirQuantile(), EqualWidthHistogram(), ExactPrefix(), CentroidDigest()):
        assert value(sketch.estimate(s, Query(QUANTILE))) == 0
    for sketch in (CountMin(5), FirstKeysCounts(), BottomK(64)):
        assert value(sketch.estimate(s, Query(FREQUENCY, key=1))) == 0
    for sketch in (SpaceSavingTop(4), MisraGriesTop(4), FirstKeysTop()):
        assert sketch.estimate(s, Query(HEAVY_HITTERS)).collect() == []


def test_registry_and_guards(stream):
    assert len(all_sketches()) == 24 == len(all_names()) and spec_of("count_min").mergeable
    with pytest.raises(errors.InvalidSketchParameterError):
        spec_of("none")
    assert {m.name for m in discover(CARDINALITY, tier=1)} == {"hyper_log_log", "k_minimum_values", "linear_counting", "exact_truncate", "bottom_k"}
    assert all(m.deterministic for m in discover(QUANTILE, deterministic_only=True))
    with pytest.raises(errors.EstimateUnavailableError):
        HyperLogLog().estimate(stream, Query(QUANTILE))
    with pytest.raises(errors.InvalidSketchParameterError):
        HyperLogLog(99)
    state = ExactTruncate().state(stream)
    with pytest.raises(errors.MergeUnsupportedError):
        ExactTruncate().merge(state, state)
    with pytest.raises(errors.MergeTypeError):
        HyperLogLog().merge(HyperLogLog().state(stream), CountMin().state(stream))
    with pytest.raises(errors.MergeTypeError):
        HyperLogLog().merge()
    with pytest.raises(errors.MergeTypeError):
        HyperLogLog().estimate(HyperLogLog().state(stream).select(F.col("idx").alias("x"), F.col("idx").alias("rho")), Query(CARDINALITY))


@pytest.mark.parametrize("name", sorted(n for n in all_sketches() if all_sketches()[n].mergeable))
def test_states_merge_with_their_like_only(spark, stream, name, tmp_path):
    """A state knows its sketch, through Parquet and through bytes; another size, seed or update rule is an error."""
    kind = all_sketches()[name]
    sketch, lo = kind(seed=1), kind.axis_range[0]
    state = sketch.state(stream)
    state.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    merged = sketch.merge(stored, state)
    assert sorted(merged.columns) == sorted(state.columns) and sketch.checked(merged) is merged
    others = [kind(lo, seed=1), kind(seed=2), *([kind(seed=1, as_written=True)] if "as_written" in vars(sketch) else [])]
    for other in others:
        with pytest.raises(errors.MergeTypeError):
            sketch.merge(stored, other.state(stream))
        with pytest.raises(errors.MergeTypeError):
            other.estimate(stored, Query(kind.query_types[0], key=1))
    with pytest.raises(errors.MergeTypeError):
        sketch.merge(stored, state.select(*(F.col(c).alias(c, metadata={}) for c in state.columns)))
    if name == "native_top_k":  # its state holds structs
        return
    payload = sketch.serialize(stored)
    back = sketch.deserialize(payload, spark)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(back) == rows(stored) and sketch.serialize(sketch.merge(back)) is not None
    for other in (others[0], others[1], HyperLogLog(5) if name != "hyper_log_log" else CountMin(5)):
        with pytest.raises(errors.SerializationError):
            other.deserialize(payload, spark)
    for bad in (payload[:-3], b"", payload.replace(b"columns", b"colunms")):
        with pytest.raises(errors.SerializationError):
            sketch.deserialize(bad, spark)
    assert kind.slots(sketch.size, 2_000) > 0


def test_written_rules_that_depend_on_order_do_not_merge(stream):
    for sketch in (EqualWidthHistogram(as_written=True), ReservoirQuantile(as_written=True), CentroidDigest(as_written=True), SpaceSavingTop(as_written=True), LossyCountingTop(as_written=True), ConservativeCountMin(in_order=True)):
        state = sketch.state(stream)
        with pytest.raises(errors.MergeUnsupportedError):
            sketch.merge(state, state)
    for sketch in (CountSketch(6, as_written=True), ConservativeCountMin(6, as_written=True)):
        state = sketch.state(stream)
        assert sketch.merge(state, state).agg(F.sum(F.abs("n"))).first()[0] == 2 * state.agg(F.sum(F.abs("n"))).first()[0]


@pytest.mark.parametrize("sketch", [SpaceSavingTop(5), MisraGriesTop(5), LossyCountingTop(6), SketchAndTableTop(7, seed=2), ConservativeCountMin(7, seed=2), CentroidDigest(7)], ids=repr)
def test_merged_summaries_keep_their_bounds(frame, arrays, sketch):
    """Three states merged in two ways, and summaries by group: within the bounds of the whole."""
    keys, values = arrays
    states = [sketch.state(Stream(frame.where(F.col("seq") % 3 == i).select("seq", "key", "value"))) for i in range(3)]
    grouped = sketch.state(Stream(frame, by=("g",)))
    for merged, kept in ((sketch.merge(*states), slice(None)), (sketch.merge(sketch.merge(states[2], states[0]), states[1]), slice(None)), (sketch.merge(grouped, by=("g",)).where("g = 'b'"), slice(1, None, 2))):
        if isinstance(sketch, CentroidDigest):
            v = values[kept]
            assert merged.agg(F.sum("weight")).first()[0] == len(v) and merged.count() <= 128
            for q in (0.01, 0.3, 0.5, 0.99):
                found = value(sketch.answer(merged, Query(QUANTILE, q=q), ()))
                assert abs((v <= found).mean() - q) < 0.02
            continue
        truth, n = Counter(keys[kept].tolist()), len(keys[kept])
        if isinstance(sketch, ConservativeCountMin):
            asked = frame.sparkSession.createDataFrame([(int(k),) for k in truth], "key long")
            plain = CountMin(7, seed=2)
            high = {r.key: r.value for r in plain.lookup(plain.state(Stream(frame.where("g = 'b'" if n < N else "true").select("seq", "key", "value"))), asked).collect()}
            found = {r.key: r.value for r in sketch.lookup(sketch.labelled(merged.drop("g")), asked).collect()}
            assert all(truth[k] <= found[k] <= high[k] for k in truth)
            continue
        if isinstance(sketch, LossyCountingTop):
            rows = {r.key: r for r in merged.collect()}
            assert all(r["count"] <= truth[k] <= r["count"] + r.error and r.missed <= n / 64 for k, r in rows.items()) and len(rows) < 200
            assert all(k in rows for k, c in truth.items() if c > n / 64)
            continue
        if isinstance(sketch, SketchAndTableTop):
            rows = {r.key: r["count"] for r in merged.where("cell IS NULL").collect()}
            assert len(rows) <= 128 and all(truth[k] <= c <= truth[k] + 0.1 * n for k, c in rows.items())
            assert all(k in rows for k, c in truth.items() if c > n / 16)
            continue
        rows = {r.key: r["count"] for r in merged.collect()}
        assert 0 < len(rows) <= 32
        sign = 1 if isinstance(sketch, SpaceSavingTop) else -1
        assert all(0 <= sign * (c - truth[k]) <= n / 31 for k, c in rows.items())
        assert all(k in rows for k, c in truth.items() if c > n / 16)


def test_many_groups_are_passed_on_in_parts(spark, monkeypatch):
    from tallyweave.operators import ordered

    monkeypatch.setattr(ordered, "MOST_GROUPS", 3)
    df = spark.range(2000).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("key"), F.col("id").cast("double").alias("value"), F.when(F.col("id") % 50 > 0, (F.col("id") % 50).cast("string")).alias("g"))
    found = SpaceSavingTop(6).state(Stream(df, by=("g",)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, df.groupBy("g", "key").count().collect()), key=str)


def test_merged_histogram_bins_anew(frame, arrays):
    _, values = arrays
    sketch = EqualWidthHistogram(256)
    parts = [sketch.state(Stream(frame.where(c).select("seq", "key", "value"))) for c in (F.col("value") < 8, F.col("value").between(8, 9), F.col("value") > 9)]
    merged = sketch.merge(parts[0], sketch.merge(parts[1], parts[2]))
    width = (values.max() - values.min()) / 256
    assert merged.agg(F.sum("n")).first()[0] == N
    for q in (0.05, 0.5, 0.95):
        assert abs(value(sketch.estimate(merged, Query(QUANTILE, q=q))) - np.quantile(values, q)) < 3 * width


def test_native_count_min_is_read_as_spark_reads_it(spark, frame, stream, arrays):
    from pyspark import SparkContext

    from tallyweave.operators.frequency import NativeCountMin

    keys, _ = arrays
    sketch, state = NativeCountMin(6, seed=9), NativeCountMin(6, seed=9).state(stream)
    raw = bytes(state.first().sketch)
    theirs = SparkContext._active_spark_context._jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(bytearray(raw))
    asked = spark.createDataFrame([(int(k),) for k in np.unique(keys)] + [(2**62 + 12345,), (-(2**61),), (None,)], "key long")
    found = {r.key: r.value for r in sketch.lookup(state, asked).collect()}
    assert found == {k: theirs.estimateCount(k) for k in found} and len(found) == len(np.unique(keys)) + 2
    assert all(found[k] >= n for k, n in Counter(keys.tolist()).items())
    parts = [sketch.state(Stream(frame.where(F.col("seq") % 2 == i).select("seq", "key", "value"))) for i in (0, 1)]
    assert bytes(sketch.merge(*parts).first().sketch) == raw
    by = sketch.state(Stream(frame, by=("g",)))
    halves = sketch.lookup(by, asked.crossJoin(spark.createDataFrame([("a",), ("b",)], "g string")), ("g",)).groupBy("key").agg(F.sum("value").alias("n"))
    assert all(r.n >= Counter(keys.tolist())[r.key] for r in halves.collect())


def test_exact_quantiles_by_brackets(spark, monkeypatch):
    monkeypatch.setattr(exact, "KEPT", 50)
    monkeypatch.setattr(exact, "ACCURACY", 100)
    rng = np.random.default_rng(8)
    for values in (rng.normal(size=20_000), np.where(rng.random(20_000) < 0.6, 1.5, rng.normal(size=20_000)), np.full(3_000, 2.0), rng.integers(0, 5, 9_000).astype(float), np.array([3.0]), np.array([1.0, 2.0])):
        s = Stream(spark.createDataFrame([(i, None, float(v)) for i, v in enumerate(values)], "seq long, key long, value double").repartition(3))
        for q in (0.0, 0.013, 0.5, 0.77, 1.0):
            assert value(exact.quantile(s, q)) == pytest.approx(np.quantile(values, q), rel=1e-12)
    assert value(exact.quantile(Stream(s.df.limit(0)), 0.5)) is None


def test_codec(stream):
    arrays = {"b": np.arange(6, dtype=np.float64).reshape(2, 3), "a": np.array([True, False])}
    name, meta, back = unpack(pack("x", {"k": 1}, arrays))
    assert (name, meta) == ("x", {"k": 1}) and all((back[k] == v).all() and back[k].dtype == v.dtype for k, v in arrays.items())
    back["b"][0, 0] = 7  # restored arrays can be written to
    for bad in (b"xx", b"TW1\x09", "text", pack("x", {}, arrays)[:20]):
        with pytest.raises(errors.SerializationError):
            unpack(bad)
    with pytest.raises(errors.SerializationError):
        pack("x", {}, {"a": np.array([1j])})
    blob = pack_rows("kmv", {"k": 64}, KMinimumValues(64).state(stream))
    assert len(unpack(blob)[2]["v.h"]) == 64
    check_size(blob, len(blob))
    with pytest.raises(errors.IndistinguishableBudgetError):
        check_size(blob, 2 * len(blob))
