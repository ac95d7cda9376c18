import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave import errors
from tallyweave.functions import hashing as H


def test_golden_hash():
    assert H.hash_u64((42).to_bytes(8, "little"), 1337) == 9657053958485203079


@given(st.integers(-(2**63), 2**63 - 1), st.integers(0, 2**64 - 1))
def test_scalar_equals_array(x, seed):
    assert H.hash_u64(H.stable_key(x), seed) == int(H.hash_array_u64(np.array([x], np.int64), seed)[0])


@given(st.floats(width=64))
def test_float_scalar_equals_array(x):
    assert H.hash_u64(H.stable_key(x), 99) == int(H.hash_array_u64(np.array([x]), 99)[0])


def test_float_keys_are_canonical():
    assert H.stable_key(-0.0) == H.stable_key(0.0)
    assert H.stable_key(math.nan) == H.stable_key(-math.nan)
    with pytest.raises(TypeError):
        H.stable_key([])
    with pytest.raises(TypeError):
        H.hash_array_u64(np.array(["a"]), 1)


def test_spark_hash_equals_array(spark):
    keys = [0, 1, -1, 42, 2**63 - 1, -(2**63), 123456789, -987654321]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    for seed in (0, 1337, 2**64 - 1):
        found = {r.k: r.h for r in H.hashed(df, "k", seed, "h").collect()}
        assert found.pop(None) is None
        assert {k: h & H.MASK for k, h in found.items()} == {k: H.splitmix64((k & H.MASK) ^ seed) for k in keys}


def test_spark_hash_stays_in_generated_code(spark):
    plan = H.hashed(spark.range(10), "id", 7, "h")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "*(1)" in plan


def test_index_sign_and_bits(spark):
    key = H.stable_key(5)
    assert H.hash_index(key, 3, 16) == H.hash_u64(key, 3) % 16
    assert H.hash_sign(key, 3) == (1 if H.hash_u64(key, 3) & 1 else -1)
    with pytest.raises(ValueError, match="width"):
        H.hash_index(key, 3, 0)
    rows = spark.createDataFrame([(x,) for x in (0, 1, 2, 255, 2**40, -1)], "x long").select("x", H.bit_length(F.col("x")).alias("n"), H.unsigned_value("x").alias("v")).collect()
    assert [r.n for r in rows] == [H.bit_length_u64(r.x & H.MASK) for r in rows]
    assert [r.v for r in rows] == [float(r.x & H.MASK) for r in rows]


def test_bit_lengths_at_every_power(spark):
    numbers = sorted({x for k in range(64) for x in ((1 << k) - 1, 1 << k, (1 << k) + 1)})
    rows = spark.createDataFrame([(H.signed(x),) for x in numbers], "x long").select(H.bit_length(F.col("x")).alias("n")).collect()
    assert [r.n for r in rows] == [x.bit_length() for x in numbers]


@pytest.mark.parametrize("kind", ["string", "binary", "double", "float", "boolean", "int"])
def test_keys_of_other_types(spark, kind):
    made = {
        "string": ["", "a", "12345678", "123456789", "é" * 9, "x" * 100, "ab\0", "ab"], "binary": [b"", b"\x00", bytes(range(17)), b"12345678"],
        "double": [0.0, -0.0, 1.5, math.nan, math.inf, -1e300], "float": [0.0, 0.5, -2.25], "boolean": [True, False], "int": [0, -1, 2**31 - 1],
    }[kind]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(made)] + [(99, None)], f"i long, `k.x` {kind}").repartition(3)
    found = {r.i: r.h for r in H.hashed(df.withColumnRenamed("k.x", "k"), "k", 77, "h").collect()}
    assert found.pop(99) is None
    assert {i: h & H.MASK for i, h in found.items()} == {i: H.hash_u64(H.stable_key(x), 77) for i, x in enumerate(made)}
    with pytest.raises(TypeError):
        H.hashed(spark.range(1).select(F.array("id").alias("k")), "k", 1, "h")


def test_streams_of_text_keys(spark):
    from tallyweave.operators.base import CARDINALITY, Query
    from tallyweave.operators.cardinality import KMinimumValues
    from tallyweave.sources.stream import Stream

    df = spark.range(900).select((F.col("id") % 300).cast("string").alias("name"))
    assert KMinimumValues(1024).estimate(Stream.hashed(df, "name"), Query(CARDINALITY)).first().value == 300


def test_process_seed():
    H._root.clear()
    with pytest.raises(errors.MissingSeedError):
        H.required_seed()
    assert H.set_seed(1337) is H.required_seed() and H.required_seed().derive("data") == 2653695818018004574
    first = np.random.random()
    H.set_seed(1337)
    assert np.random.random() == first
    a, b = H.Seed(5).generators(2)
    assert a.random() != b.random() and H.Seed(5).generators(1)[0].random() == H.Seed(5).generators(2)[0].random()
    for bad in (lambda: H.set_seed("x"), lambda: H.Seed(1).generators(-1)):
        with pytest.raises(errors.InvalidConfigError):
            bad()


def test_derived_seeds():
    assert H.derive(1337, "data") == 2653695818018004574
    assert H.derive(1, "a") != H.derive(1, "b") != H.derive(2, "b")


def test_error_codes():
    assert len(errors.BY_CODE) == 20 and errors.error_class("E202") is errors.DataLoadError
    assert "E201" in str(errors.InvalidSpecError("x", a=1)) and errors.InvalidSpecError("x", a=1).context == {"a": 1}
    with pytest.raises(RuntimeError):
        errors.registry_of([errors.DataLoadError, type("Other", (errors.TallyError,), {"code": "E202"})])
    with pytest.raises(RuntimeError):
        errors.registry_of([int])
