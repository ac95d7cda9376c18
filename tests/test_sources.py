import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyweave import errors
from tallyweave.sources import files
from tallyweave.sources.generate import KINDS, StreamSpec, arrays, generate, generate_native, zipf_cdf


@pytest.mark.parametrize("kind", KINDS)
def test_streams_repeat(spark, kind):
    spec = StreamSpec(kind, 301, 53, 2026)
    a, b = arrays(spec), arrays(spec)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[0].dtype == np.int64 and len(a[0]) == 301
    rows = generate(spark, spec).orderBy("seq").collect()
    assert [r.key for r in rows] == a[0].tolist()
    native = generate_native(spark, spec)
    one, two = native.repartition(7).orderBy("seq").collect(), generate_native(spark, spec).orderBy("seq").collect()
    assert one == two and len(one) == 301
    assert np.allclose([r.value for r in one], np.log1p(np.abs([r.key for r in one])) + 0.25 * np.sin(np.array([r.key for r in one]) * 0.017))


@pytest.mark.parametrize("alpha", [0.7, 1.0, 1.1, 1.5, 2.5])
@pytest.mark.parametrize("domain", [1, 50, 3_000])
def test_native_zipf_has_its_shares(spark, alpha, domain):
    n = 40_000
    keys = np.array([r.key for r in generate_native(spark, StreamSpec("zipf", n, domain, 5, zipf_alpha=alpha)).select("key").collect()])
    assert keys.min() >= 0 and keys.max() < domain
    cdf = zipf_cdf(domain, alpha)
    for cut in (1, 2, 10, 60, 64, 65, 100, 1_000):
        if cut <= domain:
            assert abs((keys < cut).mean() - cdf[cut - 1]) < 4 * np.sqrt(0.25 / n)


def test_native_draws_have_the_shape(spark):
    n = 20_000
    for kind in ("uniform", "pareto", "drift_abrupt", "drift_gradual", "gmm"):
        spec = StreamSpec(kind, n, 1000, 5, zipf_alpha=1.2)
        native = np.array([r.key for r in generate_native(spark, spec).select("key").collect()])
        drawn = arrays(spec)[0]
        assert native.min() >= 0 and native.max() <= drawn.max() + 11_000
        for cut in () if kind == "gmm" else (1, 10, 100, 1_000, 1_500):  # mixtures differ by their drawn centres
            assert abs((native < cut).mean() - (drawn < cut).mean()) < 0.02


def test_seeds_differ():
    assert (arrays(StreamSpec("uniform", 500, 101, 1))[0] != arrays(StreamSpec("uniform", 500, 101, 2))[0]).any()


@pytest.mark.parametrize("bad", [{"kind": "none"}, {"n": 0}, {"domain": 0}, {"zipf_alpha": 0}, {"drift_rate": 2}])
def test_invalid_specs(bad):
    with pytest.raises(errors.InvalidSpecError):
        StreamSpec(**({"kind": "uniform", "n": 5, "domain": 5, "seed": 1} | bad))


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("key,value,extra\n1,1.5,x\n2,2.5,y\n")
    (tmp_path / "b.jsonl").write_text('{"key":3,"value":3.5}\n\n{"key":4,"value":4.5}\n')
    np.save(tmp_path / "c.npy", np.array([[5, 5.5], [6, 6.5]]))
    np.save(tmp_path / "d.npy", np.array([(7, 7.5)], dtype=[("k", "i8"), ("v", "f8")]))
    spark.range(3).select(F.col("id").alias("key"), F.col("id").cast("double").alias("value")).write.parquet(str(tmp_path / "e.parquet"))
    got = lambda name, **o: [(r.key, r.value) for r in files.load(spark, str(tmp_path / name), **o).orderBy("seq").collect()]
    assert got("a.csv") == [(1, 1.5), (2, 2.5)]
    assert got("b.jsonl") == [(3, 3.5), (4, 4.5)]
    assert got("c.npy") == [(5, 5.5), (6, 6.5)]
    assert got("d.npy", key_col="k", value_col="v") == [(7, 7.5)]
    assert sorted(got("e.parquet")) == [(0, 0.0), (1, 1.0), (2, 2.0)]
    assert files.describe(files.load(spark, str(tmp_path / "a.csv"))) == {"kind": "uniform", "n": 2, "domain": 2, "value_dist": "loaded"}


@pytest.mark.parametrize("kind", ["csv", "jsonl", "parquet"])
def test_seq_is_the_files_order(spark, tmp_path, kind):
    """Files by name, whatever their sizes (Spark packs the largest first), each in its own order, without gaps."""
    expected = []
    (tmp_path / kind).mkdir()
    for f, n in enumerate((3, 4_000, 50, 1)):
        rows = [(10_000 * f + i, float(i)) for i in range(n)]
        expected += rows
        path = tmp_path / kind / f"part-{f}.{kind}"
        if kind == "csv":
            path.write_text("key,value\n" + "".join(f"{k},{v}\n" for k, v in rows))
        elif kind == "jsonl":
            path.write_text("".join(json.dumps({"key": k, "value": v}) + "\n" for k, v in rows))
        else:
            pq.write_table(pa.table({"key": [k for k, _ in rows], "value": [v for _, v in rows]}), path)
    found = files.load(spark, str(tmp_path / kind), fmt=kind).orderBy("seq").collect()
    assert [(r.key, r.value) for r in found] == expected and [r.seq for r in found] == list(range(len(expected)))


def test_arrays_are_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ARRAY_ROWS", 7)
    rng = np.random.default_rng(3)
    keys, values = rng.integers(-50, 50, 100), rng.normal(size=100)
    wide = np.stack([values, rng.normal(size=100), keys.astype(np.float64)], 1)
    named = np.rec.fromarrays([values.astype("f4"), keys.astype("i2")], names="v,k")
    for name, array, options in (("c", wide, {}), ("f", np.asfortranarray(wide), {}), ("n", named, {}), ("i", np.stack([values * 100, keys, keys], 1).astype("i4"), {})):
        np.save(tmp_path / f"{name}.npy", array)
        k, v = ("k", "v") if name == "n" else (-1, 0)
        got = files.load(spark, str(tmp_path / f"{name}.npy"), key_col=k, value_col=v, **options)
        assert got.rdd.getNumPartitions() == 15
        rows = got.orderBy("seq").collect()
        expected = array["v"] if name == "n" else array[:, 0]
        assert [(r.seq, r.key, r.value) for r in rows] == list(zip(range(100), keys.tolist(), expected.astype(float).tolist(), strict=True))
    np.save(tmp_path / "o.npy", np.array([[1, "a"]], object), allow_pickle=True)
    np.save(tmp_path / "e.npy", np.empty((0, 2)))
    with pytest.raises(errors.DataLoadError):
        files.load(spark, str(tmp_path / "o.npy"))
    with pytest.raises(errors.EmptyStreamError):
        files.load(spark, str(tmp_path / "e.npy"))


def test_bad_files(spark, tmp_path):
    (tmp_path / "only.csv").write_text("only\n1\n")
    (tmp_path / "words.csv").write_text("key,value\na,1\n")
    (tmp_path / "x.txt").write_text("")
    (tmp_path / "broken.jsonl").write_text('{"key":1,"value":2}\n\n{"key":1}\n')
    (tmp_path / "none.csv").write_text("key,value\n")
    np.save(tmp_path / "flat.npy", np.arange(3))
    for name in ("only.csv", "words.csv", "x.txt", "broken.jsonl", "flat.npy", "absent.csv", "absent.npy"):
        with pytest.raises(errors.DataLoadError) as e:
            files.load(spark, str(tmp_path / name))
        if name == "broken.jsonl":
            assert e.value.context["line"] == 3
    with pytest.raises(errors.EmptyStreamError):
        files.load(spark, str(tmp_path / "none.csv"))


def test_json_sink(tmp_path):
    path = tmp_path / "deep" / "x.json"
    files.dump_json({"b": 1, "a": "é"}, path)
    assert json.loads(path.read_text(encoding="utf-8")) == {"a": "é", "b": 1} and len(list(path.parent.iterdir())) == 1
    with pytest.raises(TypeError):
        files.dump_json({"a": object()}, path)
    assert json.loads(path.read_text(encoding="utf-8"))["b"] == 1
    with pytest.raises(ValueError, match="text"):
        files.open_text(path, "rb")
