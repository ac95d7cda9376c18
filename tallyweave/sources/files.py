"""Streams from files and records to files."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path
from typing import Any
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DataLoadError, EmptyStreamError

FORMATS = {".csv": "csv", ".jsonl": "jsonl", ".json": "jsonl", ".npy": "npy", ".parquet": "parquet"}


def load(spark: SparkSession, path: str, *, fmt: str | None = None, key_col: str | int | None = None, value_col: str | int | None = None) -> DataFrame:
    """seq, key and value from a CSV, JSON-lines, NumPy or Parquet file; rows keep the file's order in ``seq``.

    Anything wrong with the file is a DataLoadError that names it; a file without rows is an EmptyStreamError.
    """
    kind = (fmt or FORMATS.get(Path(path).suffix.lower(), "")).lower()
    if kind not in {"csv", "jsonl", "npy", "parquet"}:
        raise DataLoadError("unknown format", path=path, format=kind or Path(path).suffix)
    try:
        rows = {"csv": _csv, "jsonl": _jsonl, "npy": _npy, "parquet": _parquet}[kind](spark, path, key_col, value_col)
        if rows.isEmpty():
            raise EmptyStreamError("no rows", path=path)
    except (DataLoadError, EmptyStreamError):
        raise
    except Exception as e:
        raise DataLoadError("cannot read", path=path, reason=str(e).splitlines()[0] if str(e) else type(e).__name__) from e
    return rows


def _place() -> list[Column]:
    """Where a row stands: its file, the block of it that one task reads, and a number that rises within a block."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]


def _ordered(df: DataFrame) -> DataFrame:
    """``seq`` from 0 by file name, then place in the file, without gathering the rows: blocks are counted (one row each on
    the driver), and a row's number is its place in its block and the rows of all blocks before."""
    blocks = df.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_at").alias("first")).orderBy("_file", "_block").collect()
    starts = accumulate([0, *(b.n for b in blocks)])
    table = df.sparkSession.createDataFrame([(b._file, b._block, s - b["first"]) for b, s in zip(blocks, starts, strict=False)], "_file string, _block long, shift long")
    # Rows that a filter left out leave gaps in a block.
    return df.join(table, ["_file", "_block"]).select((F.col("_at") + F.col("shift")).alias("seq"), "key", "value")


def _need(columns: list[str], *names: str, path: str) -> None:
    if missing := sorted(set(names) - set(columns)):
        raise DataLoadError("missing columns", path=path, missing=missing)


def _csv(spark: SparkSession, path: str, key: str | None, value: str | None) -> DataFrame:
    key, value = key or "key", value or "value"
    text = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)  # a header and strings: no pass to infer types
    _need(text.columns, key, value, path=path)
    return _checked(text.select(F.col(f"`{key}`").alias("k"), F.col(f"`{value}`").alias("v"), *_place()), path)


def _checked(text: DataFrame, path: str) -> DataFrame:
    out = text.select("*", F.expr("try_cast(trim(k) AS bigint)").alias("key"), F.expr("try_cast(trim(v) AS double)").alias("value"))
    bad = out.where(F.col("key").isNull() | F.col("value").isNull()).limit(1).collect()
    if bad:
        raise DataLoadError("not a number", path=path, row={c: bad[0][c] for c in ("k", "v")})
    return _ordered(out)


def _jsonl(spark: SparkSession, path: str, key: str | None, value: str | None) -> DataFrame:
    key, value = key or "key", value or "value"
    every = spark.read.text(path).select("value", *_place())
    parsed = every.where(F.trim("value") != "").withColumn("row", F.from_json("value", "map<string,string>"))
    at = parsed.select("_file", "_block", "_at", F.col("row").isNull().alias("broken"), F.element_at("row", F.lit(key)).alias("k"), F.element_at("row", F.lit(value)).alias("v"))
    if bad := at.where(F.col("broken") | F.col("k").isNull() | F.col("v").isNull()).orderBy("_file", "_block", "_at").limit(1).collect():
        # Only for the message: how many lines of its file come before.
        before = (F.col("_block") < bad[0]._block) | (F.col("_block") == bad[0]._block) & (F.col("_at") <= bad[0]._at)
        number = every.where((F.col("_file") == bad[0]._file) & before).count()
        raise DataLoadError("not an object" if bad[0]["broken"] else "missing column", path=path, file=bad[0]._file, line=number)
    return _checked(at.select("k", "v", "_file", "_block", "_at"), path)


#: Rows of an array that a task reads.
ARRAY_ROWS = 1 << 20


def _npy(spark: SparkSession, path: str, key: str | int | None, value: str | int | None) -> DataFrame:
    """A NumPy array, read in ranges of rows by tasks of their own; only its header goes to the driver.

    The path must be one that executors can open too, as for every other format.
    """
    system, at = _filesystem(path)
    with system.open_input_file(at) as f:
        version = np.lib.format.read_magic(f)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
        if read is None:
            raise DataLoadError("unknown version of the array format", path=path, version=version)
        shape, by_column, dtype = read(f)
        start = f.tell()
    if dtype.hasobject:
        raise DataLoadError("arrays of objects are not read", path=path)
    if dtype.names:
        key, value = key or "key", value or "value"
        _need(list(dtype.names), key, value, path=path)
        if len(shape) != 1:
            raise DataLoadError("one dimension needed", path=path, shape=shape)
    else:
        key, value = 0 if key is None else int(key), 1 if value is None else int(value)
        if len(shape) != 2 or not all(-shape[1] <= c < shape[1] for c in (key, value)):
            raise DataLoadError("two columns needed", path=path, shape=shape)
    n, width = shape[0], 1 if dtype.names else shape[1]

    def rows(f, lo: int, hi: int, column: str | int) -> np.ndarray:
        """A column of the rows lo to hi."""
        if by_column and not dtype.names:
            f.seek(start + ((column % width) * n + lo) * dtype.itemsize)
            return np.frombuffer(f.read((hi - lo) * dtype.itemsize), dtype)
        f.seek(start + lo * width * dtype.itemsize)
        block = np.frombuffer(f.read((hi - lo) * width * dtype.itemsize), dtype)
        return block[column] if dtype.names else block.reshape(-1, width)[:, column]

    def load_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _filesystem(path)
        with system.open_input_file(at) as f:
            for batch in batches:
                for lo in (batch.column(0).to_numpy() * ARRAY_ROWS).tolist():
                    hi = min(n, lo + ARRAY_ROWS)
                    keys, values = (rows(f, lo, hi, c) for c in (key, value))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi, dtype=np.int64)), pa.array(keys.astype(np.int64)), pa.array(values.astype(np.float64))], ["seq", "key", "value"])

    ranges = max(1, -(-n // ARRAY_ROWS))
    return spark.range(0, ranges if n else 0, numPartitions=ranges).mapInArrow(load_ranges, "seq long, key long, value double")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


def _parquet(spark: SparkSession, path: str, key: str | None, value: str | None) -> DataFrame:
    df = spark.read.parquet(path)
    key, value = key or "key", value or "value"
    _need(df.columns, key, value, path=path)
    return _ordered(df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{value}`").cast("double").alias("value"), *_place()))


def describe(stream: DataFrame) -> dict[str, Any]:
    """What a loaded stream is: rows and distinct keys."""
    row = stream.agg(F.count("*").alias("n"), F.countDistinct("key").alias("domain")).first()
    if not row.n:
        raise EmptyStreamError("no rows")
    return {"kind": "uniform", "n": row.n, "domain": row.domain, "value_dist": "loaded"}


def dump_json(record: Any, path: str | Path) -> None:
    """Write a small record on the driver, whole or not at all, with sorted keys."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, own = tempfile.mkstemp(dir=path.parent, prefix=path.name)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(record, f, sort_keys=True, ensure_ascii=False, indent=1)
            f.flush()
            os.fsync(f.fileno())
        os.replace(own, path)
    except BaseException:
        Path(own).unlink(missing_ok=True)
        raise


def open_text(path: str | Path, mode: str = "r"):
    if "b" in mode:
        raise ValueError("text mode only")
    return open(path, mode, encoding="utf-8")


def dense_seq(stream: DataFrame) -> DataFrame:
    """``seq`` made consecutive from 0. An ordered window over all rows: for small streams."""
    return stream.withColumn("seq", (F.row_number().over(Window.orderBy("seq")) - 1).cast("long"))
