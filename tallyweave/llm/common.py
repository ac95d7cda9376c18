"""Helpers shared by the training-data operators: shared storage, Arrow mapping and word rules."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


#: What a Python worker keeps from task to task: one operator's memo at a time.
_kept: dict = {}


def let_go() -> None:
    """Give up what this worker keeps of earlier operators, and memory that is free but still held, to the system."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def kept_memo(key: object, make):
    """A worker's memo under ``key``, made by ``make`` if there is none; memos of other operators are let go."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as Spark's setting names it.

    Where the setting is absent, a temporary folder is made and set on one machine (``local[...]``, as in tests);
    on a cluster, whose executors would each write to their own disk, it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tallyweave/{label}-{uuid.uuid4().hex}"


#: Folders of intermediate tables that this driver has written.
_intermediate: list[str] = []


def drop_intermediates() -> None:
    """Remove the intermediate tables written so far, once what is computed from them is no longer asked for; called at exit."""
    while _intermediate:
        with suppress(OSError, ValueError):
            system, path = filesystem(_intermediate.pop())
            system.delete_dir(path)


atexit.register(drop_intermediates)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    where = new_dir(spark, label)
    _intermediate.append(where)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path for a folder as Spark writes it (``file:///x``, ``hdfs://...``, ``/x``)."""
    if urlparse(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def new_file(uri: str):
    """A stream to a file under a name of its own, moved in place at the end: a repeated task attempt does no harm."""
    system, path = filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(own, buffer_size=1 << 20) as out:
            yield out
    except BaseException:
        with suppress(OSError):
            system.delete_file(own)
        raise
    system.move(own, path)


def put_file(uri: str, data: bytes) -> None:
    with new_file(uri) as out:
        out.write(data)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: Column, n: int) -> Column:
    """crc32 of a column as text, mod ``n``; null like the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def fold_of(value, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def text_bytes(column: str = "text") -> Column:
    """A text column as UTF-8 bytes for Python workers; null becomes empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each batch that has rows, as Python lists."""
    for batch in batches:
        if batch.num_rows:
            yield [c.to_pylist() for c in batch.columns]


def column(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_rows(df: DataFrame, f, schema) -> DataFrame:
    """``mapInArrow`` for columns of any names, which ``f`` finds by position."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(f, schema)


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes``, so that what a worker unpacks at once is bounded.

    For operators that keep no memo: those that others kept in this worker are let go, and at the end what the slices
    took, as a worker that has nothing to do in the stages that follow still counts.
    """
    let_go()
    yield from pieces(batches, most_bytes)
    let_go()


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """As ``slices``, for operators that keep a memo."""
    for batch in batches:
        if batch.num_rows:
            rows = max(1, batch.num_rows * most_bytes // max(batch.nbytes, 1))
            yield from (batch.slice(lo, rows) for lo in range(0, batch.num_rows, rows))
