"""Point frequencies: one shuffle of cell counts; queries are joins with the cells."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SerializationError
from ..functions.hashing import hashed
from ..sources.stream import Stream, grouped
from . import folds
from .base import FREQUENCY, Query, Sketch, register
from .ordered import by_partition, in_order


class _Cells(Sketch):
    """Rows of hashed cells: key counts are summed first, so a hot key is one row before cells are made."""

    query_types, mergeable = (FREQUENCY,), True
    axis, axis_range, default = "width_power", (5, 20), 12
    depth: int

    def places(self, df: DataFrame) -> DataFrame:
        """``df`` with one row for each of the ``depth`` cells of its key: row, idx and odd (the hash's low bit)."""
        for r in range(self.depth):
            df = hashed(df, "key", self.derived(f"row:{r}"), f"_h{r}")
        cells = F.explode(F.array(*(F.struct(F.lit(r).alias("row"), F.col(f"_h{r}").alias("h")) for r in range(self.depth))))
        out = df.withColumn("_c", cells).drop(*(f"_h{r}" for r in range(self.depth)))
        idx = F.col("_c.h").bitwiseAND(F.lit((1 << self.size) - 1).cast("long")).cast("int")
        return out.select(*(c for c in out.columns if c != "_c"), F.col("_c.row").alias("row"), idx.alias("idx"), self.sign().alias("sign"))

    def sign(self):
        return F.lit(1).cast("long")

    def state(self, s: Stream) -> DataFrame:
        counts = s.keys().groupBy(*s.by, "key").agg(F.count("*").alias("n"))
        cells = self.places(counts).select(*s.by, "row", "idx", (F.col("n") * F.col("sign")).alias("n"))
        return self.combine(cells, s.by)

    def combine(self, state: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return state.groupBy(*by, "row", "idx").agg(F.sum("n").alias("n"))

    def over_rows(self, n):
        return F.min(n)

    def lookup(self, state: DataFrame, keys: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """Estimates of the keys in ``keys`` (columns key and ``by``)."""
        asked = self.places(keys.select(*by, "key").distinct())
        met = asked.join(state, [*by, "row", "idx"], "left")
        return met.groupBy(*by, "key").agg(self.over_rows(F.coalesce("n", F.lit(0)) * F.col("sign")).alias("value"))

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        groups = state.select(*by).distinct() if by else state.sparkSession.range(1).select()
        return self.lookup(state, groups.withColumn("key", F.lit(query.key).cast("long")), by).drop("key")

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("cells", 2, 8 * cls.depth << size)]


@register
class CountMin(_Cells):
    """Never below the truth."""

    name, depth = "count_min", 4


@register
class ConservativeCountMin(CountMin):
    """Count-min with conservative update, never above plain count-min and never below the truth.

    The update reads other cells: partitions make cells of their own, which add up and keep both bounds.
    ``in_order`` is one fold in the order of arrival; ``as_written`` the rule whose cells equal plain count-min's.
    """

    name, mergeable, order_free = "conservative_count_min", True, False

    def __init__(self, size: int | None = None, *, seed: int = 0, as_written: bool = False, in_order: bool = False):
        super().__init__(size, seed=seed)
        self.as_written, self.in_order = as_written, in_order

    def label(self) -> str:
        return super().label() + (" in order" if self.in_order else "")

    def merges(self) -> bool:
        return not self.in_order

    def state(self, s: Stream) -> DataFrame:
        if self.as_written:
            return super().state(s)
        size, seed, depth = self.size, self.seed, self.depth
        make, rows, schema = lambda: folds.ConservativeUpdate(size, seed, depth), lambda f: f.rows(), "row long, idx long, n long"

        def add(parts: list[list[tuple]]) -> list[tuple]:
            one = make()
            for part in parts:
                row, idx, n = (np.array(c) for c in zip(*part, strict=True))
                one.cells[row, idx] += n
            return one.rows()

        if self.in_order:
            return in_order(s.keys(), "key", s.by, make, rows, schema)
        return by_partition(s.keys(), "key", s.by, make, rows, add, schema)


@register
class CountSketch(_Cells):
    """Signed cells; the estimate is the median over rows.

    The sign is a high bit of the hash, apart from the cell's bits. ``as_written`` takes the low bit, which the
    cell's number holds too: keys of a cell share a sign and nothing cancels.
    """

    name, depth = "count_sketch", 5

    def __init__(self, size: int | None = None, *, seed: int = 0, as_written: bool = False):
        super().__init__(size, seed=seed)
        self.as_written = as_written

    def merges(self) -> bool:
        return True

    def sign(self):
        bit = F.col("_c.h") if self.as_written else F.shiftrightunsigned("_c.h", 40)
        return (F.lit(1) - 2 * bit.bitwiseAND(F.lit(1).cast("long"))).cast("long")

    def over_rows(self, n):
        return F.median(n)


@register
class NativeCountMin(Sketch):
    """Spark's built-in count-min sketch, a binary state. Spark has no function that reads it, so its bytes are read here.

    Layout (big-endian): version, total, depth, width, one multiplier a row, then the cells row by row. A key's cell in a row is
    the low 31 bits of (m + (m >> 32)), m being its product with the multiplier in 64 bits, modulo the width.
    """

    name, query_types, tier, mergeable = "native_count_min", (FREQUENCY,), 0, True
    axis, axis_range, default = "lg_width", (4, 18), 10
    depth = 4

    def state(self, s: Stream) -> DataFrame:
        made = F.count_min_sketch("key", F.lit(2 / (1 << self.size)), F.lit(1 - 2.0**-self.depth), F.lit(self.seed & 0x7FFFFFFF))
        return grouped(s.keys(), s.by, made.alias("sketch"))

    def combine(self, state: DataFrame, by: tuple[str, ...]) -> DataFrame:
        def add(key: tuple, table: pa.Table) -> pa.Table:
            parts = [_cells(x) for x in table["sketch"].to_pylist() if x is not None]
            head = bytearray(table["sketch"].drop_null()[0].as_py()) if parts else None
            if parts:
                total, cells = sum(p[0] for p in parts), np.sum([p[2] for p in parts], axis=0)
                head[4:12] = struct.pack(">q", total)
                head[len(head) - cells.nbytes :] = cells.astype(">i8").tobytes()
            return pa.table([*(pa.array([k.as_py()], table[c].type) for k, c in zip(key, keys, strict=True)), pa.array([head and bytes(head)], pa.binary())], [*keys, "sketch"])

        keys = list(by) or ["_all"]
        kept = state if by else state.withColumn("_all", F.lit(0))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in keys)
        return kept.groupBy(*keys).applyInArrow(add, f"{kinds}, sketch binary").select(*by, "sketch")

    def lookup(self, state: DataFrame, keys: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """Estimates of the keys in ``keys`` (columns key and ``by``): a join with the cells, made where the sketches are."""
        width, seen = len(by), state.where(F.col("sketch").isNotNull()).select("sketch").limit(1).collect()  # one sketch: its multipliers
        kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in state.schema.fields if f.name in by)
        asked = keys.select(*by, "key").distinct()
        if not seen:
            return asked.withColumn("value", F.lit(0).cast("long"))
        _, multipliers, some = _cells(bytes(seen[0].sketch))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, raw in enumerate(batch.column(width).to_pylist()):
                    if raw is not None:
                        row, idx = np.nonzero(cells := _cells(raw)[2])
                        group = [pa.array([batch.column(j)[i].as_py()] * len(row), batch.schema.field(j).type) for j in range(width)]
                        yield pa.RecordBatch.from_arrays([*group, pa.array(row.astype(np.int32)), pa.array(idx.astype(np.int32)), pa.array(cells[row, idx])], [*by, "row", "idx", "n"])

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                items = batch.column(width).to_numpy(zero_copy_only=False).astype(np.int64)
                for row, m in enumerate(multipliers.tolist()):
                    with np.errstate(over="ignore"):
                        h = items * np.int64(m)
                        h = (h + (h >> np.int64(32))) & np.int64((1 << 31) - 1)
                    idx = pa.array((h % some.shape[1]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(items), row, np.int32)), idx], [*by, "key", "row", "idx"])

        cells = state.select(*by, "sketch").mapInArrow(spread, f"{kinds}row int, idx int, n long")
        placed = asked.where(F.col("key").isNotNull()).mapInArrow(places, f"{kinds}key long, row int, idx int")
        return placed.join(cells, [*by, "row", "idx"], "left").groupBy(*by, "key").agg(F.min(F.coalesce("n", F.lit(0))).alias("value"))

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        groups = state.select(*by).distinct() if by else state.sparkSession.range(1).select()
        return self.lookup(state, groups.withColumn("key", F.lit(query.key).cast("long")), by).drop("key")

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("sketch", 1, 20 + 8 * cls.depth + (8 * cls.depth << size))]


def _cells(raw: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Total, multipliers and cells (depth, width) of a built-in count-min sketch."""
    version, total, depth, width = struct.unpack_from(">iqii", raw)
    if version != 1:
        raise SerializationError("unknown version of a count-min sketch", version=version)
    numbers = np.frombuffer(raw, ">i8", depth + depth * width, 20).astype(np.int64)
    return total, numbers[:depth], numbers[depth:].reshape(depth, width)


@register
class FirstKeysCounts(Sketch):
    """Exact counts of the first ``capacity`` distinct keys to arrive; 0 for others."""

    name, query_types, order_free = "first_keys_counts", (FREQUENCY,), False
    axis, axis_range, default = "capacity", (1, 500_000), 4096

    def state(self, s: Stream) -> DataFrame:
        return first_keys(s, self.size)

    def lookup(self, state: DataFrame, keys: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        return keys.join(state, [*by, "key"], "left").select(*by, "key", F.coalesce("count", F.lit(0)).alias("value"))

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        hit = F.coalesce(F.max(F.when(F.col("key") == query.key, F.col("count"))), F.lit(0)).alias("value")
        return state.groupBy(*by).agg(hit) if by else state.agg(hit)

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        return [("keys", 1, 8 * min(size, keys)), ("counts", 1, 8 * min(size, keys))]


def first_keys(s: Stream, capacity: int) -> DataFrame:
    counts = s.keys().groupBy(*s.by, "key").agg(F.min("seq").alias("first"), F.count("*").alias("count"))
    if not s.by:
        return counts.orderBy("first", "key").limit(capacity).select("key", "count")
    return counts.withColumn("_n", F.row_number().over(Window.partitionBy(*s.by).orderBy("first", "key"))).where(F.col("_n") <= capacity).select(*s.by, "key", "count")
