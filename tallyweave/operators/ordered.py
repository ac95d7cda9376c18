"""Running folds inside Spark: exactly in order for each group, or by partition with merged summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 100_000
#: Groups whose summaries a task holds at once.
MOST_GROUPS = 4_096


def in_order(df: DataFrame, column: str, by: tuple[str, ...], make: Callable[[], object], rows: Callable[[object], list[tuple]], schema: str) -> DataFrame:
    """One fold for each group over its rows in the order of ``seq``; ``rows`` lists its state.

    The result depends on the whole order, so a group is one task: the price of exact order. Use
    ``by_partition`` where a summary's guarantees are enough.
    """
    kept = df.select(*by, "seq", column) if by else df.select(F.lit(0).alias("_all"), "seq", column)
    keys = list(by) or ["_all"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in by)

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        one = make()
        order = np.argsort(table["seq"].to_numpy(), kind="stable")
        items = table[column].to_numpy()[order]
        for lo in range(0, len(items), BATCH):
            one.add(items[lo : lo + BATCH])
        found = rows(one)
        group = [pa.array([k.as_py()] * len(found), table[n].type) for k, n in zip(key, keys, strict=True)] if by else []
        return pa.table([*group, *(pa.array(c) for c in zip(*found, strict=True))], [*by, *columns]) if found else pa.table([pa.array([], table[n].type) for n in by] + [pa.array([], t) for t in types], [*by, *columns])

    columns = [c.split()[0] for c in schema.split(", ")]
    types = _types(schema)
    return kept.groupBy(*keys).applyInArrow(fold, f"{kinds}, {schema}" if by else schema)


def _types(schema: str) -> list[pa.DataType]:
    return [{"long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]


def _kinds(df: DataFrame, by: tuple[str, ...]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in by)


def _groups(batch: pa.RecordBatch, n: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """A batch's rows by the values of its first ``n`` columns."""
    if not n:
        yield (), np.arange(batch.num_rows)
        return
    codes = np.zeros(batch.num_rows, np.int64)
    for i in range(n):
        column = batch.column(i).dictionary_encode()
        at = column.indices.fill_null(len(column.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        _, codes = np.unique(codes * (len(column.dictionary) + 1) + at, return_inverse=True)
    order = np.argsort(codes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        yield tuple(batch.column(i)[int(rows[0])].as_py() for i in range(n)), rows


def by_partition(df: DataFrame, column: str, by: tuple[str, ...], make: Callable[[], object], rows: Callable[[object], list[tuple]], merged: Callable[[list[list[tuple]]], list[tuple]], schema: str) -> DataFrame:
    """A summary of each partition's part of each group, made where the rows are, then merged: few rows are shuffled.

    ``rows`` lists a summary; ``merged`` makes one listing of those of a group, in two rounds so that
    no task reads more summaries of a group than the square root of the number of partitions. A task holds
    ``MOST_GROUPS`` groups at once; those it has summarised so far are passed on when there are more.
    """
    names, types, width = [c.split()[0] for c in schema.split(", ")], _types(schema), len(by)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, held, kinds = TaskContext.get().partitionId() << 32, {}, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal at
            found = [(*group, at, *row) for group, one in held.items() for row in rows(one)]
            held.clear()
            at += 1
            if found:
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=False)), pa.array(columns[width], pa.int64()), *(pa.array(c, t) for c, t in zip(columns[width + 1 :], types, strict=True))], [*by, "_part", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(i).type for i in range(width)]
            items = batch.column(width).to_numpy(zero_copy_only=False)
            for group, at_rows in _groups(batch, width):
                if group not in held:
                    if len(held) >= MOST_GROUPS:
                        yield from flush()
                    held[group] = make()
                held[group].add_any_order(items[at_rows])
        yield from flush()

    n = max(1, int(df.rdd.getNumPartitions() ** 0.5))
    partial = df.select(*by, column).mapInArrow(summarise, f"{_kinds(df, by)}_part long, {schema}")
    return merge_parts(merge_parts(partial, by, merged, schema, n), by, merged, schema).drop("_part")


def numbered(states: list[DataFrame]) -> DataFrame:
    """The rows of several states, told apart by ``_part``."""
    return reduce(DataFrame.unionByName, (s.withColumn("_part", F.lit(i).cast("long")) for i, s in enumerate(states)))


def merge_parts(parts: DataFrame, by: tuple[str, ...], merged: Callable[[list[list[tuple]]], list[tuple]], schema: str, into: int = 1) -> DataFrame:
    """(by, _part, columns): ``into`` summaries of each group instead of those that ``_part`` tells apart."""
    names, types = [c.split()[0] for c in schema.split(", ")], _types(schema)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        held: dict[int, list[tuple]] = {}
        for part, *row in zip(*(table[c].to_pylist() for c in ("_part", *names)), strict=True):
            held.setdefault(part, []).append(tuple(row))
        found = merged([held[k] for k in sorted(held)])
        group = [pa.array([k.as_py()] * len(found), table[c].type) for k, c in zip(key, by, strict=False)]
        return pa.table([*group, pa.array([key[-1].as_py()] * len(found), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True))], [*by, "_part", *names])

    return parts.withColumn("_to", F.pmod("_part", F.lit(into))).groupBy(*by, "_to").applyInArrow(merge, f"{_kinds(parts, by)}_part long, {schema}")
