"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents fall into at most ``blocks`` blocks by a hash. Its target is turned into an exact
quota of block draws: as many whole passes over all its blocks as fit, then the blocks of a pseudo-random
permutation, those that do not fit skipped. What is missing then is closed in rounds: each deals the
documents not yet taken to small buckets by another hash and takes buckets that fit, or takes the largest
single document that fits, until none does; a last one may overshoot where that is closer.

A tree splits the quotas among the output shards. Its upper part, on the driver, splits those of at most
``SOURCE_GROUPS`` groups of sources: each node gives the left half of its shards a multivariate-hypergeometric share of its
draws. Its lower part, a task for each group, splits a group's draws in each shard among its sources in the
same way. So all quotas are met exactly and every shard has the same number of draws, within one. A
shard's draws are a range of each source's permuted draws, disjoint from other shards' ranges, and are
shuffled locally by a hash.

The plan is a table of one row a source, written to the shared folder after each round: any number of
sources will do. What a row holds is bounded by ``blocks`` a round and the number of shards; the decision for a document depends
on its source's row and its hash alone, so no document is shuffled to be drawn where the plan is broadcast,
which is up to ``PLAN_BYTES`` as measured; a larger one is joined by source and salt. Reruns give the same draws.

There is a shard for each ``SHARD_WORDS`` words of the mix, up to ``MOST_SHARDS``; shards of larger mixes are written in
several parts each, by ranges of their local order.

Nulls and other cases: a null source is a source of its own, last in order; a null text has no words;
documents without words are drawn like others and add nothing; rows that agree in id, source and text
are drawn together; an empty table gives an empty result; other columns are passed through unread.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD_WORDS, MOST_SHARDS = 4 << 20, 256
SOURCE_GROUPS = 256
#: A plan is broadcast up to this size; beyond it, it has this many copies, so that a source's documents meet it in as many tasks.
PLAN_BYTES, SALTS = 64 << 20, 16
#: Sources that a task plans, on average.
TASK_SOURCES = 256


def hypergeometric(have: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n draws without replacement are of each kind. Past the generator's range of 10^9 the whole parts
    of the shares are fixed and the rest is drawn."""
    total = int(have.sum())
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(have, n, method="marginals") if total else have
    sure = np.array([int(h) * n // total for h in have], np.int64)
    return sure + rng.multivariate_hypergeometric(np.minimum(have - sure, 1), n - int(sure.sum()), method="marginals")


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Draws by shard and kind: leaves of the tree's upper part. Column sums are the quotas, row sums differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)
    rng = np.random.default_rng(seed)
    total = int(sum(quotas))
    room = np.diff(np.array([i * total // shards for i in range(shards + 1)], np.int64))

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        left = hypergeometric(have, int(room[lo:mid].sum()), rng)
        split(lo, mid, left)
        split(mid, hi, have - left)

    if len(quotas):
        split(0, shards, np.array(quotas, np.int64))
    return out


def split_draws(draws: np.ndarray, quotas: Sequence[int], rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Each source's draws by shard, from those of all of them: leaves of the tree's lower part."""
    if len(quotas) == 1:
        yield draws
        return
    mid = len(quotas) // 2
    left = hypergeometric(draws, int(sum(quotas[:mid])), rng)
    yield from split_draws(left, quotas[:mid], rng)
    yield from split_draws(draws - left, quotas[mid:], rng)


def with_targets(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, size) with ``target``: weights repeat over the sources by code point, null last; shares of all sizes by
    weight, stopped at ``cap`` times a source's size, the excess shared anew until none is above."""
    spark = sources.sparkSession
    order = F.col("source").asc_nulls_last()
    placed = sources.repartitionByRange(common.shuffle_partitions(spark), order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id())
    placed = common.materialize(placed, "sources")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    starts = dict(zip((r.part for r in counts), itertools.accumulate([0, *(r.n for r in counts)]), strict=False))
    if not starts:
        return sources.withColumn("target", F.lit(0.0))
    start = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))[part]
    weight = F.array(*(F.lit(float(w)) for w in weights))[F.pmod(F.col("at") - F.shiftleft(part, 33) + start, F.lit(len(weights))).cast("int")]
    weighted = common.materialize(placed.select("source", "size", weight.alias("weight")), "weights")
    total, share = weighted.agg(F.sum("size"), F.sum("size") / F.sum("weight")).first()
    full, before = cap * F.col("size"), -1
    while True:  # the share of a weight of one only rises
        over = F.lit(share) * F.col("weight") > full
        r = weighted.agg(F.count_if(over).alias("n"), F.sum(F.when(over, full).otherwise(0.0)).alias("held"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if r.n == before or not r.free:
            return weighted.select("source", "size", F.least(full, F.lit(share) * F.col("weight")).alias("target"))
        before, share = r.n, (total - r.held) / r.free


def _fitting(words: Sequence[int], room: float) -> tuple[list[int], float]:
    """The places of those that fit in what the ones before leave of the room, and what is left of it."""
    out = []
    for i, n in enumerate(words):
        if n <= room:
            out.append(i)
            room -= n
    return out, room


_PICKS = "array<struct<seed: bigint, of: bigint, buckets: array<bigint>>>"
_PLAN = "source string, source_size long, target double, passes int, order array<int>, n_full int, gap double"


def _first_plans(blocks: DataFrame, cap: float, seed: int, groups: int) -> DataFrame:
    """A row a source: its passes, its blocks in the order of their draws, how many of them the last, partial pass
    takes whole, and the words that it misses then; from (source, block, words, size, target)."""

    def plan(source: str | None, words: dict[int, int], size: int, target: float) -> dict:
        passes = min(math.floor(target / size + 1e-12), math.floor(cap)) if size else 0
        rest = max(0.0, target - passes * size)
        rng = np.random.default_rng([seed, source is None, *(source or "").encode()])
        order = rng.permutation(sorted(words)).tolist()
        # A block's room stays free, for single documents that fit well.
        chosen, _ = _fitting([words[b] for b in order], rest - float(np.median(list(words.values())))) if rest >= 1 else ([], 0)
        held = set(chosen)
        order = [order[i] for i in chosen] + [b for i, b in enumerate(order) if i not in held]
        return {"source": source, "source_size": size, "target": target, "passes": passes, "order": order, "n_full": len(chosen), "gap": rest - sum(words[b] for b in order[: len(chosen)])}

    schema = pa.schema([("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("passes", pa.int32()), ("order", pa.list_(pa.int32())), ("n_full", pa.int32()), ("gap", pa.float64())])

    def plans(table: pa.Table) -> pa.Table:
        found: dict[str | None, tuple[dict[int, int], int, float]] = {}
        for source, block, words, size, target in zip(*(table[c].to_pylist() for c in ("source", "block", "words", "size", "target")), strict=True):
            found.setdefault(source, ({}, size, target))[0][block] = words
        return pa.Table.from_pylist([plan(source, *x) for source, x in found.items()], schema)

    return blocks.groupBy(F.pmod(F.xxhash64("source"), F.lit(groups))).applyInArrow(plans, _PLAN)


def _bucket(seed: Column, of: Column) -> Column:
    return F.pmod(F.xxhash64(seed, F.col("_h")), of)


def _planned(frame: DataFrame, plan: DataFrame, blocks: int, broadcast: bool) -> DataFrame:
    """Rows with ``_source`` and ``_h`` beside their source's plan, and whether the last, partial pass takes them."""
    plan = plan.select(*(F.col(c).alias(f"_p_{c}") for c in plan.columns))
    same = F.col("_source").eqNullSafe(F.col("_p_source"))
    if broadcast:
        out = frame.join(F.broadcast(plan), same)  # PLAN_BYTES at most
    else:
        copies = plan.withColumn("_p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = frame.withColumn("_salt", F.pmod(F.xxhash64(F.lit(SALTS), "_h"), F.lit(SALTS)).cast("int")).join(copies.hint("merge"), same & (F.col("_salt") == F.col("_p_salt"))).drop("_salt", "_p_salt")
    rank = F.array_position("_p_order", F.pmod("_h", F.lit(blocks)).cast("int")) - 1
    inside = F.exists("_p_picks", lambda p: F.array_contains(p["buckets"], _bucket(p["seed"], p["of"])))
    return out.withColumn("_rank", rank).withColumn("_full", F.col("_rank") < F.col("_p_n_full")).withColumn("_part", ~F.col("_full") & (F.array_contains("_p_extra", F.col("_h")) | inside))


def _close_gaps(sized: DataFrame, plans: DataFrame, blocks: int, seed: int, broadcast: bool) -> DataFrame:
    """Plans with documents outside the whole blocks, added until none that is left fits what a source misses."""
    plans = plans.withColumns({"picks": F.expr(f"cast(array() AS {_PICKS})"), "extra": F.expr("cast(array() AS array<bigint>)"), "open": F.col("gap") >= 1})
    plans = common.materialize(plans, "plans")
    # Rows of one hash are taken together, so they count together.
    units = _planned(sized.where(F.col("_size") > 0), plans.where("open"), blocks, broadcast).where(~F.col("_full")).groupBy("_source", "_h").agg(F.sum("_size").alias("_size"))
    units = common.materialize(units, "units")
    for turn in itertools.count(1):
        if plans.where("open").isEmpty():
            return plans.drop("open")
        left = _planned(units, plans.where("open"), blocks, broadcast).where(~F.col("_part"))
        fits, unit = F.col("_size") <= F.col("_p_gap"), F.struct(F.col("_size").alias("size"), F.col("_h").alias("h"))
        found = left.groupBy(F.col("_source").alias("f_source")).agg(F.sum(F.when(fits, F.col("_size"))).alias("words"), F.count_if(~fits).alias("n_large"), F.max(F.when(fits, unit)).alias("best"), F.min(F.when(~fits, unit)).alias("over"))
        stated = plans.join(found, F.col("open") & F.col("source").eqNullSafe(F.col("f_source")), "left").drop("f_source")
        # About four buckets of fitting documents fill the gap, and most hold none that is too large.
        of = F.when(F.col("gap") > 2 * F.col("best.size"), F.greatest(F.lit(1), F.ceil(4 * F.col("words") / F.col("gap")), 2 * F.col("n_large")))
        stated = common.materialize(stated.withColumn("of", of.cast("long")), "stated")
        key = F.lit((seed << 16) + turn).cast("long")
        rules = stated.where(F.col("of").isNotNull()).select("source", "gap", "of", "order", "n_full", "picks", "extra")
        dealt = _planned(units, rules, blocks, broadcast).where(~F.col("_part")).groupBy("_source", F.col("_p_gap").alias("room"), _bucket(key, F.col("_p_of")).alias("bucket")).agg(F.sum("_size").alias("words")).where("words <= room")
        first = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("_source").orderBy("bucket"))).where(F.col("nth") <= blocks)
        buckets = first.groupBy(F.col("_source").alias("b_source")).agg(F.sort_array(F.collect_list(F.struct("bucket", "words"))).alias("dealt"))  # ``blocks`` a source at most
        # The largest one's room stays free.
        chosen = F.expr("aggregate(dealt, named_struct('room', gap - best.size, 'took', cast(array() AS array<bigint>)), (a, x) -> CASE WHEN x.words <= a.room THEN named_struct('room', a.room - x.words, 'took', concat(a.took, array(x.bucket))) ELSE a END)")
        both = stated.join(buckets, F.col("of").isNotNull() & F.col("source").eqNullSafe(F.col("b_source")), "left").drop("b_source").withColumn("chosen", chosen)
        bulk = F.coalesce(F.size("chosen.took") > 0, F.lit(False))
        last = F.col("best").isNull() & F.coalesce(F.col("over.size") < 2 * F.col("gap"), F.lit(False))  # the last one, closer than none
        single = ~bulk & F.col("best").isNotNull()
        moved = both.select(
            "source", "source_size", "target", "passes", "order", "n_full",
            F.when(bulk, F.col("chosen.room") + F.col("best.size")).when(single, F.col("gap") - F.col("best.size")).when(last, F.col("gap") - F.col("over.size")).otherwise(F.col("gap")).alias("gap"),
            F.when(bulk, F.concat("picks", F.array(F.struct(key.alias("seed"), F.col("of"), F.col("chosen.took").alias("buckets"))))).otherwise(F.col("picks")).alias("picks"),
            F.when(single, F.concat("extra", F.array("best.h"))).when(last, F.concat("extra", F.array("over.h"))).otherwise(F.col("extra")).alias("extra"),
            F.col("best").isNotNull().alias("more"),
        )
        plans = common.materialize(moved.withColumn("open", F.col("more") & (F.col("gap") >= 1)).drop("more"), "plans")


def _dealt_to_shards(plans: DataFrame, shards: int, seed: int) -> DataFrame:
    """Plans with ``cuts``: the ends of the ranges of a source's draws, and the shards that have them."""
    quota = F.col("passes") * F.size("order") + F.col("n_full") + (F.size("picks") + F.size("extra") > 0).cast("int")
    plans = plans.withColumn("quota", quota.cast("long")).withColumn("group", F.pmod(F.xxhash64("source"), F.lit(SOURCE_GROUPS)).cast("int"))
    groups = plans.groupBy("group").agg(F.sum("quota").alias("quota")).orderBy("group").collect()  # SOURCE_GROUPS rows at most
    draws = split_quotas([r.quota for r in groups], shards, seed)
    upper = {r.group: draws[:, i] for i, r in enumerate(groups)}
    schema = pa.schema([("c_source", pa.string()), ("cuts", pa.list_(pa.struct([("end", pa.int64()), ("shard", pa.int32())])))])

    def lower(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        listed = sorted(zip(table["source"].to_pylist(), table["quota"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or ""))
        leaves = split_draws(upper[group], [q for _, q in listed], np.random.default_rng([seed, group]))
        out = []
        for (source, _), leaf in zip(listed, leaves, strict=True):
            at = np.flatnonzero(leaf)
            out.append({"c_source": source, "cuts": [{"end": e, "shard": s} for e, s in zip(np.cumsum(leaf[at]).tolist(), at.tolist(), strict=True)]})
        return pa.Table.from_pylist(out, schema)

    cuts = plans.select("group", "source", "quota").groupBy("group").applyInArrow(lower, "c_source string, cuts array<struct<end: bigint, shard: int>>")
    return plans.join(cuts, F.col("source").eqNullSafe(F.col("c_source"))).drop("c_source", "group")


def _prepared(docs: DataFrame, id_column: str, source_column: str, text_column: str) -> DataFrame:
    """Each document whole in ``_row``, beside its source and hash."""
    keys = [F.col(id_column), F.col(source_column).cast("string"), F.col(text_column).cast("string")]
    return docs.select(F.struct(*common.columns(docs)).alias("_row"), keys[1].alias("_source"), F.xxhash64(*keys).alias("_h"))


def document_sizes(docs: DataFrame, *, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(_id, _source, _h, _size): numbers of words, written once to the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            n = pa.array([len(t.split()) for t in batch.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], n], ["_id", "_source", "_h", "_size"])

    kept = _prepared(docs, id_column, source_column, text_column).select(F.col(f"_row.{id_column}").alias("_id"), "_source", "_h", F.coalesce(F.col(f"_row.{text_column}").cast("string"), F.lit("")).cast("binary").alias("t"))
    return common.materialize(kept.mapInArrow(count, f"_id {dict(docs.dtypes)[id_column]}, _source string, _h long, _size long"), "sizes")


def _draws(frame: DataFrame, plan: DataFrame, blocks: int, seed: int, broadcast: bool) -> DataFrame:
    """``_draws``: for each time that a shard draws the row, the shard and the row's place in it."""
    out = _planned(frame, plan, blocks, broadcast)
    n_blocks, passes = F.size("_p_order"), F.col("_p_passes")
    before = F.when(passes > 0, F.transform(F.sequence(F.lit(0), F.greatest(passes - 1, F.lit(0))), lambda i: i * n_blocks + F.col("_rank"))).otherwise(F.array().cast("array<long>"))
    last = passes * n_blocks + F.when(F.col("_full"), F.col("_rank")).otherwise(F.col("_p_n_full").cast("long"))
    draws = F.concat(before, F.when(F.col("_full") | F.col("_part"), F.array(last)).otherwise(F.array().cast("array<long>")))
    owner = lambda j: F.element_at(F.filter("_p_cuts", lambda c: c["end"] > j), 1)["shard"]
    return out.withColumn("_draws", F.transform(draws, lambda j: F.struct(owner(j).alias("shard"), F.xxhash64(F.lit(seed), j, F.col("_h")).alias("place"), j.alias("draw"))))


class Mix:
    """A planned mix of ``docs``: the plans (a row a source) once made, its draws can be listed or counted."""

    def __init__(self, docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, blocks: int = 1024, shards: int | None = None, seed: int = 17, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text"):
        self.docs, self.blocks, self.seed = docs, blocks, seed
        self.columns = {"id_column": id_column, "source_column": source_column, "text_column": text_column}
        self.sized = document_sizes(docs, **self.columns)
        by_block = self.sized.groupBy(F.col("_source").alias("source"), F.pmod("_h", F.lit(blocks)).cast("int").alias("block")).agg(F.sum("_size").alias("words"))
        by_block = common.materialize(by_block, "blocks")
        sources = by_block.groupBy("source").agg(F.sum("words").alias("size"))
        goals = common.materialize(with_targets(sources, weights, cap), "targets").withColumnRenamed("source", "g_source")
        n_sources, words = goals.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
        first = _first_plans(by_block.join(goals, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source"), cap, seed, max(1, -(-n_sources // TASK_SOURCES)))
        first = common.materialize(first, "plans")
        self.shards = shards or min(MOST_SHARDS, max(1, math.ceil(words / SHARD_WORDS)))
        self.parts = max(1, math.ceil(words / SHARD_WORDS / self.shards))
        # A row's blocks, cuts and picked buckets, the last as many as blocks in a few rounds.
        self.broadcast = (first.agg(F.sum(64 + 20 * F.size("order") + 16 * F.least(F.size("order"), F.lit(self.shards)))).first()[0] or 0) <= PLAN_BYTES
        closed = _close_gaps(self.sized, first, blocks, seed, self.broadcast)
        self.plans = common.materialize(_dealt_to_shards(closed, self.shards, seed), "plans")

    def _drawn(self, frame: DataFrame) -> DataFrame:
        return _draws(frame, self.plans, self.blocks, self.seed, self.broadcast)

    def counts(self) -> DataFrame:
        """Per document: its id, size, source_size, target and taken (words that the shards draw of it, repeats counted)."""
        times = F.size(F.filter("_draws", lambda d: d["shard"].isNotNull()))
        return self._drawn(self.sized).select(F.col("_id").alias(self.columns["id_column"]), F.col("_size").alias("size"), F.col("_p_source_size").alias("source_size"), F.col("_p_target").alias("target"), (F.col("_size") * times).alias("taken"))

    def rows(self) -> DataFrame:
        """``_row`` (a whole document), ``shard``, ``place`` and ``draw``, once for each draw."""
        return self._drawn(_prepared(self.docs, **self.columns)).select("_row", F.explode("_draws").alias("_draw")).select("_row", "_draw.*").where(F.col("shard").isNotNull())

    def shuffled(self) -> DataFrame:
        """The drawn documents, with their own columns, dealt to their shards and shuffled locally; a partition a part of a shard."""
        half = F.lit(float(1 << 63))
        part = F.least(F.floor((F.col("place").cast("double") + half) / (2 * half) * self.parts), F.lit(self.parts - 1))
        dealt = self.rows().withColumn("_part", (F.col("shard") * self.parts + part).cast("int"))
        return dealt.repartitionById(self.shards * self.parts, "_part").sortWithinPartitions("_part", "place").select("_row.*")
