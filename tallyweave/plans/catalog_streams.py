"""Registered queries on sources, generated streams, hashes of keys and running sketches, and their SQL."""

from __future__ import annotations

import math
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import derive, hashed
from ..operators.base import CARDINALITY, Query
from ..operators.cardinality import HyperLogLog
from ..runtime import scratch_dir
from ..sources import files
from ..sources.generate import HEAD, KINDS, StreamSpec, _mixture, generate_native
from ..streaming.running import RunningSketch, windowed_counts
from .catalog import SEED, Make, _hll_sql, _round_sql, _rounded, hash_sql, query

# --- files ---

_LOADED = "SELECT count(*) AS n, count(DISTINCT user_id) AS domain, sum(user_id)::BIGINT AS keys, round(sum(value), 4) AS total, arg_min(user_id, event_id) AS first_key, arg_max(user_id, event_id) AS last_key, true AS dense FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL"


def _loaded(kind: str) -> Make:
    """Events written in four files (an array: one) in their order and loaded again; ``seq`` must be that order, from 0 without gaps."""

    def ask(s: SparkSession, d: str) -> DataFrame:
        rows = s.read.parquet(f"{d}/events.parquet").where("value IS NOT NULL AND user_id IS NOT NULL")
        rows = rows.select("event_id", F.col("user_id").alias("key"), "value")
        where = scratch_dir(s)
        if kind == "npy":
            table = rows.orderBy("event_id").toArrow()  # an array file is one machine's
            where = str(Path(tempfile.mkdtemp(prefix="tallyweave-")) / "events.npy")
            np.save(where, np.rec.fromarrays([table["key"].to_numpy(), table["value"].to_numpy()], names="key,value"))
        else:
            out = rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").drop("event_id").write
            {"csv": out.option("header", True).csv, "jsonl": out.json, "parquet": out.parquet}[kind](where)
        loaded = files.load(s, where, fmt=kind)
        about = files.describe(loaded)
        n, domain, dense = F.count("*").alias("n"), F.lit(about["domain"]).cast("long").alias("domain"), (F.countDistinct("seq") == F.max("seq") + 1).alias("dense")
        return loaded.agg(n, domain, F.sum("key").alias("keys"), F.round(F.sum("value"), 4).alias("total"), F.min_by("key", "seq").alias("first_key"), F.max_by("key", "seq").alias("last_key"), dense)

    return ask


for _kind in ("csv", "jsonl", "npy", "parquet"):
    query(f"load_{_kind}", _LOADED)(_loaded(_kind))

# --- generated streams ---


def _native_sql(s: StreamSpec) -> str:
    """Keys and their counts of a native stream, from hashes of the row number."""
    source = f"SELECT range AS seq FROM range(0, {s.n})"
    for name in ("u", "v", "w", "m"):
        source = f"SELECT * EXCLUDE (h), (h >> 11)::DOUBLE / 9007199254740992.0::DOUBLE AS {name} FROM ({hash_sql(source, 'seq', derive(s.seed, f'native:{name}'))})"

    def zipf(u: str, alpha: float) -> str:
        head = np.cumsum(np.arange(1, min(HEAD, s.domain) + 1, dtype=np.float64) ** -alpha)
        primitive = (lambda t: math.log(t)) if abs(alpha - 1) < 1e-9 else (lambda t: t ** (1 - alpha) / (1 - alpha))
        start, rest = primitive(HEAD + 0.5), primitive(s.domain + 0.5) - primitive(HEAD + 0.5) if s.domain > HEAD else 0.0
        reached = (head / (head[-1] + rest)).tolist()
        rank = f"len(list_filter([{', '.join(f'{x!r}::DOUBLE' for x in reached)}], lambda c: c <= {u}))"
        if not rest:
            return f"least({rank}, {len(reached) - 1})"
        at = f"({start!r}::DOUBLE + ({u} - {reached[-1]!r}::DOUBLE) / {1 - reached[-1]!r}::DOUBLE * {rest!r}::DOUBLE)"
        inverse = f"exp({at})" if abs(alpha - 1) < 1e-9 else f"pow({at} * {1 - alpha!r}::DOUBLE, {1 / (1 - alpha)!r}::DOUBLE)"
        return f"CASE WHEN {u} < {reached[-1]!r}::DOUBLE THEN {rank} ELSE least(greatest(floor({inverse} + 0.5), {HEAD + 1}), {s.domain}) - 1 END"

    below = lambda u, hi: f"floor({u} * {hi})"
    weights, centres, spread = _mixture(s, np.random.default_rng(derive(s.seed, "native:mixture")))
    made = [f"{c!r}::DOUBLE + {d!r}::DOUBLE * (sqrt(-2 * ln(1 - v)) * cos({2 * math.pi!r}::DOUBLE * w))" for c, d in zip(centres.tolist(), spread.tolist(), strict=True)]
    reached, picks = 0.0, ""
    for share, x in zip(weights.tolist(), made, strict=True):
        reached += share
        picks += f"WHEN u < {reached!r}::DOUBLE THEN {x} "
    key = {
        "uniform": below("u", s.domain),
        "zipf": zipf("u", s.zipf_alpha),
        "pareto": f"least(floor(pow(1 - u, {-1 / s.zipf_alpha!r}::DOUBLE) - 1), {s.domain - 1})",
        "gmm": f"least(greatest(round_even(CASE {picks}ELSE {centres.tolist()[-1]!r}::DOUBLE END, 0), 0), {s.domain - 1})",
        "drift_abrupt": f"CASE WHEN seq < {s.n // 3} THEN {zipf('u', 1.0)} WHEN seq < {2 * (s.n // 3)} THEN {below('v', 10_000)} ELSE {zipf('w', 1.5)} + {s.domain + 10_000} END",
        "drift_gradual": f"CASE WHEN m < seq / {max(1, s.n - 1)}.0::DOUBLE THEN {below('v', s.domain)} + {s.domain} ELSE {zipf('u', max(1.0, s.zipf_alpha))} END",
        "low_card": below("u", 10),
        "high_card": "seq",
        "elephant_mice": f"CASE WHEN seq % 2 = 1 AND seq < {2 * (s.n // 2)} THEN {below('u', 5)} ELSE 5 + (seq + 1) // 2 END",
    }[s.kind]
    return f"SELECT key, count(*) AS n, round(max(ln(1 + abs(key::DOUBLE)) + 0.25 * sin(key * 0.017::DOUBLE)), 9) AS value FROM (SELECT ({key})::BIGINT AS key FROM ({source})) GROUP BY key"


def _native(spec: StreamSpec) -> Make:
    return lambda s, d: generate_native(s, spec).groupBy("key").agg(F.count("*").alias("n"), F.round(F.max("value"), 9).alias("value"))


for _kind in KINDS:
    _spec = StreamSpec(_kind, 3_000, 400, 7, zipf_alpha=1.2)
    query(f"stream_{_kind}", _native_sql(_spec))(_native(_spec))

# --- hashes of keys ---


@query("hash_index_sign", f"SELECT key, (h & 1023)::BIGINT AS idx, (2 * (h & 1)::INT - 1)::INT AS sign FROM ({hash_sql('SELECT s_suppkey AS key FROM supplier', 'key', SEED)})")
def hash_index_sign(s: SparkSession, d: str) -> DataFrame:
    h = hashed(s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("key")), "key", SEED, "h")
    bit = lambda mask: F.col("h").bitwiseAND(F.lit(mask).cast("long"))
    return h.select("key", bit(1023).alias("idx"), (2 * bit(1) - 1).cast("int").alias("sign"))


_WORDS = "SELECT p_brand, list_sum(list_transform(range(1, length(p_brand) + 1), lambda i: ascii(p_brand[i])::HUGEINT << (8 * (i - 1))::INT))::UBIGINT AS word FROM (SELECT DISTINCT p_brand FROM part WHERE length(p_brand) <= 8)"


@query("hash_text", f"SELECT p_brand, hex(h) AS hash FROM ({hash_sql(_WORDS, 'word', SEED)})")
def hash_text(s: SparkSession, d: str) -> DataFrame:
    """Hashes of texts of eight bytes at most, which are one word."""
    brands = s.read.parquet(f"{d}/part.parquet").where(F.length("p_brand") <= 8).select("p_brand").distinct()
    return hashed(brands, "p_brand", SEED, "h").select("p_brand", F.hex("h").alias("hash"))


# --- streams of files ---


@query("stream_running_hll", _round_sql(_hll_sql(10).replace("l_partkey", "user_id").replace("FROM lineitem", "FROM events WHERE user_id IS NOT NULL")))
def stream_running_hll(s: SparkSession, d: str) -> DataFrame:
    """Events read as a stream of four files, a running sketch merged batch by batch, and its estimate by a new object."""
    where = scratch_dir(s)
    rows = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), "value")
    rows.repartitionByRange(4, "seq").write.parquet(f"{where}/in")
    sketch = HyperLogLog(10, seed=SEED)
    source = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    run = source.writeStream.foreachBatch(RunningSketch(sketch, f"{where}/state").update).option("checkpointLocation", f"{where}/at").trigger(availableNow=True).start()
    run.awaitTermination()
    return _rounded(RunningSketch(sketch, f"{where}/state").estimate(s, Query(CARDINALITY)))


@query("stream_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(s: SparkSession, d: str) -> DataFrame:
    """Events an hour and type over event time, as a streaming aggregation with a watermark."""
    where = scratch_dir(s)
    rows = s.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows.write.parquet(f"{where}/in")
    source = s.readStream.schema(rows.schema).parquet(f"{where}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out")

    out = windowed_counts(source, "ts", "1 hour", "1 hour", "event_type").writeStream.outputMode("complete").foreachBatch(keep)
    out.option("checkpointLocation", f"{where}/at").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{where}/out").select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")
