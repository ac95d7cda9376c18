"""Registered queries on losses, laws, allocation, gates and the budgeted system, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import derive
from ..operators import exact
from ..operators.base import CARDINALITY, FREQUENCY, HEAVY_HITTERS, QUANTILE, Query
from ..operators.cardinality import HyperLogLog, KMinimumValues
from ..operators.frequency import CountMin
from ..operators.heavy_hitters import FirstKeysTop
from ..operators.quantile import CentroidDigest, NativeKll, ReservoirQuantile
from ..sources.generate import StreamSpec
from .adaptive import BudgetedSystem
from .allocate import Context, FrozenOptimum, GridSearch, PerSegment, UniformIfDegenerate, WaterFilling
from .calibrate import count_spread, rank_errors
from .catalog import _CORE, _IN_ORDER, _LAWS, _ORDER_KEYS, ORACLE_SQL, SEED, _orders, _plan, _rows, _smallest_sql, events, hash_sql, lineitem, query
from .experiment import run_experiment
from .gates import gates_of
from .laws import ErrorLaw, fit_error_law, fit_error_laws
from .score import cardinality_loss, frequency_loss, heavy_hitter_loss, quantile_loss

# --- allocation ---

query("alloc_per_segment", ORACLE_SQL["alloc_grid"])(_plan(PerSegment()))
query("alloc_frozen", ORACLE_SQL["alloc_grid"])(_plan(FrozenOptimum()))
query("alloc_fallback_kept", ORACLE_SQL["alloc_grid"])(_plan(UniformIfDegenerate(GridSearch())))


@query("alloc_fallback", _rows(("shared", 342), ("quantile", 341), ("heavy", 341)))
def alloc_fallback(s: SparkSession, d: str) -> DataFrame:
    """A degenerate law makes the plan uniform."""
    laws = _LAWS | {QUANTILE: ErrorLaw(1.0, 0.0, 0.0, 0.0, 2, 0, True, "fewer than 4 positive budgets")}
    return s.createDataFrame(list(UniformIfDegenerate(GridSearch()).allocate(laws, 1024, Context()).items()), "module string, bytes long")


def _water_sql(budget: int, rounds: int) -> str:
    """Rounds of largest-remainder plans and gains, as a recursion over the three modules' gains."""
    share = lambda m: f"(g{m} / (gs + gq + gh) * {budget}.0::DOUBLE)"
    whole = f"SELECT i, {', '.join(f'floor({share(m)}) AS w{m}, {share(m)} - floor({share(m)}) AS f{m}' for m in 'sqh')} FROM r"
    more = {"s": "(fq > fs)::INT + (fh > fs)::INT", "q": "(fs >= fq)::INT + (fh > fq)::INT", "h": "(fs >= fh)::INT + (fq >= fh)::INT"}
    plan = lambda source: f"SELECT i, {', '.join(f'w{m} + ({more[m]} < {budget} - ws - wq - wh)::INT AS {m}' for m in 'sqh')} FROM ({source})"
    gain = lambda c, m: f"{c}::DOUBLE * greatest(CASE WHEN {m} <= 0 THEN 3.0 ELSE 3.0::DOUBLE * pow({m}, -{c}::DOUBLE) END, 1e-9) / greatest(1, {m}) * 0.25::DOUBLE"
    step = f"SELECT i + 1, {gain(0.5, 's')} + {gain(0.35, 's')}, {gain(0.7, 'q')}, {gain(0.3, 'h')} FROM ({plan(whole)}) WHERE i < {rounds}"
    return f"""WITH RECURSIVE r(i, gs, gq, gh) AS (SELECT 0, 0.25::DOUBLE * 0.5 + 0.25::DOUBLE * 0.35, 0.25::DOUBLE * 0.7, 0.25::DOUBLE * 0.3 UNION ALL {step}),
        p AS (SELECT * FROM ({plan(whole)}) WHERE i = {rounds})
        SELECT 'shared' AS module, s::BIGINT AS bytes FROM p UNION ALL SELECT 'quantile', q::BIGINT FROM p UNION ALL SELECT 'heavy', h::BIGINT FROM p"""


query("alloc_water_filling", _water_sql(1024, 14))(_plan(WaterFilling()))

# --- losses and laws ---

_RANK_SQL = f"SELECT avg((value <= (SELECT quantile_cont(value, 0.5) FROM (SELECT * FROM ({hash_sql(_IN_ORDER, 'event_id', derive(SEED, 'reservoir'))}) ORDER BY h LIMIT 256)))::DOUBLE) FROM events WHERE value IS NOT NULL"


@query(
    "family_losses",
    f"""SELECT 'cardinality' AS family, round(abs((SELECT value FROM ({_smallest_sql(hash_sql(_ORDER_KEYS, 'key', derive(SEED, 'kmv')), 256)})) - n) / n, 6) AS loss FROM (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem)
    UNION ALL SELECT 'quantile', round(abs(({_RANK_SQL}) - 0.5), 6)
    UNION ALL SELECT 'frequency', round(abs((SELECT value FROM ({ORACLE_SQL['cm_point']}) WHERE key = 7) - n) / greatest(n, 1), 6) FROM (SELECT count(*) AS n FROM lineitem WHERE l_partkey = 7)
    UNION ALL SELECT 'heavy_hitters', round(value, 6) FROM ({ORACLE_SQL['hh_f1']})""",
)
def family_losses(s: SparkSession, d: str) -> DataFrame:
    """The four losses of sketches whose states SQL can recompute."""
    one = lambda df: df.first().value
    o, e, parts = _orders(s, d), events(s, d), lineitem(s, d)
    keys = lambda df: {r.key for r in df.collect()}  # noqa: E731  ten rows
    median = one(ReservoirQuantile(256, seed=SEED).estimate(e, Query(QUANTILE, q=0.5)))
    losses = {
        CARDINALITY: cardinality_loss(one(KMinimumValues(256, seed=SEED).estimate(o, Query(CARDINALITY))), one(exact.cardinality(o))),
        QUANTILE: quantile_loss(one(exact.rank(e, median)), 0.5),
        FREQUENCY: frequency_loss(one(CountMin(10, seed=SEED).estimate(parts, Query(FREQUENCY, key=7))), one(exact.frequency(parts, 7))),
        HEAVY_HITTERS: heavy_hitter_loss(keys(FirstKeysTop(100).estimate(e, Query(HEAVY_HITTERS, top_k=10))), keys(exact.top_k(e, 10))),
    }
    return s.createDataFrame([(f, round(x, 6)) for f, x in losses.items()], "family string, loss double")


@query(
    "law_predictions",
    """WITH p AS (SELECT l_linestatus AS family, ln(l_quantity) AS x, ln(greatest(l_extendedprice / 100000, 1e-6)) AS y, l_extendedprice / 100000 AS e FROM lineitem WHERE l_quantity > 0),
    f AS (SELECT family, exp(regr_intercept(y, x)) AS a, -regr_slope(y, x) AS c, CASE WHEN regr_syy(y, x) = 0 THEN 0 ELSE regr_r2(y, x) END AS r2, min(e) AS floor FROM p GROUP BY 1)
    SELECT family, budget, round(greatest(a * pow(budget, -c), floor), 6) AS predicted, CASE WHEN c <= 0 THEN 'error does not fall' WHEN r2 < 0.9 THEN 'poor fit' ELSE '' END AS reason
    FROM f, (VALUES (16.0::DOUBLE), (64.0::DOUBLE)) b(budget)""",
)
def law_predictions(s: SparkSession, d: str) -> DataFrame:
    points = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linestatus").alias("family"), F.col("l_quantity").alias("budget"), (F.col("l_extendedprice") / 100000).alias("error"))
    asked = F.explode(F.array(F.lit(16.0), F.lit(64.0))).alias("budget")
    laws = fit_error_laws(points).select("*", asked)
    return laws.select("family", "budget", F.round(F.greatest(F.col("a") * F.pow("budget", -F.col("c")), F.col("floor")), 6).alias("predicted"), "reason")


# --- gates ---

_RUNS = "SELECT l_linestatus AS batch, 0.5 + 4 * l_discount AS ratio, 1.0::DOUBLE + l_tax / 8 AS segment_ratio, 0.9 + l_discount / 2 AS ablation, 0.5 + 4 * l_discount + l_tax / 4 AS predicted FROM lineitem"


@query(
    "gates_recorded",
    f"""SELECT *, g1 AND g2 AND g3 AND g4 AND g_ablation AS passed FROM (
    SELECT round(max(ratio), 6) AS max_ratio, round(avg(ratio), 6) AS mean_ratio, round(avg(segment_ratio), 6) AS segment, round(avg(predicted), 6) AS predicted, round(avg(ablation), 6) AS ablation,
    max(ratio) < 1 AS g1, avg(ratio) <= 0.85 AS g2, avg(segment_ratio) <= 1.02 AS g3, abs(avg(predicted) - avg(ratio)) <= 0.03 AS g4, avg(ablation) <= 0.95 AS g_ablation FROM ({_RUNS}))""",
)
def gates_recorded(s: SparkSession, d: str) -> DataFrame:
    """The gates over recorded runs: rows made of the line items' columns."""
    x = s.read.parquet(f"{d}/lineitem.parquet")
    discount, tax = F.col("l_discount"), F.col("l_tax")
    runs = x.select((0.5 + 4 * discount).alias("ratio"), (1.0 + tax / 8).alias("segment_ratio"), (0.9 + discount / 2).alias("ablation"), (0.5 + 4 * discount + tax / 4).alias("predicted"))
    found = gates_of(runs)
    return found.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes))


@query("gate_experiment_all")
def gate_experiment_all(s: SparkSession, d: str) -> DataFrame:
    """All cells of the experiment: nine kinds of streams, two budgets and twenty seeds, with the gates over them."""
    from ..sources.generate import KINDS

    return gates_of(run_experiment(s, KINDS, [1024, 4096], [1000 + 7 * i for i in range(20)], n=3_000, domain=50_000, streams=2))


# --- the budgeted system ---

_SYSTEM = BudgetedSystem(4096, GridSearch(), _LAWS, seed=SEED)
_K = _SYSTEM.modules["shared"].size
_KEPT_USERS = f"SELECT * FROM ({_CORE.replace('l_orderkey', 'user_id').replace('FROM lineitem', 'FROM events WHERE user_id IS NOT NULL')}) ORDER BY h LIMIT {_K}"


@query(
    "budgeted_system",
    f"""SELECT 'cardinality' AS family, round(value, 6) AS value FROM ({_smallest_sql(_CORE.replace('l_orderkey', 'user_id').replace('FROM lineitem', 'FROM events WHERE user_id IS NOT NULL'), _K)})
    UNION ALL SELECT 'frequency', coalesce((SELECT count FROM ({_KEPT_USERS}) k WHERE k.key = t.key), 0)::DOUBLE FROM (SELECT user_id AS key, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) t""",
)
def budgeted_system(s: SparkSession, d: str) -> DataFrame:
    """Distinct users and the heaviest user's frequency from the shared module, sized by the plan of 4,096 bytes."""
    e = events(s, d)
    states = _SYSTEM.states(e)
    heaviest = exact.top_k(e, 1).first().key
    ask = lambda family, q: _SYSTEM.estimate(states, q).select(F.lit(family).alias("family"), F.round(F.col("value").cast("double"), 6).alias("value"))
    return ask(CARDINALITY, Query(CARDINALITY)).unionByName(ask(FREQUENCY, Query(FREQUENCY, key=heaviest)))


@query(
    "budgeted_system_losses",
    "SELECT family, true AS within FROM (VALUES ('cardinality'), ('quantile'), ('frequency'), ('heavy_hitters')) t(family)",
)
def budgeted_system_losses(s: SparkSession, d: str) -> DataFrame:
    """All four losses of the system against exact answers, each within what its family may lose at 4,096 bytes."""
    most = {CARDINALITY: 0.3, QUANTILE: 0.1, FREQUENCY: 1.0, HEAVY_HITTERS: 1.0}
    return s.createDataFrame([(f, bool(0 <= x <= most[f])) for f, x in _SYSTEM.losses(events(s, d)).items()], "family string, within boolean")

# --- calibration ---


@query("calibrate_registers", "SELECT size, true AS within FROM (VALUES (8), (10), (12)) t(size)")
def calibrate_registers(s: SparkSession, d: str) -> DataFrame:
    """The spread of register counts over 24 streams of 20,000 keys, within 0.6 and 1.5 times what theory says."""
    found = count_spread(s, lambda p: HyperLogLog(p, seed=SEED), (8, 10, 12), 20_000, 24, SEED)
    theory = 1.04 / F.sqrt(F.pow(F.lit(2.0), F.col("size")))
    return found.select("size", (F.col("sd") / theory).between(0.6, 1.5).alias("within"))


@query("calibrate_quantiles", "SELECT 'native_kll' AS sketch, true AS falls, true AS within UNION ALL SELECT 'centroid_digest', true, true")
def calibrate_quantiles(s: SparkSession, d: str) -> DataFrame:
    """How fast rank errors fall with size (as a power between 0.5 and 1.6), and whether they stay below what a size promises."""
    spec, rows = StreamSpec("uniform", 8_000, 1_000_000, SEED), []
    for name, make, sizes, most in (("native_kll", NativeKll, (32, 64, 128, 256), lambda k: 4 * 2.296 / k**0.9723), ("centroid_digest", CentroidDigest, (4, 5, 6, 7), lambda e: 4 / (1 << e))):
        errors = rank_errors(s, make, sizes, spec, 8, (0.25, 0.5, 0.75)).collect()  # a row a size
        law = fit_error_law([float(r["size"] if name == "native_kll" else 1 << r["size"]) for r in errors], [max(r["mean"], 1e-6) for r in errors])
        rows.append((name, bool(0.4 <= law.c <= 2.5), all(r["most"] <= most(r["size"]) for r in errors)))
    return s.createDataFrame(rows, "sketch string, falls boolean, within boolean")
