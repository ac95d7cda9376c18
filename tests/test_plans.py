import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tallyweave import errors
from tallyweave.cli import main
from tallyweave.config import Config
from tallyweave.operators import all_sketches
from tallyweave.operators.base import CARDINALITY, FREQUENCY, HEAVY_HITTERS, QUANTILE, Query
from tallyweave.operators.heavy_hitters import SpaceSavingTop
from tallyweave.plans import gates, score
from tallyweave.plans.adaptive import BudgetedSystem
from tallyweave.plans.allocate import Context, FixedSplit, FrozenOptimum, GridSearch, PerSegment, Uniform, UniformIfDegenerate, WaterFilling, predicted_ratio, predicted_score
from tallyweave.plans.budget import BudgetPlan, fit_parameter, largest_remainder
from tallyweave.plans.experiment import gate, run_experiment
from tallyweave.plans.laws import ErrorLaw, crosscheck, fit_error_law, fit_error_laws
from tallyweave.runtime import PeakTracker, backend_available, env_probe, require_backend
from tallyweave.sources.generate import StreamSpec, generate
from tallyweave.sources.stream import Stream

LAWS = {f: ErrorLaw(3.0, c, 0.0, 1.0, 6) for f, c in ((CARDINALITY, 0.5), (QUANTILE, 0.7), (FREQUENCY, 0.35), (HEAVY_HITTERS, 0.3))}
BUDGETS = [64.0 * 2**i for i in range(6)]


def test_law_recovers_its_exponent(spark):
    errors_ = [3 * b**-0.7 for b in BUDGETS]
    law = fit_error_law(BUDGETS, errors_)
    assert law.c == pytest.approx(0.7, abs=1e-6) and law.r2 > 0.999 and not law.degenerate
    assert law.predict(256) == pytest.approx(3 * 256**-0.7) and law.predict(0) == law.a + law.floor
    assert crosscheck(law, BUDGETS, errors_) == pytest.approx((3, 0.7))
    rows = [("f", b, e) for b, e in zip(BUDGETS, errors_, strict=True)] + [("flat", b, 0.5) for b in BUDGETS] + [("up", b, b) for b in BUDGETS]
    found = {r.family: r for r in fit_error_laws(spark.createDataFrame(rows, "family string, budget double, error double")).collect()}
    assert found["f"].c == pytest.approx(0.7) and not found["f"].degenerate
    assert found["flat"].r2 == 0 and found["flat"].degenerate and found["up"].degenerate
    odd = {"one": [(5.0, 0.2)], "none": [(-1.0, 0.1)] * 3, "few": [(64.0, 0.3), (128.0, 0.2), (0.0, 0.9), (256.0, 0.1)], "equal": [(64.0, 0.1 * i) for i in range(1, 6)], "poor": list(zip(BUDGETS, [1, 3, 0.5, 2.5, 0.4, 2.0], strict=True)), "clamped": [(b, max(1e-6, 10 * b**-3)) for b in BUDGETS]}
    rows = [(f, float(b), float(e)) for f, points in odd.items() for b, e in points]
    for r in fit_error_laws(spark.createDataFrame(rows, "family string, budget double, error double")).collect():
        one = fit_error_law(*zip(*odd[r.family], strict=True))
        assert (r.reason, r.degenerate, r.n_points, r.n_points_clamped) == (one.reason, one.degenerate, one.n_points, one.n_points_clamped), r.family
        assert (r.a, r.c, r.floor, r.r2) == pytest.approx((one.a, one.c, one.floor, one.r2), abs=1e-9), r.family


def test_degenerate_laws():
    assert fit_error_law(BUDGETS, BUDGETS).reason == "error does not fall"
    assert fit_error_law(BUDGETS, [1, 3, 0.5, 2.5, 0.4, 2]).reason == "poor fit"
    assert fit_error_law([1], [1]).degenerate and fit_error_law([1, 2, 3], [1, 1, 1]).degenerate and fit_error_law([5] * 5, [1] * 5).degenerate
    assert fit_error_law(BUDGETS, [0.5] * 6).r2 == 0 and fit_error_law(BUDGETS, BUDGETS).elasticity() == 0


@given(st.lists(st.floats(0.01, 100), min_size=1, max_size=6), st.integers(0, 5000))
def test_rounding_is_exact(fractions, total):
    parts = largest_remainder(fractions, total)
    assert sum(parts) == total
    assert all(abs(p - f / sum(fractions) * total) < 1 + 1e-6 for p, f in zip(parts, fractions, strict=True))


def test_rounding_guards():
    for bad in ([0, 0], [math.inf, 1], [math.nan]):
        with pytest.raises(errors.IndistinguishableCostError):
            largest_remainder(bad, 10)


@pytest.mark.parametrize("budget", [256, 1024, 4096])
@pytest.mark.parametrize("strategy", [Uniform(), FixedSplit(), WaterFilling(), GridSearch(), PerSegment(), FrozenOptimum()], ids=lambda s: s.name)
def test_plans_spend_the_budget(strategy, budget):
    plan = strategy.allocate(LAWS, budget, Context())
    assert sum(plan.values()) == budget and min(plan.values()) >= 0


def test_strategies():
    c = Context()
    assert FixedSplit().allocate({}, 1024, c) == {"shared": 512, "quantile": 256, "heavy": 256}
    grid = GridSearch().allocate(LAWS, 1024, c)
    assert min(grid.values()) >= c.b_min
    assert predicted_score(grid, LAWS) <= predicted_score(FixedSplit().allocate(LAWS, 1024, c), LAWS)
    assert predicted_ratio(LAWS, 1024, c) <= 1
    bad = LAWS | {QUANTILE: ErrorLaw(1, 0, 0, 0, 0, 0, True, "x")}
    careful = UniformIfDegenerate(GridSearch())
    assert careful.allocate(bad, 1024, c) == Uniform().allocate(bad, 1024, c) and QUANTILE in careful.reason
    assert careful.allocate(LAWS, 1024, c) == grid and not careful.reason
    frozen = FrozenOptimum()
    kept = frozen.allocate(LAWS, 1024, c)
    assert frozen.allocate(bad, 1024, c) == kept
    frozen.reset()
    with pytest.raises(errors.InvalidConfigError):
        GridSearch().allocate(LAWS, 0, c)


def test_parameters_fit():
    for kind in all_sketches().values():
        for budget in (500, 5_000, 50_000):
            size = fit_parameter(kind, budget)
            lo, hi = kind.axis_range
            assert size == lo or kind.size_bytes(size, 2_000) <= budget
            assert size == hi or kind.size_bytes(size + 1, 2_000) > budget
    BudgetPlan({"a": 5, "b": 5}, 10, "x")
    for alloc, total in (({"a": 11}, 10), ({"a": -1}, 10), ({}, 0)):
        with pytest.raises(errors.InvalidConfigError):
            BudgetPlan(alloc, total, "x")


def test_losses(spark):
    assert score.cardinality_loss(90, 100) == pytest.approx(0.1) and score.cardinality_loss(5, 0) == 0
    assert score.frequency_loss(3, 0) == 3 and score.quantile_loss(0.4, 0.5) == pytest.approx(0.1)
    assert score.heavy_hitter_loss(set(), set()) == 0 and score.heavy_hitter_loss({1}, set()) == 1 and score.heavy_hitter_loss({1, 2}, {2, 3}) == 0.5
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key long")
    assert score.one_minus_f1(keys(1, 2), keys(2, 3)).first().value == 0.5 and score.one_minus_f1(keys(), keys()).first().value == 0
    assert score.gate_score({CARDINALITY: 0.05, QUANTILE: 0.02}) == pytest.approx(1)
    assert score.geometric_mean({"a": 2.0, "b": 8.0}, {"a": 3, "b": 1}) == pytest.approx(2 ** (6 / 4))
    assert score.MetricSpec("x").score(2) == -2 and score.MetricSpec("x", lower_is_better=False).score(2) == 2
    assert score.family_loss(QUANTILE, 0.4, None) == pytest.approx(0.1) and score.family_loss(HEAVY_HITTERS, {1}, {1}) == 0
    with pytest.raises(errors.MetricOutOfBoundsError):
        score.normalised({CARDINALITY: -1})


def test_gates_and_audits(spark):
    good = gates.evaluate_gates([0.7, 0.8], [1.0], [0.9], 0.75)
    assert good["passed"] and not good["notes"]
    bad = gates.evaluate_gates([1.2, 1.3], [1.0], [0.9], 1.25)
    assert not bad["g1"] and not bad["g2"] and bad["g4"] and not bad["passed"] and len(bad["notes"]) == 2
    assert not gates.evaluate_gates([], [], [], math.nan)["passed"]
    columns = "ratio double, segment_ratio double, ablation double, predicted double"
    for runs in ([(0.5, 1.0, 0.9, 0.5), (math.nan, 1.0, 0.9, 0.5)], [(0.7, 1.0, math.inf, 0.7)], [(0.9, 1.1, 0.9, 0.8)], [(0.5, 1.0, 0.9, 0.51)]):
        one = gates.evaluate_gates(*([r[i] for r in runs] for i in range(3)), runs[0][3])
        row = gates.gates_of(spark.createDataFrame(runs, columns)).first().asDict()
        assert all(one[k] is row[k] for k in ("g1", "g2", "g3", "g4", "g_ablation", "passed"))
    assert gates.vacuous_ratio([]) and gates.vacuous_ratio([8, 8]) and not gates.vacuous_ratio([8, 9])
    rows = spark.createDataFrame([(0.7, 1.0, 0.9, 0.75), (0.8, 1.0, 0.9, 0.75)], "ratio double, segment_ratio double, ablation double, predicted double")
    assert gates.gates_of(rows).first().passed
    a, b = {"x": 800, "y": 100, "z": 124}, {"x": 200, "y": 700, "z": 124}
    assert gates.allocation_separation(a, a).value == 1 and gates.allocation_separation(a, b).passed and gates.allocation_separation({"x": 0}, {"x": 5}).value == math.inf
    assert gates.budget_utilisation({"x": 900}, 1000).passed and gates.budget_utilisation({"x": 900}, 1000).vacuous
    assert gates.budget_response(1, 1.5).passed and not gates.budget_response(1, 1).passed and gates.budget_response(0, 1).vacuous
    assert gates.spend_parity(a, b).passed and not gates.spend_parity({"x": 1100}, {"x": 1000}).passed
    assert gates.method_parity({"a": "x"}, {"a": "x"}).passed and not gates.method_parity({"a": "x"}, {}).passed
    assert gates.within_bound({"deterministic": False, "value": 2, "declared_bound": 1}, 3) and not gates.within_bound({"deterministic": False, "value": 5, "declared_bound": 1}, 3) and gates.within_bound({}, 1)
    # What differs from run to run is left out where it stands, and what is random in records that say so.
    record = lambda at, took, drawn, kept: {"generated_at": at, "records": [{"elapsed_sec": took, "deterministic": False, "value": drawn, "bound": 2}, {"value": kept}]}
    assert gates.digest(record(1, 0.1, 5, 3)) == gates.digest(record(2, 0.7, 9, 3))
    for other in (record(1, 0.1, 5, 4), {"a": {"generated_at": 1}}):
        with pytest.raises(errors.DeterminismViolationError):
            gates.check_rerun(record(1, 0.1, 5, 3), other)
    with pytest.raises(errors.DeterminismViolationError):
        gates.check_rerun({"a": {"generated_at": 1}}, {"a": {"generated_at": 2}})


def test_budgeted_system(spark):
    s = Stream(generate(spark, StreamSpec("zipf", 4000, 3000, 1337)).cache())
    system = BudgetedSystem(4096, GridSearch(), LAWS, seed=1337, heavy=SpaceSavingTop)
    assert sum(system.plan.values()) == 4096
    states = system.states(s)
    for q in (Query(CARDINALITY), Query(QUANTILE), Query(FREQUENCY, key=0)):
        assert math.isfinite(system.estimate(states, q).first().value)
    losses = system.losses(s)
    assert set(losses) == set(LAWS) and all(0 <= v for v in losses.values())
    assert system.losses(s) == losses and system.score(s) == score.gate_score(losses)


def test_experiment(spark):
    runs = run_experiment(spark, ["uniform", "zipf"], [1024], [1337, 2000], n=2000, domain=5000, streams=2).cache()
    assert runs.count() == 4 and all(r.segment_ratio == 1 for r in runs.collect())
    report = gate(runs)
    assert report["mean_ratio"] < 0.85 and report["g2"] and report["g3"]


def test_config():
    c = Config.from_env({"TALLYWEAVE_SEED": "7", "TALLYWEAVE_BUDGETS": "1024, 2048", "TALLYWEAVE_N": "5", "TALLYWEAVE_NO_TIER0": "yes", "TALLYWEAVE_SAFETY": "2", "TALLYWEAVE_OUT_DIR": "o", "TALLYWEAVE_DETERMINISTIC_ONLY": "1"})
    assert (c.seeds, c.budgets_bytes, c.n, c.backend, c.safety, c.out_dir, c.deterministic_only) == ((7, 8, 9), (1024, 2048), 5, "tier1", 2.0, "o", True)
    with pytest.raises(errors.InvalidBackendModeError):
        Config(backend="x")
    for bad in ({"n": 0}, {"budgets_bytes": ()}, {"budgets_bytes": (0,)}, {"seeds": ()}, {"safety": 0}):
        with pytest.raises(errors.InvalidConfigError):
            Config(**bad)
    for env in ({"SEED": "x"}, {"N": ""}, {"BUDGETS": "a"}, {"DETERMINISTIC_ONLY": "maybe"}, {"N": "-1"}):
        with pytest.raises(errors.InvalidConfigError):
            Config.from_env({"TALLYWEAVE_" + k: v for k, v in env.items()})


def test_command_line(spark, capsys, tmp_path):
    assert main(["registry", "--query-type", QUANTILE]) == 0 and "centroid_digest" in capsys.readouterr().out
    assert main(["info"]) == 0 and "pyspark" in capsys.readouterr().out
    assert main(["demo", "--n", "2000"]) == 0 and "hyper_log_log" in capsys.readouterr().out
    assert main(["bench", "--datasets", "uniform", "--n", "600", "--domain", "900", "--out", str(tmp_path / "g.json"), "--runs", str(tmp_path / "runs")]) == 0
    assert capsys.readouterr().out.split()[0] in {"PASS", "FAIL"} and (tmp_path / "g.json").exists()
    assert spark.read.json(str(tmp_path / "runs")).count() == 1
    assert env_probe(spark)["parallelism"]
    assert backend_available() and require_backend() == "tier0" and require_backend("tier1") == "tier1"
    with pytest.raises(errors.InvalidBackendModeError):
        require_backend("x")
    with PeakTracker() as t:
        pass
    assert t.peak >= 0
