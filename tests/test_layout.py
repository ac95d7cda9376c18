"""The library without the training-data subpackage, and rules that all modules keep."""

import ast
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
MODULES = [p for p in (ROOT / "tallyweave").rglob("*.py") if "llm" not in p.parts]


@pytest.mark.parametrize("path", MODULES, ids=lambda p: str(p.relative_to(ROOT)))
def test_rules(path):
    tree = ast.parse(path.read_text())
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            assert node.func.id != "hash", "hash() differs from process to process"
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            names = [a.name for a in node.names] + [getattr(node, "module", None) or ""]
            assert not any("llm" in n.split(".") for n in names)


def test_entry_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((ROOT / name).read_text())
    for path in MODULES:
        to = tmp_path / path.relative_to(ROOT)
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hll_p10' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["hll_p10", "hll_by_group", "kmv_k256", "bottomk_freq", "cm_point", "hist_as_written", "reservoir", "topk_exact", "error_law_fit", "alloc_grid", "alloc_water_filling", "merge_kmv", "merge_linear_count", "native_cm_point", "tdigest_by_group", "space_saving_by_group", "family_losses", "law_predictions", "gates_recorded", "budgeted_system", "load_csv", "load_npy", "stream_zipf", "stream_gmm", "hash_index_sign", "hash_text", "stream_running_hll"])
def test_queries_equal_their_sql(spark, name):
    from tallyweave.plans import catalog, catalog_plans, catalog_streams  # noqa: F401

    db = duckdb.connect()
    for table in ("lineitem", "events", "supplier", "part"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    sql = db.sql(catalog.ORACLE_SQL[name])
    columns = sorted(sql.columns)
    key = lambda rows: sorted([tuple(float(x) if not isinstance(x, str) else x for x in r) for r in rows])
    mine = catalog.QUERIES[name](spark, SMALL).select(*columns).collect()
    assert key(mine) == key(sql.select(*columns).fetchall())
