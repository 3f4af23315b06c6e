"""The driver's contract, with and without the corpus subpackage."""

import json
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import bench
from inkmesh.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = os.environ.get("BENCH_TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def test_names():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and set(catalog.queries()) <= set(q)


def test_imports_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/inkmesh", f"{tmp_path}/inkmesh", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 35 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)


def test_a_missing_module_that_is_not_removable_is_an_error(tmp_path):
    shutil.copytree(f"{ROOT}/inkmesh", f"{tmp_path}/inkmesh", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert ran.returncode and "no_such_module" in ran.stderr


def test_bench_takes_numbered_queries_only():
    assert bench.numbered(["open_by_id", "op10_pack", "op2_x", "open_by_title", "pipeline", "op1_y"]) == ["op1_y", "op2_x", "op10_pack"]


@needs_data
def test_bench_prints_one_line():
    env = os.environ | {"BENCH_SF_DIR": DATA, "BENCH_CPUS": "2", "BENCH_DRIVER_MEMORY": "1g", "BENCH_QUERIES": "count_by_category,open_by_title"}
    ran = subprocess.run([sys.executable, f"{ROOT}/bench.py"], cwd=ROOT, env=env, capture_output=True, text=True, check=True)
    out = json.loads(ran.stdout.strip().splitlines()[-1])
    assert set(out["queries"]) == {"count_by_category", "open_by_title"} and out["unit"] == "sec" and out["value"] > 0


def normal(rows):
    def value(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(map(value, r)) for r in rows)


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalog.queries()[name](spark, DATA)
    want = con.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert normal([[r[c] for c in columns] for r in got.collect()]) == normal([[r[i] for i in at] for r in want.fetchall()])


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
