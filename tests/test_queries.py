"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from graphloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=key)
    assert sorted(names) == columns and len(mine) == len(want)
    assert all(close(a, b) for x, y in zip(mine, want) for a, b in zip(x, y))


def test_entry_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'morans_i' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
