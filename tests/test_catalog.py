import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from verbatlas.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
DIR = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(DIR))
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    shown = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert shown(map(tuple, got.select(*columns).collect())) == shown(want)


def test_works_without_the_training_data_operators(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "verbatlas", tmp_path / "verbatlas", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) and len(e.queries()) > 30"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
