"""Every query of the log engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tideline.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(r[i] for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df, sql = QUERIES[name](spark, SF), tables.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    order = sorted(df.columns)
    assert plain(map(tuple, df.collect()), df.columns, order) == plain(sql.fetchall(), sql.columns, order)


def test_entry_without_the_llm_folder(spark, tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "tideline"):
        (tmp_path / name).symlink_to(top / name) if name.endswith(".py") else None
    import shutil

    shutil.copytree(top / "tideline", tmp_path / "tideline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'state_latest' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    (tmp_path / "__spark_entry__.py").unlink()
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
