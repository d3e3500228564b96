"""Every catalogued query against its SQL."""

import os

import duckdb
import pytest

from cliploom.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def norm(rows):
    return sorted(repr(tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.execute(ORACLE_SQL[name])
    assert sorted(c[0] for c in want.description) == cols
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    rows = norm(got.select(*cols).collect())
    assert rows == norm(want)
    assert rows


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry_hides_no_other_missing_module(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    gone = "import sys; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; print(len(e.queries()))"
    # A name set to None raises what a deleted module raises.
    assert int(run(gone).stdout) == len(QUERIES)
    broken = "import sys; sys.modules['numpy'] = None\nimport __spark_entry__"
    assert run(broken).returncode != 0
