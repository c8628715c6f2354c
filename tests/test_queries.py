"""Every registered query of the plans against its DuckDB equivalent."""

import os
import shutil
import subprocess
import sys

import pytest

from foralia import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(frame):
    def plain(x):
        if x is None or x != x:
            return None
        return repr(float(x)) if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f" else str(x)

    names = sorted(frame.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_matches_oracle(spark, duck, name):
    got = plans.queries()[name](spark, SF).toPandas()
    sql = plans.oracles().get(name)
    if sql is None:
        assert len(got)
        return
    assert rows_of(got) == rows_of(duck.execute(sql).df())


def test_works_without_the_corpus_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "foralia"), tmp_path / "foralia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
