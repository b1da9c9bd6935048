import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from skewloom.session import build_session

    s = build_session("tests", cpus=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


def _plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, data):
    """Compares a registered query with its SQL as bags of rows."""

    def run(query, sql):
        df = query(spark, data)
        names = sorted(df.columns)
        got = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
        rel = duck.execute(sql)
        cols = [c[0] for c in rel.description]
        assert sorted(cols) == names
        want = sorted(tuple(_plain(r[cols.index(c)]) for c in names) for r in rel.fetchall())
        assert got == want

    return run
